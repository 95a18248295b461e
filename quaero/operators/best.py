"""The best few of each probe among scored rows that a task meets, held in arrays."""

from __future__ import annotations

import numpy as np

#: Hits that wait at least before they are merged.
LEAST_WAITING = 100_000


class Best:
    """For each of ``n`` probes the ``k`` rows with the largest values; of equal values those with the least keys. Memory is bounded by ``n * k`` and one offer."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.most_waiting = k, max(LEAST_WAITING, n * k)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.least = np.full(n, -np.inf)
        self.last_key = np.zeros(n, object)

    def hits(self, probes: np.ndarray, scores: np.ndarray, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the scores (probes x rows) that can be among the best, if a score is at most half of ``margin`` from the value that is offered for it."""
        least = self.least[probes]
        if scores.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        return np.nonzero(scores >= (least - margin)[:, None])

    def offer(self, probes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        """Rows one by one: the number of the probe, the key and the value."""
        least = self.least[probes]
        good = values > least
        if len(tied := np.flatnonzero(values == least)):
            good[tied] = np.isneginf(least[tied]) | (keys[tied] < self.last_key[probes[tied]]).astype(bool)
        self.held.append((probes[good], keys[good], values[good]))
        self.waiting += int(good.sum())
        if self.waiting > self.most_waiting:
            self._merge()

    def _merge(self) -> None:
        probes, keys, values = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((keys, -values, probes))
        probes, keys, values = probes[order], keys[order], values[order]
        begins = np.flatnonzero(np.append(True, probes[1:] != probes[:-1]))
        place = np.arange(len(probes)) - np.repeat(begins, np.diff(np.append(begins, len(probes))))
        full = place == self.k - 1
        self.least[probes[full]], self.last_key[probes[full]] = values[full], keys[full]
        kept = place < self.k
        self.held, self.waiting = [(probes[kept], keys[kept], values[kept])], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, key, value) of the best, by probe."""
        if self.held:
            self._merge()
            return self.held[0]
        return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
