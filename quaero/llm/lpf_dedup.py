"""Substring deduplication with longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or earlier in
the same one. A longest-previous-factor (LPF) array would say so where it reaches ``length``. Only that threshold is asked for, so
no LPF value is formed on the main path: windows of equal rank in suffix order stand in for it, the first of a class staying.
``longest_previous_factor`` gives the array of one text.

One suffix array of a corpus has no place in any task, so the suffixes are dealt out by content. Each window of
``length`` bytes is owned by its minimizer, the 32-byte string inside it with the least hash (the leftmost of several). Equal
windows have equal minimizers, so windows that are equal meet at one key. Neighbouring windows share their minimizer and travel
as one chunk of bytes; keys that occur once in the whole corpus (nearly all, in clean text) send nothing but 8 bytes. A
key's chunks are then compared as bytes: equal chunks at once, the others by a suffix array over them.

Documents whose whole text a smaller id has are settled first by their digest. Later chunks equal to an earlier one
of their own bucket are settled there, so a passage in a third of all documents sends one chunk for each megabyte of text.
All passes are one job; what they pass on goes through shuffles, so a lost executor costs a retry.

Defined results: null text counts as empty; a null id sorts after all others and is returned as null; rows with one id are
ordered by their text; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.buckets import BLOB_SCHEMA, NO_ID, Layout, blob_table, by_target, in_buckets, layout, with_ids
from quaero.llm.common import later_copies

#: Bytes of a minimizer, a power of two.
GRAM = 32
#: Bytes hashed at once, to stay inside the processor's cache.
PIECE = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * _MIX
    for _ in range(2):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each position on."""
    h, span = _byte_codes()[data], 1
    while span < GRAM:
        h = (h[:-span] ^ (h[:-span] >> np.uint64(29))) * (_MIX + np.uint64(2 * span)) + h[span:]
        span *= 2
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def chunks(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, key) of each run of windows with one minimizer; no window crosses a text.

    ``starts`` and ``sizes`` are the places of the texts in ``data``, one after another.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(data)
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    steps = np.zeros(len(anchor) + 1, np.int32)
    whole = sizes >= length
    np.add.at(steps, starts[whole], 1)
    np.add.at(steps, starts[whole] + sizes[whole] - length + 1, -1)
    inside = np.cumsum(steps[:-1]) > 0
    edge = np.ones(len(anchor), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(anchor)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    return first, count, grams[anchor[first]]


class Texts:
    """The texts of one bucket that have windows of their own to look at, in order of (id, text)."""

    def __init__(self, table: pa.Table, notes: list[bytes]) -> None:
        copies = set(notes)
        rows = sorted((i, (t or "").encode()) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
        self.ids = [i for i, _ in rows]
        self.data = [t for _, t in rows]
        marked = {int.from_bytes(n[:8], "big", signed=True) for n in copies}
        self.copy = [
            (k > 0 and rows[k - 1] == row) or (row[0] in marked and row[0].to_bytes(8, "big", signed=True) + hashlib.sha256(row[1]).digest() in copies)
            for k, row in enumerate(rows)
        ]

    def pieces(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, row of each part, its start in that text, its place in the bytes): long texts in parts that overlap by length - 1."""
        rows, begins, parts, size = [], [], [], 0
        for k, text in enumerate(self.data):
            if self.copy[k] or len(text) < length:
                continue
            for at in range(0, len(text) - length + 1, PIECE):
                parts.append(text[at : at + PIECE + length - 1])
                rows.append(k)
                begins.append(at)
                size += len(parts[-1])
                if size >= PIECE:
                    yield self._joined(parts, rows, begins)
                    rows, begins, parts, size = [], [], [], 0
        if parts:
            yield self._joined(parts, rows, begins)

    @staticmethod
    def _joined(parts: list[bytes], rows: list[int], begins: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return np.frombuffer(b"".join(parts), np.uint8), np.array(rows), np.array(begins), at


def _notes(table: pa.Table, kind: int) -> list[bytes]:
    return [x for x, k in zip(table["blob"].to_pylist(), table["bucket"].to_pylist(), strict=True) if (k < 0) == (kind < 0)]


def _keys_once(length: int, plan: Layout):
    """Pass 1: every key of a bucket once, or twice if it occurs again there."""

    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        found = [chunks(data, at[:-1], np.diff(at), length)[2] for data, _, _, at in Texts(docs, _notes(notes, -1)).pieces(length)]
        if not found:
            return blob_table([])
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        keys = np.concatenate([keys, keys[n > 1]])
        b = key[0].as_py()
        return blob_table([(t, b, keys[i].tobytes()) for t, i in by_target((keys % np.uint64(plan.key_buckets)).astype(np.int64))])

    return run


def _repeated(key: tuple, rows: pa.Table) -> pa.Table:
    """Pass 2: to each bucket, those of its keys that occur twice or more in all."""
    parts = [np.frombuffer(x, np.uint64) for x in rows["blob"].to_pylist()]
    values, n = np.unique(np.concatenate(parts), return_counts=True)
    again = values[n > 1]
    out = []
    for b, part in zip(rows["b"].to_pylist(), parts, strict=True):
        mine = np.unique(part[again[np.minimum(np.searchsorted(again, part), len(again) - 1)] == part]) if len(again) else part[:0]
        if len(mine):
            out.append((key[0].as_py(), b, mine.tobytes()))
    return blob_table(out)


_META = np.dtype([("key", "<u8"), ("id", "<i8"), ("nth", "<u4"), ("at", "<u4"), ("n", "<u1")])
_RUN = np.dtype([("id", "<i8"), ("nth", "<u4"), ("at", "<u4"), ("n", "<u4")])


def _send(length: int, plan: Layout):
    """Pass 3: the chunks of repeated keys; later ones equal to one of the same bucket are settled here."""

    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        again = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in _notes(notes, 1))]))
        texts = Texts(docs, _notes(notes, -1))
        nth, seen_id = [], {}
        for i in texts.ids:
            nth.append(seen_id.setdefault(i, 0))
            seen_id[i] += 1
        metas, contents, settled, seen = [], [], [], set()
        if len(again):
            for data, rows, begins, at in texts.pieces(length):
                first, n, keys = chunks(data, at[:-1], np.diff(at), length)
                chosen = np.flatnonzero(again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys)
                part = np.searchsorted(at, first[chosen], "right") - 1
                raw = data.tobytes()
                for k, p in zip(chosen.tolist(), part.tolist(), strict=True):
                    content = raw[first[k] : first[k] + n[k] + length - 1]
                    row = int(rows[p])
                    place = (texts.ids[row], nth[row], int(first[k] - at[p] + begins[p]))
                    if content in seen:
                        settled.append((*place, int(n[k])))
                    else:
                        seen.add(content)
                        metas.append((int(keys[k]), *place, int(n[k])))
                        contents.append(content)
        b = key[0].as_py()
        out = []
        if metas:
            meta = np.array(metas, _META)
            for t, idx in by_target((meta["key"] % np.uint64(plan.key_buckets)).astype(np.int64)):
                out.append((t, b, len(idx).to_bytes(4, "little") + meta[idx].tobytes() + b"".join(contents[i] for i in idx)))
        if settled:
            out.append((-1 - b % plan.key_buckets, b, np.array(settled, _RUN).tobytes()))
        return blob_table(out)

    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each position on among all of them (bytes past the end count as 0), by doubling."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    n = len(data)
    words = np.empty(n, np.uint64)
    for k in range(8):
        part = words[k::8]
        part[:] = np.frombuffer(padded, ">u8", len(part), k)
    rank, span = np.unique(words, return_inverse=True)[1].astype(np.int64), 8
    while span < length:
        step = min(span, length - span)
        rank = np.unique(rank * (n + 1) + np.append(rank[step:] + 1, np.zeros(step, np.int64))[:n], return_inverse=True)[1].astype(np.int64)
        span += step
    return rank


def later_windows(contents: list[bytes], counts: list[int], length: int) -> np.ndarray:
    """For the windows of the chunks, one after another in corpus order: whether an equal one comes earlier.

    In suffix order cut off at ``length`` bytes, with ties in corpus order, the suffix to the left is the nearest that starts
    earlier (the previous smaller position) if it is equal, and the next smaller position is in another class.
    """
    at = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
    rank = suffix_ranks(np.frombuffer(b"".join(contents), np.uint8), length)
    windows = np.concatenate([np.arange(a, a + n) for a, n in zip(at, counts, strict=False)])
    rank = rank[windows]
    order = np.argsort(rank, kind="stable")
    later = np.zeros(len(windows), bool)
    later[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    return later


def _settle(length: int):
    """Pass 4: in one class of keys, which windows have an earlier equal one; to each bucket, its own runs of them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return rows.select(["bucket", "b", "blob"])
        metas, contents, of_row = [], [], []
        for k, blob in enumerate(rows["blob"].to_pylist()):
            n = int.from_bytes(blob[:4], "little")
            metas.append(meta := np.frombuffer(blob, _META, n, 4))
            at = 4 + n * _META.itemsize
            for size in (meta["n"].astype(np.int64) + length - 1).tolist():
                contents.append(blob[at : at + size])
                at += size
            of_row.append(np.full(n, k))
        meta, of_row = np.concatenate(metas), np.concatenate(of_row)
        order = np.lexsort((meta["at"], meta["nth"], meta["id"]))
        first: dict[bytes, int] = {}
        gone, distinct = [], []
        for i in order.tolist():
            (distinct if first.setdefault(contents[i], i) == i else gone).append(i)
        runs = [(of_row[i], meta["id"][i], meta["nth"][i], meta["at"][i], meta["n"][i]) for i in gone]
        own = meta["key"][distinct]
        values, n = np.unique(own, return_counts=True)
        mixed = [i for i, m in zip(distinct, (n > 1)[np.searchsorted(values, own)].tolist(), strict=True) if m]
        if mixed:
            counts = meta["n"][mixed].astype(np.int64)
            later = later_windows([contents[i] for i in mixed], counts.tolist(), length)
            at = np.concatenate([[0], np.cumsum(counts)])
            edge = np.ones(len(later), bool)
            edge[1:] = later[1:] != later[:-1]
            edge[at[:-1]] = True
            starts = np.flatnonzero(edge)
            sizes = np.diff(np.append(starts, len(later)))
            chunk = np.searchsorted(at, starts, "right") - 1
            for s, size, c in zip(starts[later[starts]].tolist(), sizes[later[starts]].tolist(), chunk[later[starts]].tolist(), strict=True):
                i = mixed[c]
                runs.append((of_row[i], meta["id"][i], meta["nth"][i], int(meta["at"][i]) + s - int(at[c]), size))
        if not runs:
            return blob_table([])
        table = np.array([r[1:] for r in runs], _RUN)
        buckets = rows["b"].to_pylist()
        return blob_table([(0, buckets[k], table[idx].tobytes()) for k, idx in by_target(np.array([r[0] for r in runs]))])

    return run


def _cut(length: int):
    """Pass 5: the removed byte ranges of every document, and what is left."""

    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        runs = np.concatenate([np.zeros(0, _RUN), *(np.frombuffer(x, _RUN) for x in _notes(notes, 1))])
        texts = Texts(docs, _notes(notes, -1))
        runs = runs[np.lexsort((runs["nth"], runs["id"]))]
        ends = np.searchsorted(runs["id"], np.array([*texts.ids, 0], np.int64)[:-1], "right")
        begins = np.searchsorted(runs["id"], np.array([*texts.ids, 0], np.int64)[:-1], "left")
        out, nth = [], 0
        for k, text in enumerate(texts.data):
            nth = nth + 1 if k and texts.ids[k] == texts.ids[k - 1] else 0
            mine = runs[begins[k] : ends[k]]
            mine = mine[mine["nth"] == nth]
            spans: list[tuple[int, int]] = []
            if texts.copy[k] and len(text) >= length:
                spans = [(0, len(text))]
            elif len(mine):
                steps = np.zeros(len(text) + 1, np.int32)
                np.add.at(steps, mine["at"], 1)
                np.add.at(steps, mine["at"].astype(np.int64) + mine["n"] + (length - 1), -1)
                bare = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
                turns = np.flatnonzero(bare[1:] != bare[:-1])
                spans = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
            kept, at = [], 0
            for a, z in spans:
                kept.append(text[at:a])
                at = z
            kept.append(text[at:])
            out.append((texts.ids[k], len(text), spans, b"".join(kept)))
        return pa.table({
            "doc_id": pa.array([None if r[0] == NO_ID else r[0] for r in out], pa.int64()),
            "n_bytes": pa.array([r[1] for r in out], pa.int64()),
            "spans": pa.array([[{"start": a, "end": z} for a, z in r[2]] for r in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_sha256": pa.array([hashlib.sha256(r[3]).hexdigest() for r in out], pa.string()),
            "kept": pa.array([r[3] for r in out], pa.binary()),
        })

    return run


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, spans of removed bytes, kept_sha256, kept): ``kept`` is the rest as bytes, since a cut may fall inside a character."""
    assert GRAM < length < GRAM + 255, "a chunk's window count is one byte"
    plan = layout(docs)
    ids = with_ids(docs)
    texts = in_buckets(ids, plan)
    marked = later_copies(ids).select("doc_id", F.unhex("digest").alias("digest"))
    copies = in_buckets(marked, plan).select(
        F.lit(-1).cast("long").alias("bucket"), "b", F.concat(F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), "digest").alias("blob")
    )
    together = lambda notes: texts.groupBy("b").cogroup(notes.groupBy("b"))
    keys = together(copies).applyInArrow(_keys_once(length, plan), BLOB_SCHEMA)
    again = keys.groupBy("bucket").applyInArrow(_repeated, BLOB_SCHEMA)
    sent = together(copies.union(again)).applyInArrow(_send(length, plan), BLOB_SCHEMA)
    runs = sent.groupBy("bucket").applyInArrow(_settle(length), BLOB_SCHEMA)
    gone = runs.withColumn("bucket", F.lit(0).cast("long"))
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    return together(copies.union(gone)).applyInArrow(_cut(length), schema)


def longest_previous_factor(data: bytes) -> list[int]:
    """The LPF array of one text: the longest match at each position with one that starts earlier.

    The previous and next smaller positions in suffix order are found by unlinking positions from the last to the first.
    """
    n = len(data)
    order = sorted(range(n), key=lambda i: data[i:])
    place = {p: k for k, p in enumerate(order)}
    before, after = {p: (order[k - 1] if k else None) for p, k in place.items()}, {p: (order[k + 1] if k + 1 < n else None) for p, k in place.items()}
    found = [0] * n

    def common(i: int, j: int | None) -> int:
        k = 0
        while j is not None and i + k < n and j + k < n and data[i + k] == data[j + k]:
            k += 1
        return k

    for p in range(n - 1, -1, -1):
        a, z = before[p], after[p]
        found[p] = max(common(p, a), common(p, z))
        if a is not None:
            after[a] = z
        if z is not None:
            before[z] = a
    return found
