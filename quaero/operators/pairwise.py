"""Ranking by pairwise preferences: two copies of one small network score two items, and the difference of the scores says which is preferred.

The pairs stay where they are: in each round every task adds up the loss and its gradient over its pairs in Arrow batches, one row a task is summed, and the driver, which
holds only the weights, takes a step (Adam). The model is a few thousand numbers, whatever the number of pairs.

Defined results: pairs with a null or a vector of another size are left out; repeated pairs count again; without pairs the first weights stay; equal scores are no preference; ids order items
that nothing else orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.operators.ranking import ranked_by_preferences

#: Width of the hidden layer, rounds, and the length of a step.
HIDDEN, ROUNDS, RATE = 16, 40, 0.05


@dataclass(frozen=True)
class Tower:
    """score(x) = top . tanh(inner x + bias)."""

    inner: np.ndarray
    bias: np.ndarray
    top: np.ndarray

    @staticmethod
    def fresh(dims: int, hidden: int = HIDDEN, seed: int = 7) -> Tower:
        rng = np.random.default_rng(seed)
        return Tower(rng.normal(size=(hidden, dims)) / dims**0.5, np.zeros(hidden), rng.normal(size=hidden) / hidden**0.5)

    @staticmethod
    def packed(flat: np.ndarray, dims: int) -> Tower:
        hidden = len(flat) // (dims + 2)
        return Tower(flat[: hidden * dims].reshape(hidden, dims), flat[hidden * dims : hidden * (dims + 1)], flat[hidden * (dims + 1) :])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inner.reshape(-1), self.bias, self.top])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.inner.T + self.bias) @ self.top

    def loss_and_gradient(self, a: np.ndarray, z: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum over pairs of the logistic loss of "a is preferred to z", and its gradient by the flat weights."""
        ha, hz = np.tanh(a @ self.inner.T + self.bias), np.tanh(z @ self.inner.T + self.bias)
        margin = (ha - hz) @ self.top
        loss = np.logaddexp(0, -np.where(label > 0, margin, -margin)).sum()
        off = 1 / (1 + np.exp(-margin)) - label
        da, dz = off[:, None] * self.top * (1 - ha * ha), -off[:, None] * self.top * (1 - hz * hz)
        return float(loss), np.concatenate([(da.T @ a + dz.T @ z).reshape(-1), da.sum(0) + dz.sum(0), off @ (ha - hz)])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def fit(pairs: DataFrame, dims: int, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = RATE, decay: float = 1e-4, seed: int = 7) -> Tower:
    """The tower with the least mean loss over (va array, vz array, label 0/1), found in ``rounds`` passes over the pairs."""
    usable = pairs.where((F.size("va") == dims) & (F.size("vz") == dims) & F.col("label").isNotNull()).select(F.col("va").cast("array<double>"), F.col("vz").cast("array<double>"), F.col("label").cast("double"))
    tower = Tower.fresh(dims, hidden, seed)
    weights, first, second = tower.flat(), 0.0, 0.0

    for n in range(1, rounds + 1):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            tower, total, count = Tower.packed(weights, dims), np.zeros(len(weights)), 0
            for b in batches:
                total += tower.loss_and_gradient(_matrix(b["va"], dims), _matrix(b["vz"], dims), b["label"].to_numpy())[1]
                count += len(b)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total) + 1), pa.int32()), pa.array([*total, count], pa.float64())], ["at", "x"])

        summed = dict(usable.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect())
        count = summed.pop(len(weights), 0)
        if not count:
            return tower
        step = np.array([summed[i] for i in range(len(weights))]) / count + decay * weights
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step * step
        weights = weights - rate * (first / (1 - 0.9**n)) / (np.sqrt(second / (1 - 0.999**n)) + 1e-8)
    return Tower.packed(weights, dims)


def score(vector: Column, tower: Tower) -> Column:
    """The tower's score of a vector as a native expression."""
    dot = lambda row: F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(w)) for w in row)), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, v: s + v)
    total = F.lit(0.0)
    for row, bias, top in zip(tower.inner, tower.bias, tower.top, strict=True):
        total = total + float(top) * F.tanh(dot(row) + float(bias))
    return total


def preferences(items: DataFrame, tower: Tower, key: str = "qid", item: str = "item", vector: str = "vector") -> DataFrame:
    """(key, winner, loser) for the pairs of different items of a key (a question's words, so few) where one has the larger score."""
    scored = items.select(key, F.col(item).alias("item"), score(F.col(vector), tower).alias("score")).where("score is not null")
    other = scored.select(key, F.col("item").alias("loser"), F.col("score").alias("less"))
    return scored.join(other, key).where("item <> loser and score > less").select(key, F.col("item").alias("winner"), "loser")


def ranked(items: DataFrame, tower: Tower) -> DataFrame:
    """(qid, item, rank): the items of each question in the order that their preferences merge into."""
    return ranked_by_preferences(preferences(items, tower))
