"""Timings by label: how often, how long at least, at most and on average, from the driver's steps and from the batches of all tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Stats = dict[str, tuple[int, float, float, float]]  # label: count, least, most, sum


class _Merged(AccumulatorParam):
    def zero(self, value: Stats) -> Stats:
        return {}

    def addInPlace(self, a: Stats, b: Stats) -> Stats:  # noqa: N802  Spark's name
        for label, (n, low, high, total) in b.items():
            if label in a:
                m, other, top, both = a[label]
                n, low, high, total = n + m, min(low, other), max(high, top), total + both
            a[label] = n, low, high, total
        return a


class Timings:
    """Collects timings of one application.

    ``step`` times a block of the driver, with the rows of the tables that ``observed`` counts while they pass. ``batches`` times a function of Arrow batches on the executors: each task adds
    one entry for each batch to an accumulator. A task that runs again adds its batches again, so counts are those of the work done. Labels are few; an unknown
    one has no row; a label with no finished step is left out.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.found = spark.sparkContext.accumulator({}, _Merged())
        self.rows: dict[str, Observation] = {}

    @contextmanager
    def step(self, label: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        took = time.perf_counter() - began
        self.found.add({label: (1, took, took, took)})

    def observed(self, rows: DataFrame, label: str) -> DataFrame:
        """``rows``, counted under the label when an action reads them."""
        self.rows[label] = Observation(label)
        return rows.observe(self.rows[label], F.count(F.lit(1)).alias("rows"))

    def batches(self, label: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """``run`` for ``mapInArrow``, each of its batches timed."""
        found = self.found

        def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = run(batches)
            while True:
                began = time.perf_counter()
                batch = next(out, None)
                took = time.perf_counter() - began
                if batch is None:
                    return
                found.add({label: (1, took, took, took)})
                yield batch

        return timed

    def table(self) -> DataFrame:
        """(label, count, least, most, mean, rows): seconds, and the rows observed under the label or null."""
        stats = self.found.value
        counted = {label: o.get["rows"] for label, o in self.rows.items() if label in stats}
        rows = [(label, n, low, high, total / n, counted.get(label)) for label, (n, low, high, total) in sorted(stats.items())]
        return self.spark.createDataFrame(rows, "label string, count long, least double, most double, mean double, rows long")
