"""Table functions over the sorted spans of a key (a sentence), known to SQL by name once they are registered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class SpansInside:
    """For each different inner span the longest outer span around it; of equally long ones the last. One sweep over the spans of a key.

    Rows are (key, start, end, outer), by start, outer ones first, by falling end. Of the outer spans met so far only those are held that none of the others covers: their ends
    rise with their starts, and those that end before the sweep's place are dropped.
    """

    def __init__(self) -> None:
        self.key: object = None
        self.open: list[tuple[int, int]] = []
        self.last: tuple[int, int] | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        of = {f.name: f.dataType for f in rows.dataType.fields}
        number = LongType() if LongType() in (of["start"], of["end"]) else IntegerType()
        return AnalyzeResult(StructType([StructField("key", of["key"]), *(StructField(c, number) for c in ("start", "end", "outer_start", "outer_end"))]))

    def eval(self, row: object) -> Iterator[tuple]:
        if found := self.met(row["key"], row["start"], row["end"], row["outer"]):
            yield found

    def met(self, key: object, start: int, end: int, outer: bool) -> tuple | None:
        """The next row of the sweep; what is found for it."""
        if key != self.key:
            self.key, self.open, self.last = key, [], None
        elif self.open and self.open[0][1] < start:
            self.open = [o for o in self.open if o[1] >= start]
        if outer:
            if not self.open or self.open[-1][1] < end:
                if self.open and self.open[-1][0] >= start:
                    self.open = [o for o in self.open if o[0] < start]
                self.open.append((start, end))
        elif (start, end) != self.last:
            self.last = start, end
            best, length = None, -1
            for o in self.open:
                if o[1] >= end and o[1] - o[0] >= length:
                    best, length = o, o[1] - o[0]
            if best:
                return key, start, end, *best
        return None


def register(spark: SparkSession) -> None:
    """Makes ``spans_inside(TABLE(...) PARTITION BY key ORDER BY (start, outer DESC, end DESC))`` known to the session's SQL."""
    spark.udtf.register("spans_inside", udtf(SpansInside))


def inside(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """(key, start, end, outer_start, outer_end): spans inside spans of one key; of several outer ones the longest. A null key or end has no match."""
    register(inner.sparkSession)
    part = lambda rows, is_outer: rows.select(F.col(key).alias("key"), "start", "end", F.lit(is_outer).alias("outer"))
    rows = part(inner, False).unionByName(part(outer, True)).where("key is not null and start is not null and end is not null")
    of, names = dict(rows.dtypes), ["key", "start", "end", "outer_start", "outer_end"]
    number = "bigint" if "bigint" in (of["start"], of["end"]) else "int"
    types = [to_arrow_type(rows.schema["key"].dataType), *[pa.int64() if number == "bigint" else pa.int32()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = SpansInside()
        for b in batches:
            found = [x for r in zip(*(b[c].to_pylist() for c in ("key", "start", "end", "outer")), strict=True) if (x := sweep.met(*r))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    ordered = rows.repartition("key").sortWithinPartitions("key", "start", F.desc("outer"), F.desc("end"))
    return ordered.mapInArrow(run, f"key {of['key']}, {', '.join(f'{c} {number}' for c in names[1:])}").withColumnRenamed("key", key)
