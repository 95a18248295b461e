"""Documents in small buckets, for operators that work on the bytes of many documents at once.

A bucket is a hash class of ids with about a megabyte of text. All passes over the texts of one query group by the same
bucket, so they share one shuffle of the texts, and what a pass sends back to a document is addressed to its bucket:
a key found in a thousand documents of a bucket is one entry on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 1 << 20
#: Stands for a null id; sorts last.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Layout:
    buckets: int
    key_buckets: int


def layout(docs: DataFrame, key_bytes: int | None = None) -> Layout:
    """Numbers of buckets that follow the size of the texts: one of keys for each ``key_bytes`` of text; if none are said, at least the shuffle's partitions."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    keys = total // key_bytes + 1 if key_bytes else max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (BUCKET_BYTES * 32) + 1)
    return Layout(total // BUCKET_BYTES + 1, keys)


def with_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with ids that are never null."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")


def in_buckets(rows: DataFrame, plan: Layout) -> DataFrame:
    return rows.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(plan.buckets)))


def by_target(targets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(target, the positions that go there), positions in their order."""
    order = np.argsort(targets, kind="stable")
    found, first = np.unique(targets[order], return_index=True)
    for t, part in zip(found.tolist(), np.split(order, first[1:]), strict=True) if len(found) else ():
        yield t, part


def blob_table(rows: list[tuple]) -> pa.Table:
    """(bucket, b, blob) rows."""
    to, b, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(to, pa.int64()), "b": pa.array(b, pa.int64()), "blob": pa.array(blob, pa.binary())})


BLOB_SCHEMA = "bucket long, b long, blob binary"
