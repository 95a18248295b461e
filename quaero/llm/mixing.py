"""Mixing sources to target weights.

Documents get hash-random keys; within each source they are ranged by key into buckets, the buckets' word counts are
summed up to running totals, and a window inside each bucket completes the prefix sum. No task sees more than one bucket
of one source, so a source with a third of all rows is spread over many tasks. A source's budget is cut exactly:
all its documents ``budget // size`` times over (epochs), then whole documents in key order, then part of one.

Defined results: null text has size 0 and null source is a source of its own, last in order; rows equal in id and text are
interchangeable; sources without words have target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import WS, WS_CHARS, count_words

#: Key ranges of each source.
BUCKET_BITS = 10


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Weights run 1 .. cycle over the sources in code point order, null last. Targets are shares of ``share`` times all
    sizes, stop at ``cap`` times their source, and what is cut off is shared again: sources in order of cap over
    weight are full up to the first for which the rest, shared by weight, stays below its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("full", cap * F.col("source_size"))
    fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level).withColumn("is_full", F.col("full") <= F.col("weight") * level)
    first_open = F.min_by(F.when(~F.col("is_full"), F.col("level")), F.when(~F.col("is_full"), F.col("full") / F.col("weight"))).over(everything)
    return levelled.select("source", "source_size", F.coalesce(F.least("full", F.col("weight") * first_open), F.col("full")).alias("target"))


def _name(source: Column) -> Column:
    """Source as a string that is never null, to group and join by."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix(docs: DataFrame, cap: float = 3.0, cycle: int = 3, share: float = 1.0, seed: int = 20, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row, and with ``carry`` the row itself as struct ``doc``."""
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = docs.select(
        "doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("key"),
        _name(F.col("source")).alias("name"), F.shiftrightunsigned(key, 64 - BUCKET_BITS).alias("bucket"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []),
    )
    sums = rows.groupBy("name", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), cap, cycle, share)
    running = F.sum("bucket_size").over(Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        sums.withColumn("offset", F.coalesce(running, F.lit(0)))
        .join(targets.withColumn("name", _name(F.col("source"))).drop("source"), "name")
        .select("name", "bucket", "offset", "source_size", "target")
    )
    inside = F.sum("size").over(Window.partitionBy("name", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return (
        rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(offsets, ["name", "bucket"])
        .withColumn("before", F.col("offset") + F.col("inside"))
        .select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *(["doc"] if carry else []))
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    bare = F.btrim(text, F.lit(WS_CHARS))
    rest = F.try_element_at(F.split(bare, f"[{WS}]+", (n + 1).cast("int")), (n + 1).cast("int"))
    return F.rtrim(F.when(rest.isNull(), bare).otherwise(F.substring(bare, F.lit(1), F.length(bare) - F.length(rest))), F.lit(WS_CHARS))


def materialise(docs: DataFrame, **how: float) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, the last time up to the budget's last word.

    Documents without words weigh nothing and stay as they are. Row order is not defined.
    """
    mixed = mix(docs, carry=True, **how)
    times = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size")))
    copies = mixed.where(times > 0).withColumn("nth", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("nth") * F.col("size"))
    cut = (F.col("size") > 0) & (words < F.col("size"))
    text = F.when(cut, first_words(F.col("doc.text"), words)).otherwise(F.col("doc.text"))
    columns = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return copies.select(*(c.alias(name) for name, c in columns.items()))
