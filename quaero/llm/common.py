"""What several training-data operators share: word definitions, checkpoints, copies, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.sources.shared import ready_to_checkpoint

#: Space and the five ASCII controls tab .. carriage return, as Java regex class body and as trim characters.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Parts into which the rows of one key are dealt where a single key may have very many.
SALTS = 16
#: Edges of a graph that one task connects before the distributed steps: 16 MB.
EDGES_AT_ONCE = 1 << 20


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WS}]+"))


def count_words(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


#: Bits of each of the maps by which rows are told apart before a shuffle: three times 1 MB, whatever the input.
MAP_BITS = 1 << 23


def likely_among(rows: DataFrame, key: Column, keys: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """``rows`` without most of those whose ``key`` (long, not null) is not in ``keys``' only column; none that is in it goes.

    Each key sets one bit in each of three maps of fixed size (a power of two of at most 2^34 bits), which are broadcast as words of 64 bits: a number is read from a joined row without copying, which
    bytes are not. The three bits stand in words of one place. Fuller maps let more rows pass: a join must follow, an inner one, since a semi-join would be moved below this.
    """
    spots = lambda h: [F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63).cast("long")).cast("int") for n in (46, 52, 58)]
    where = lambda h: h.bitwiseAND(F.lit(max(bits // 64, 1) - 1).cast("long"))
    hashed = keys.select(F.xxhash64(F.col(f"`{keys.columns[0]}`")).alias("__hash"))
    set_bits = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(__hash, {n}) & 63 as int))")).alias(f"__map{k}") for k, n in enumerate((46, 52, 58))]
    maps = hashed.groupBy(where(F.col("__hash")).alias("__word")).agg(*set_bits)
    placed = rows.withColumn("__hash", F.xxhash64(key)).withColumn("__word", where(F.col("__hash")))
    met = placed.join(F.broadcast(maps), "__word")
    for k, s in enumerate(spots(F.col("__hash"))):
        met = met.where(F.getbit(F.col(f"__map{k}"), s) == 1)
    return met.drop("__hash", "__word", "__map0", "__map1", "__map2")


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, first_id, digest): every document whose exact text a smaller doc_id also has.

    The copies of one text are counted by map-side aggregation, so a text that a third of all rows share costs each task one row; the join
    back to the rows is salted, with the repeated texts' (few) first ids copied to every salt.
    """
    marked = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = first.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["digest", "salt"]).where("doc_id > first_id").select("doc_id", "first_id", "digest").distinct()


def _beside(rows: DataFrame, low: DataFrame) -> DataFrame:
    """``rows`` (u, v) with the m of their u; the rows of one u are dealt over SALTS tasks."""
    spread = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"])


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Fewest pairs that connect what ``pairs`` connect: each node with the least one it reaches."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, z in pairs.tolist():
        a, z = find(a), find(z)
        root[max(a, z)] = min(a, z)
    return np.array([(x, find(x)) for x in list(root) if find(x) != x], np.int64).reshape(-1, 2)


def _spanning_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [np.stack([b["u"].to_numpy(), b["v"].to_numpy()], 1) for b in batches]
    if rows:
        found = spanning(np.concatenate(rows))
        yield pa.record_batch({"u": found[:, 0], "v": found[:, 1]})


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node of an undirected graph can reach.

    Parts of at most EDGES_AT_ONCE edges or so are first replaced by spanning stars. Then large-star and small-star steps alternate
    until no edge changes. Each step is a minimum with map-side aggregation and a join back in which the edges of one node are dealt
    over SALTS tasks; each round is checkpointed to the shared folder. Nodes without edges are not returned.
    """
    spark = edges.sparkSession
    ready_to_checkpoint(spark)
    found = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct().checkpoint()
    links = found.coalesce(found.count() // EDGES_AT_ONCE + 1).mapInArrow(_spanning_parts, "u long, v long").checkpoint()
    while not _are_stars(links):
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _beside(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _beside(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        links = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
    return links.union(links.select("v", "v").distinct()).toDF("node", "root")


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one parent, and no parent has one itself."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    met = ends.groupBy("e.x").agg(F.sum("e.up").alias("parents"), F.min("e.up").alias("least"))
    return met.where((F.col("parents") > 1) | ((F.col("parents") > 0) & (F.col("least") == 0))).isEmpty()
