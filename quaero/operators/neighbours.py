"""Approximate nearest neighbours by inverted lists of product-quantised vectors.

Unit vectors are dealt to the nearest of a bounded number of centroids; what a vector has beyond its centroid is cut into pieces, each named by the nearest
entry of a small table. Centroids and tables are learned from a bounded sample; every row is indexed: a list's number and a few bytes. A search
reads the lists nearest to a probe and scores their vectors by table look-ups alone; the best few of each probe meet their whole vectors in one join and
are ordered by exact cosines.

Lists are a column, not groups: a list that holds a third of all rows is scored by all tasks that hold a part of it, and each task passes on its best of each probe only.

Defined results: null and zero vectors, and those of another size than most, are not in the index; vectors that share an id are rows of their own; ids order equal cosines; an empty table finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quaero.functions import vectors as V
from quaero.operators.best import Best
from quaero.operators.ranking import cosines, top_similar
from quaero.sources.shared import ready_to_checkpoint

#: Rows of the sample that is learned from, most lists, pieces of a vector, rounds of learning, and probes in one block.
MOST_ROWS, MOST_LISTS, PIECES, ROUNDS, PROBES_AT_ONCE = 20_000, 1024, 16, 12, 2000
#: Entries of a piece's table: one byte.
ENTRIES = 256
#: Vectors that a task scores together, probes in one product of matrices, and pairs that are compared exactly at once.
ROWS_AT_ONCE, PROBES_TOGETHER, PAIRS_AT_ONCE = 1 << 16, 256, 1 << 16


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * rows @ centres.T, 1)


def _means(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres by Lloyd's rounds from rows drawn without replacement; a centre without rows stays."""
    centres = rows[rng.permutation(len(rows))[: min(k, len(rows))]].copy()
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, rows)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the lists (lists x dims) and one table for each piece (pieces x entries x dims of the piece)."""

    centroids: np.ndarray
    tables: np.ndarray

    def encoded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of unit vectors."""
        near = _nearest(rows, self.centroids)
        rest = (rows - self.centroids[near]).reshape(len(rows), len(self.tables), -1)
        return near, np.stack([_nearest(rest[:, p], t) for p, t in enumerate(self.tables)], 1).astype(np.uint8)


def fit(vectors: DataFrame, n_rows: int | None = None, most_rows: int = MOST_ROWS, seed: int = 7, key: str = "vec_id") -> Quantiser:
    """Learns from vectors of the commonest size, from at most ``most_rows`` rows, those of least hash; about the root of the number of rows is taken as lists, ``MOST_LISTS`` at most."""
    usable = vectors.where(F.col("embedding").isNotNull() & (V.norm(F.col("embedding")) > 0))
    sizes = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return Quantiser(np.zeros((0, 1)), np.zeros((1, 1, 1)))
    n = sizes["count"] if n_rows is None else n_rows
    rows = usable.where(F.size("embedding") == sizes["size"]).orderBy(F.xxhash64(F.lit(seed), key, "embedding")).limit(most_rows).select("embedding").collect()
    rng, sample = np.random.default_rng(seed), np.array([r.embedding for r in rows], float)
    sample = _units(sample)
    centroids = _means(sample, int(min(MOST_LISTS, max(1, round(n**0.5)))), rng)
    rest = sample - centroids[_nearest(sample, centroids)]
    pieces = max(p for p in range(1, PIECES + 1) if sample.shape[1] % p == 0)
    parts = rest.reshape(len(rest), pieces, -1)
    found = [_means(parts[:, p], ENTRIES, rng) for p in range(pieces)]
    width = max(map(len, found))
    return Quantiser(centroids, np.stack([np.pad(t, ((0, width - len(t)), (0, 0)), mode="edge") for t in found]))


def index(vectors: DataFrame, quantiser: Quantiser, key: str = "vec_id") -> DataFrame:
    """(key, list, code) of every usable vector; to be written once, sorted by list where scans shall skip."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            if len(b):
                near, codes = q.encoded(_units(b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b[key], pa.array(near.astype(np.int32)), packed], [key, "list", "code"])

    known = vectors.where((F.size("embedding") == quantiser.centroids.shape[1]) & (V.norm(F.col("embedding")) > 0)).select(key, "embedding")
    return known.mapInArrow(run, f"{key} {kind}, list int, code binary") if len(quantiser.centroids) else known.limit(0).select(key, F.lit(0).alias("list"), F.lit(b"").alias("code"))


def search(indexed: DataFrame, vectors: DataFrame, probes: DataFrame, quantiser: Quantiser, k: int = 10, lists: int = 8, again: int = 10, key: str = "vec_id") -> DataFrame:
    """(probe, key, cos, rank): the ``k`` nearest other vectors of each probe among those of its ``lists`` nearest lists, ``again`` times k of which are compared exactly.

    Probes are a stated set, taken in blocks of ``PROBES_AT_ONCE``.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    usable = probes.where((F.size("embedding") == quantiser.centroids.shape[1]) & (V.norm(F.col("embedding")) > 0)).select(key, "embedding")
    blocks = usable.count() // PROBES_AT_ONCE + 1
    found = None
    for n in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == n).collect()
        some = _scanned(indexed, quantiser, [r[0] for r in rows], np.array([r[1] for r in rows], float), k * again, lists, key, kind)
        found = some if found is None else found.unionByName(some)
    best = found.distinct().withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("near"), key))).where(F.col("n") <= k * again)
    ready_to_checkpoint(spark)
    met = best.groupBy(key).agg(F.collect_list("probe").alias("probes")).checkpoint().join(vectors.select(key, "embedding"), key)
    scored = None
    for n in range(blocks):
        rows = usable.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == n).collect()
        some = _compared(met, dict((r[0], r[1]) for r in rows), key, kind)
        scored = some if scored is None else scored.unionByName(some)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("cos"), key))).where(F.col("rank") <= k)


def _compared(met: DataFrame, probes: dict, key: str, kind: str) -> DataFrame:
    """(probe, key, cos) of vectors beside the ids of the probes that they may be near to; a vector is moved once, the probes of a block travel to the executors."""
    shared = met.sparkSession.sparkContext.broadcast(({p: i for i, p in enumerate(probes)}, np.array(list(probes.values()), float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = shared.value
        for b in batches:
            parents, asked = b["probes"].value_parent_indices().to_numpy(), b["probes"].flatten()
            known = np.array([number.get(p, -1) for p in asked.to_pylist()], np.int64)
            at = np.flatnonzero(known >= 0)
            if not len(at):
                continue
            own = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
            for a in range(0, len(at), PAIRS_AT_ONCE):
                some = at[a : a + PAIRS_AT_ONCE]
                cos = cosines(rows[known[some]], own[parents[some]])
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(some)), b[key].take(pa.array(parents[some])), pa.array(cos)], ["probe", key, "cos"])

    return met.where(F.size("embedding") == shared.value[1].shape[-1]).mapInArrow(run, f"probe {kind}, {key} {kind}, cos double") if probes else met.sparkSession.createDataFrame([], f"probe {kind}, {key} {kind}, cos double")


def tuned(indexed: DataFrame, vectors: DataFrame, quantiser: Quantiser, k: int = 10, target: float = 0.95, most: int = 20, seed: int = 3, key: str = "vec_id") -> tuple[int, int]:
    """(lists, again) with which a search finds ``target`` of the exact neighbours, measured against brute force over all vectors for ``most`` probes of least hash. Lists are doubled
    until it is reached or all are read, then the exact comparisons, until they are all vectors. Vectors in tight clusters need few lists, spread ones about all; then only the codes
    make a search cheap."""
    usable = vectors.where((F.size("embedding") == quantiser.centroids.shape[1]) & (V.norm(F.col("embedding")) > 0))
    probes = usable.orderBy(F.xxhash64(F.lit(seed), key)).limit(most).checkpoint()
    exact = top_similar(usable, probes, k, key).checkpoint()
    lists, again, n = min(4, len(quantiser.centroids)), 10, indexed.count()
    while (lists < len(quantiser.centroids) or again * k < n) and recall(search(indexed, vectors, probes, quantiser, k, lists, again, key), exact) < target:
        lists, again = (min(2 * lists, len(quantiser.centroids)), again) if lists < len(quantiser.centroids) else (lists, 2 * again)
    return lists, again


def _scanned(indexed: DataFrame, quantiser: Quantiser, ids: list, rows: np.ndarray, most: int, lists: int, key: str, kind: str) -> DataFrame:
    """(probe, key, near): of each task's vectors in a probe's lists the ``most`` with the largest estimated cosine."""
    spark = indexed.sparkSession
    if not ids:
        return spark.createDataFrame([], f"probe {kind}, {key} {kind}, near double")
    units = _units(rows)
    chosen = np.argsort((quantiser.centroids**2).sum(1) - 2 * units @ quantiser.centroids.T, 1, kind="stable")[:, :lists]
    asked: dict[int, np.ndarray] = {x: np.flatnonzero((chosen == x).any(1)) for x in np.unique(chosen).tolist()}
    pieces, everywhere = np.arange(len(quantiser.tables)), len(asked) == len(quantiser.centroids)
    shared = spark.sparkContext.broadcast((ids, units, asked, quantiser))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, asked, q = shared.value
        names, best = pa.array(ids, arrow).to_numpy(zero_copy_only=False), Best(len(ids), most)
        for own, near, codes in _gathered(batches, key):
            # The look-ups of a code are parts of the product with the vector that it stands for.
            stands = q.centroids[near] + q.tables[pieces, codes].reshape(len(codes), -1)
            groups = [(np.arange(len(ids)), np.arange(len(own)))] if lists >= len(q.centroids) else [(asked[x], np.flatnonzero(near == x)) for x in np.unique(near).tolist() if x in asked]
            for wanted, rows in groups:
                for a in range(0, len(wanted), PROBES_TOGETHER):
                    some = wanted[a : a + PROBES_TOGETHER]
                    for r in range(0, len(rows), 1 << 14):
                        part = rows[r : r + (1 << 14)]
                        scores = units[some] @ stands[part].T
                        scores[names[some][:, None] == own[part][None, :]] = -np.inf
                        i, j = best.hits(some, scores)
                        values = scores[i, j]
                        good = values > -np.inf
                        best.offer(some[i[good]], own[part][j[good]], values[good])
        i, keys, values = best.found()
        yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i.tolist()], arrow), pa.array(keys.tolist(), arrow), pa.array(values)], ["probe", key, "near"])

    arrow = to_arrow_type(indexed.schema[key].dataType)
    return (indexed if everywhere else indexed.where(F.col("list").isin(sorted(asked)))).select(key, "list", "code").mapInArrow(run, f"probe {kind}, {key} {kind}, near double")


def _gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, lists, codes) of about ``ROWS_AT_ONCE`` rows."""
    held, n = [], 0
    for b in batches:
        if len(b):
            held.append((b[key].to_numpy(zero_copy_only=False), b["list"].to_numpy(), np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(len(b), -1)))
            n += len(b)
        if n >= ROWS_AT_ONCE:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def scored_share(indexed: DataFrame, probes: DataFrame, quantiser: Quantiser, lists: int = 8) -> float:
    """Share of the indexed vectors that :func:`search` scores for a probe, on average; the probes are a stated set."""
    rows = np.array([r.embedding for r in probes.where(V.norm(F.col("embedding")) > 0).select("embedding").collect()], float)
    sizes = dict(indexed.groupBy("list").count().collect())
    if not len(rows) or not sizes:
        return 0.0
    near = np.argsort((quantiser.centroids**2).sum(1) - 2 * _units(rows) @ quantiser.centroids.T, 1, kind="stable")[:, :lists]
    return sum(sizes.get(x, 0) for row in near.tolist() for x in row) / len(rows) / sum(sizes.values())


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (probe, cos) that were found, where a neighbour of the same cosine is as good."""
    want = exact.groupBy("probe").agg(F.min("cos").alias("least"), F.count(F.lit(1)).alias("n"))
    got = want.join(found.select("probe", "cos"), "probe", "left").groupBy("probe").agg(F.least(F.max("n"), F.count_if(F.col("cos") >= F.col("least"))).alias("right"), F.max("n").alias("n"))
    row = got.agg(F.sum("right").alias("right"), F.sum("n").alias("n")).first()
    return row.right / row.n if row.n else 1.0
