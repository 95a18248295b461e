"""A stored positional index: postings written once, bucketed by term, and read only where a query needs them.

Tasks turn their documents into segments: for each term its documents and the places of the term in them. Segments are range-sorted by bucket, term and
first document, so that a term of a third of all words is dealt over several tasks, and cut into blocks. A block holds documents and places as
differences, compressed, beside its term, the range of its documents and its largest contribution to a score. The table is
partitioned by bucket: a search reads the folders of its terms' buckets and, in them, the row groups of its terms.

Defined results: words are those of :func:`quaero.operators.vocabulary.lower_words`; documents without an id or a word are not in the index; rows that share an id are documents of
their own, and searches return the id once, with the best of their scores; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaero.operators.phrases import words_of

#: Postings after which a task closes its segments, documents in one block, and buckets of terms.
SEGMENT_POSTINGS, BLOCK_DOCS, BUCKETS = 1 << 21, 4096, 64
#: Bytes up to which a block is not compressed: to begin a compression costs more than so short a one saves.
SMALL = 1024
#: Blocks and their bytes after which a task passes on a batch.
BATCH_BLOCKS, BATCH_BYTES = 4096, 1 << 23
#: Occurrences at which a term gives half of its weight.
HALF = 1.2

_SCHEMA = "term string, first_doc long, last_doc long, n_docs int, most double, data binary"
_NAMES = ["term", "first_doc", "last_doc", "n_docs", "most", "data"]


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _encoded(docs: np.ndarray, rows: np.ndarray, counts: np.ndarray, places: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Blocks that begin at ``starts``, each with its number of documents, documents and their rows as differences, how often the term is in each, and its places as differences
    within a document; those of a document begin at ``begins``."""

    def steps(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = np.diff(x, prepend=0)
        found[at] = x[at]
        return found

    n, m = np.diff(starts, append=len(docs)), np.add.reduceat(counts, starts)
    ends = np.cumsum(1 + 3 * n + m)
    at = ends - (1 + 3 * n + m)
    raw = np.empty(ends[-1], np.int64)
    raw[at] = n
    here = np.repeat(at + 1 - starts, n) + np.arange(len(docs))
    for k, column in enumerate((steps(docs, starts), steps(rows, starts), counts)):
        raw[here + k * np.repeat(n, n)] = column
    raw[np.repeat(at + 1 + 3 * n - begins[starts], m) + np.arange(len(places))] = steps(places, begins)
    whole = raw.view(np.uint8).data
    for a, z in zip((8 * at).tolist(), (8 * ends).tolist(), strict=True):
        block = bytes(whole[a:z])
        yield len(block).to_bytes(8, "little") + (pa.compress(block, "zstd", asbytes=True) if len(block) > SMALL else block)


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, their rows, number of places of each, places) of a block."""
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True) if size > SMALL else data[8:], np.int64)
    n = raw[0]
    docs, rows, counts, steps = np.cumsum(raw[1 : n + 1]), np.cumsum(raw[n + 1 : 2 * n + 1]), raw[2 * n + 1 : 3 * n + 1], raw[3 * n + 1 :]
    total = np.cumsum(steps)
    begins = np.cumsum(counts) - counts
    before = np.concatenate([[0], total])[begins]
    return docs, rows, counts, total - np.repeat(before, counts)


def contribution(tf: np.ndarray | Column) -> np.ndarray | Column:
    """What a term that occurs ``tf`` times adds to a score, as a share of its weight."""
    return tf / (tf + HALF)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's documents. An open segment has a number for each term and three small numbers for each posting, in arrays."""
    numbers: dict[str, int] = {}
    terms, rows, places, docs = array("i"), array("i"), array("i"), array("q")
    before = TaskContext.get().partitionId() << 33

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal before
        if terms:
            names, of = list(numbers), np.array(docs)
            # Rows in order of documents are the smaller key; places rise within a row, and the sort is stable.
            rank = np.empty(len(of), np.int32)
            by_doc = np.argsort(of, kind="stable")
            rank[by_doc] = np.arange(len(of), dtype=np.int32)
            order = np.lexsort((rank[np.array(rows)], np.array(terms)))
            term, row, place = (np.array(x)[order] for x in (terms, rows, places))
            new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            counts, term, row = np.diff(new, append=len(place)), term[new], row[new]
            begins = np.flatnonzero(np.diff(term, prepend=-1) != 0)
            inside = np.arange(len(term)) - np.repeat(begins, np.diff(begins, append=len(term)))
            starts = np.flatnonzero(inside % BLOCK_DOCS == 0)
            doc, most = of[row], contribution(np.maximum.reduceat(counts, starts)).tolist()
            ends = np.append(starts[1:], len(term))
            first, last, n = doc[starts].tolist(), doc[ends - 1].tolist(), (ends - starts).tolist()
            found, size = [], 0
            for k, (t, data) in enumerate(zip(term[starts].tolist(), _encoded(doc, row + np.int64(before), counts, place, new, starts), strict=True)):
                found.append((names[t], first[k], last[k], n[k], most[k], data))
                size += len(data)
                if len(found) >= BATCH_BLOCKS or size >= BATCH_BYTES:
                    yield _batch(found)
                    found, size = [], 0
            if found:
                yield _batch(found)
        before += len(docs)
        numbers.clear()
        for x in (terms, rows, places, docs):
            del x[:]

    for b in batches:
        for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
            words = words_of(text.as_py())
            terms.extend([numbers.setdefault(w, len(numbers)) for w in words])
            places.extend(range(len(words)))
            rows.extend([len(docs)] * len(words))
            docs.append(doc)
            if len(terms) >= SEGMENT_POSTINGS:
                yield from closed()
    yield from closed()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of (doc_id long, text) as a table partitioned by bucket."""
    known = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = known.mapInArrow(_segments, _SCHEMA).withColumn("bucket", bucket_of(F.col("term"), buckets))
    blocks.repartitionByRange("bucket", "term", "first_doc").sortWithinPartitions("bucket", "term", "first_doc").write.partitionBy("bucket").parquet(path)


def blocks_of(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The blocks of some terms. The buckets are constants of the plan, so only their folders are listed and read."""
    wanted = sorted(set(terms))
    places = sorted({r[0] for r in spark.createDataFrame([(t,) for t in wanted] or [("",)], "term string").select(bucket_of(F.col("term"), buckets)).collect()})
    return spark.read.schema(f"{_SCHEMA}, bucket int").parquet(path).where(F.col("bucket").isin(places) & F.col("term").isin(wanted))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for term, data in zip(b["term"].to_pylist(), b["data"].to_pylist(), strict=True):
            docs, rows, counts, places = decoded(data)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([term] * len(docs), pa.string()), pa.array(docs), pa.array(rows), lists], ["term", "doc_id", "row", "places"])


def postings(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, row, places) of blocks; ``row`` tells documents apart that share an id."""
    return blocks.select("term", "data").mapInArrow(_postings, "term string, doc_id long, row long, places array<int>")


def documents_with_all(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(doc_id) of documents that have all the words."""
    wanted = sorted({w.lower() for w in terms})
    hits = postings(blocks_of(spark, path, wanted, buckets)).groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("doc_id").distinct()


def documents_with_phrase(spark: SparkSession, path: str, phrase: str, within: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n) of documents with the words of a phrase one behind the other, and how often; each next word may stand up to ``within`` places later. Places of the first word are
    carried from word to word, so what is compared are the lists of one document."""
    words = words_of(phrase)
    if not words:
        return spark.createDataFrame([], "doc_id long, n long")
    read = postings(blocks_of(spark, path, words, buckets))
    found = read.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("of")).where(F.size(F.map_keys("of")) == len(set(words)))
    at = F.transform(F.element_at("of", F.lit(words[0])), lambda p: F.struct(p.alias("first"), p.alias("last")))
    for w in words[1:]:
        at = _followed(at, F.element_at("of", F.lit(w)), within)
    hits = found.select("doc_id", F.size(F.array_distinct(F.transform(at, lambda s: s["first"]))).cast("long").alias("n")).where("n > 0")
    return hits.groupBy("doc_id").agg(F.sum("n").alias("n"))


def _followed(at: Column, here: Column, within: int) -> Column:
    """The (first, last) places of ``at`` carried on to places of the next word that stand up to ``within`` places too late."""
    near = lambda s: F.filter(here, lambda p: (p > s["last"]) & (p <= s["last"] + 1 + within))
    return F.flatten(F.transform(at, lambda s: F.transform(near(s), lambda p: F.struct(s["first"].alias("first"), p.alias("last")))))


def top_documents(spark: SparkSession, path: str, weights: dict[str, float], k: int, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, score, rank) of the ``k`` best documents by the sum of weight * tf / (tf + 1.2) over the words.

    Blocks that cannot hold one of them are not decoded: the k-th best sum over the blocks with the largest contributions of the heaviest word is a bound from below, and a document
    of a block can have its contribution and the other words' largest at most. Only the small columns of the blocks are read to find out.
    """
    wanted = {w.lower(): float(x) for w, x in weights.items() if x > 0}
    blocks = blocks_of(spark, path, list(wanted), buckets)
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair)), F.col("term")) if wanted else F.lit(0.0)
    summary = {r.term: r for r in blocks.groupBy("term").agg(F.max("most").alias("most"), F.sum("n_docs").alias("n")).collect()}
    bound = sum(wanted[t] * r.most for t, r in summary.items())
    least = _bound_from_below(blocks, wanted, summary, k)
    most_of = F.element_at(F.create_map(*(F.lit(x) for t, r in summary.items() for x in (t, float(wanted[t] * r.most)))), F.col("term")) if summary else F.lit(0.0)
    possible = blocks.where(F.lit(bound + 1e-9) - most_of + weight * F.col("most") >= F.lit(least))
    parts = postings(possible).select("doc_id", "row", (weight * contribution(F.size("places"))).alias("part"))
    # A document that stays may have lost a word with its block; then its whole sum is below the bound too, so no such document is among the best.
    scored = parts.groupBy("doc_id", "row").agg(F.round(F.sum("part"), 9).alias("score")).groupBy("doc_id").agg(F.max("score").alias("score"))
    best = scored.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def _bound_from_below(blocks: DataFrame, wanted: dict[str, float], summary: dict, k: int) -> float:
    """The k-th largest contribution of one word alone, over different ids: at least k documents reach it."""
    reached = 0.0
    for term, r in summary.items():
        if r.n >= k:
            rows = blocks.where(F.col("term") == term).select("most", "n_docs", "data").orderBy(F.desc("most")).limit(-(-4 * k // BLOCK_DOCS) + 1).collect()
            read = [decoded(x.data) for x in rows]
            ids, counts = np.concatenate([x[0] for x in read]), np.concatenate([x[2] for x in read])
            order = np.argsort(-counts, kind="stable")
            first = np.sort(np.unique(ids[order], return_index=True)[1])
            if len(first) >= k:
                reached = max(reached, wanted[term] * float(contribution(counts[order][first[k - 1]])))
    return reached
