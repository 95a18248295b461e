"""Phrase collocations by hierarchical pair naming.

Texts are cut into pieces and words once. Each task gathers the words of a language into blocks: a block's distinct words, and the block's words
as numbers into them. Words that are frequent in all texts get an id in one shuffle and go back to their blocks. From then on a
level k names phrases of k words: two neighbouring ids of level k - 1 are a pair, a block sends each of its distinct pairs once with its
count, the shuffle that brings a pair together gives it an id if it is frequent in all texts, and that id replaces it in the blocks. So only pairs whose both halves
are frequent are ever counted, and blocks shrink from level to level.

A pair's two ids point at its parents, the phrase without its last and without its first word. They give the counts of every first and last part (the
cuts), and a phrase stands inside a longer one of nearly the same count just if it is a parent of such a phrase.

A block sends its words and pairs packed, one row for each bucket of names, and a bucket sends back one row for each block. A name is counted at most once for each block, so the
commonest one is one entry in a million words. Blocks are bounded; their words and ids are compressed and kept in the shared checkpoint folder between levels.

Defined results: a null text is empty, a null language is ``und``; ids and other columns are not read; repeated rows count again; an empty table gives no
rows. Numbers are exact up to 10^15 occurrences.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import SALTS
from quaero.sources.shared import ready_to_checkpoint

#: Words after which the open blocks of a task are closed.
BLOCK_WORDS = 1 << 21
#: Bits of a block's number within its task.
BLOCK_BITS = 20
#: Rows (one for each word or pair and block) that one bucket holds, about.
BUCKET_ROWS = 1 << 22

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_PIECES, _WORDS = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def _compressed(raw: bytes) -> bytes:
    """Bytes compressed, behind their number."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _decompressed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _packed(ids: np.ndarray) -> bytes:
    """Numbers from -1 on, compressed: first all their lowest bytes, then all the next ones, as many as the largest needs."""
    above = ids.astype(np.int64) + 1
    width = max(1, (int(above.max(initial=0)).bit_length() + 7) // 8)
    return _compressed(bytes([width]) + above.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(_decompressed(data), np.uint8)
    planes = raw[1:].reshape(raw[0], -1)
    whole = np.zeros((planes.shape[1], 8), np.uint8)
    whole[:, : raw[0]] = planes.T
    return whole.view(np.int64).reshape(-1) - 1


# Level 1: words ----------------------------------------------------------------------------------------------------


class _Open:
    """An open block of one language: distinct words in order of appearance, and the text as their numbers, -1 between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids = array("q")

    def add(self, words: list[str]) -> None:
        numbers = self.numbers
        self.ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
        self.ids.append(-1)


_BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("size", pa.int64()), ("n", pa.int64())])


def _into_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, words, counts, ids, size, n): the block's distinct words, joined by spaces, and their counts, the text as numbers of words, how many words are distinct and how many there are."""
    block, blocks, size = TaskContext.get().partitionId() << BLOCK_BITS, {}, 0

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal block, size
        for lang, b in blocks.items():
            ids = np.frombuffer(b.ids, np.int64)
            counts = np.bincount(ids[ids >= 0], minlength=len(b.numbers))
            row = [block], [lang], [_compressed(" ".join(b.numbers).encode())], [_packed(counts)], [_packed(ids)], [len(counts)], [counts.sum()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, _BLOCKS.types, strict=True)], schema=_BLOCKS)
            block += 1
        blocks.clear()
        size = 0

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for piece in _PIECES.split(text.translate(_LOWER) if not text.isascii() else text.lower()):
                if words := _WORDS.findall(piece):
                    if lang not in blocks:
                        blocks[lang] = _Open()
                    blocks[lang].add(words)
                    size += len(words)
                    if size >= BLOCK_WORDS:
                        yield from closed()
    yield from closed()


def _renamed(blocks: DataFrame, names: DataFrame, rename: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Blocks with their ids replaced by ``rename``; ``names`` has the replacements of each block."""
    return blocks.groupBy("block").cogroup(names.withColumnRenamed("block", "named").groupBy("named")).applyInArrow(rename, "block long, ids binary, size long").checkpoint()


_SEQUENCES = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("size", pa.int64())])


def _sequence(block: pa.Table, ids: np.ndarray) -> pa.Table:
    """The block's row with new ids, runs of -1 as one, and the number of neighbours; nothing if no two are left."""
    gap = ids < 0
    ids = ids[~(gap & np.append(True, gap[:-1]))]
    pairs = int(((ids[:-1] >= 0) & (ids[1:] >= 0)).sum())
    if not pairs:
        return _SEQUENCES.empty_table()
    return pa.table([block["block"], pa.array([_packed(ids)], pa.binary()), pa.array([pairs])], _SEQUENCES)


def _name_words(block: pa.Table, names: pa.Table) -> pa.Table:
    """Numbers into the block's words become ids, -1 for words that are not frequent."""
    if not len(block) or not len(names):
        return _SEQUENCES.empty_table()
    old = _unpacked(block["ids"][0].as_py())
    ids = np.full(old.max() + 2, -1, np.int64)  # its last place is that of -1
    for number, named in (_unpacked(x).reshape(2, -1) for x in names["names"].to_pylist()):
        ids[np.cumsum(number)] = named
    return _sequence(block, ids[old])


def _pairs_in(ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, n, bucket) of the distinct pairs of neighbours in order, and the places of neighbours with the number of their pair."""
    known, inverse = np.unique(ids, return_inverse=True)
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    pairs, which, n = np.unique(inverse[at] * len(known) + inverse[at + 1], return_inverse=True, return_counts=True)
    x, y = known[pairs // len(known)], known[pairs % len(known)]
    mixed = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return x, y, n, ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), np.stack([at, which])


def _name_pairs(buckets: int, level: int, levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Neighbouring ids become the id of their pair, -1 for pairs that are not frequent. What a bucket sends back has one number for each pair that the block sent to it."""

    def run(block: pa.Table, names: pa.Table) -> pa.Table:
        if not len(block) or not len(names):
            return _SEQUENCES.empty_table()
        old = _unpacked(block["ids"][0].as_py())
        _, _, _, bucket, (at, which) = _pairs_in(old, buckets)
        named = np.full(len(bucket), -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        begins = np.searchsorted(bucket[order], np.arange(buckets))
        for k, data in zip(names["bucket"].to_pylist(), names["names"].to_pylist(), strict=True):
            steps = _unpacked(data)
            often = np.flatnonzero(steps >= 0)
            named[order[begins[k] + often]] = _ids(np.cumsum(steps[often]), k, buckets, level, levels)
        ids = np.full(len(old), -1, np.int64)
        ids[at] = named[which]
        return _sequence(block, ids)

    return run


def _ids(ranks: np.ndarray, bucket: int, buckets: int, level: int, levels: int) -> np.ndarray:
    """Ids of a bucket's frequent names: they count up in steps of ``buckets`` from the bucket's own number, so they stay small; those of different levels differ."""
    return (ranks * buckets + bucket) * levels + level - 1


def _dealt(buckets: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(bucket, places of its rows, its rows packed) of rows whose first column rises; it is kept as differences."""
    order = np.argsort(buckets, kind="stable")
    found, begins = np.unique(buckets[order], return_index=True)
    for bucket, at in zip(found.tolist(), np.split(order, begins[1:]), strict=True):
        yield bucket, at, _packed(np.concatenate([np.diff(columns[0][at], prepend=0), *(c[at] for c in columns[1:])]))


def _words_of(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, block, lang, words, rows): for each bucket of words those that a block has, with their numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lang, words, counts in zip(*(b[c].to_pylist() for c in ("block", "lang", "words", "counts")), strict=True):
                seed, every = crc32(lang.encode()), _decompressed(words).split(b" ")
                deal = np.array([crc32(w, seed) for w in every], np.int64) % buckets
                rows = [(k, b" ".join([every[i] for i in at.tolist()]), x) for k, at, x in _dealt(deal, np.arange(len(every)), _unpacked(counts))]
                numbers, joined, packed = zip(*rows, strict=True)
                columns = numbers, [block] * len(rows), [lang] * len(rows), map(_compressed, joined), packed
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _WORDS_DEALT, strict=True)], schema=_WORDS_DEALT)

    return run


def _pairs_of(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, block, rows): for each bucket of pairs the distinct pairs of neighbours that a block has, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b["block"].to_pylist(), b["ids"].to_pylist(), strict=True):
                x, y, n, deal, _ = _pairs_in(_unpacked(data), buckets)
                numbers, _, packed = zip(*_dealt(deal, x, y, n), strict=True)
                columns = numbers, [block] * len(numbers), packed
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PAIRS_DEALT, strict=True)], schema=_PAIRS_DEALT)

    return run


_PAIRS_DEALT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("rows", pa.binary())])
_WORDS_DEALT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("rows", pa.binary())])


# All levels --------------------------------------------------------------------------------------------------------


def _counted(key: list[str], least: int, buckets: int, level: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    """One bucket's rows of all blocks become one row for each block with its frequent names, and one row for each of these names with its key and count. For words a block gets its
    numbers of words and their ids; for pairs, which are in order on both sides, the steps between the ranks of its frequent ones, and -1 for each other pair that it sent."""
    words = "word" in key
    schema = pa.schema([*_NAMES, *((c, pa.string() if words else pa.int64()) for c in key)])

    def laid_out(columns: dict[str, pa.Array], n: int) -> pa.Table:
        return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema)

    def run(bucket: pa.Table) -> pa.Table:
        parts = [_unpacked(x).reshape(2 if words else 3, -1) for x in bucket["rows"].to_pylist()]
        sizes = [p.shape[1] for p in parts]
        old = [np.concatenate([np.cumsum(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in range(1, len(parts[0]) - 1))]
        n = np.concatenate([p[-1] for p in parts])
        if words:
            names = pa.chunked_array([pa.array(_decompressed(x).split(b" "), pa.binary()) for x in bucket["words"].to_pylist()]).combine_chunks().dictionary_encode()
            langs = bucket["lang"].combine_chunks().dictionary_encode()
            by = np.repeat(langs.indices.to_numpy(), sizes), names.indices.to_numpy()
        else:
            by = old
        order = np.lexsort(by[::-1])
        begins = np.append(True, np.any([c[order][1:] != c[order][:-1] for c in by], axis=0))
        first = np.flatnonzero(begins)
        f = np.add.reduceat(n[order], first)
        often, number = np.flatnonzero(f >= least), bucket["bucket"][0].as_py()
        if not len(often):
            return schema.empty_table()
        ranks = np.full(len(f), -1, np.int64)
        ranks[often] = np.arange(len(often))
        own = np.empty(len(n), np.int64)
        own[order] = ranks[np.cumsum(begins) - 1]
        first = order[first[often]]
        met, packed = [], []
        for block, of in zip(bucket["block"].to_pylist(), np.split(np.arange(len(n)), np.cumsum(sizes)[:-1]), strict=True):
            at = of[own[of] >= 0]
            if len(at):
                met.append(block)
                if words:
                    packed.append(_packed(np.concatenate([np.diff(old[0][at], prepend=0), _ids(own[at], number, buckets, level, levels)])))
                else:
                    steps = np.full(len(of), -1, np.int64)
                    steps[at - of[0]] = np.diff(own[at], prepend=0)
                    packed.append(_packed(steps))
        keys = [names.take(pa.array(by[c][first])) for c, names in enumerate((langs.dictionary, names.dictionary))] if words else [pa.array(c[first]) for c in by]
        names = {"block": pa.array(met), "bucket": pa.array([number] * len(met)), "names": pa.array(packed, pa.binary())}
        ids = _ids(np.arange(len(often)), number, buckets, level, levels)
        return pa.concat_tables([laid_out(names, len(met)), laid_out({"id": pa.array(ids), "f": pa.array(f[often]), **dict(zip(key, keys, strict=True))}, len(often))])

    return run


_NAMES = [("block", pa.int64()), ("bucket", pa.int64()), ("names", pa.binary()), ("id", pa.int64()), ("f", pa.int64())]


def _named(blocks: DataFrame, key: list[str], k: int, longest: int, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(``names``: block, bucket, names; ``level``: id, f and the key; number of buckets) of the words or pairs of ``blocks`` that occur ``least`` times.

    Names are dealt into buckets by hash, about ``BUCKET_ROWS`` rows of all blocks in each; a block sends one packed row to each bucket, where its names are counted and get their ids."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, (blocks.agg(F.sum("size")).first()[0] or 0) // BUCKET_ROWS + 1)
    deal, kinds, kind = (_words_of, _WORDS_DEALT, "string") if "word" in key else (_pairs_of, _PAIRS_DEALT, "long")
    names = {"int64": "long", "string": "string", "binary": "binary"}
    dealt = blocks.mapInArrow(deal(buckets), ", ".join(f"{f.name} {names[str(f.type)]}" for f in kinds)).repartition(buckets, "bucket")
    out = ", ".join([*(f"{c} {names[str(t)]}" for c, t in _NAMES), *(f"{c} {kind}" for c in key)])
    gathered = dealt.groupBy("bucket").applyInArrow(_counted(key, least, buckets, k, longest), out).checkpoint()
    return gathered.where("names is not null").select("block", "bucket", "names"), gathered.where("names is null").select("id", "f", *key), buckets


def phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(``totals``: lang, n), (``phrases``: id, lang, k, phrase, f, left, right, heads, tails) of all phrases of 1 to ``longest`` words that occur ``least`` times. ``left`` and ``right``
    are the ids of the phrase without its last and its first word (null for words), ``heads`` the counts of its first 1 to k - 1 words, ``tails`` those of its last ones."""
    ready_to_checkpoint(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    first = texts.mapInArrow(_into_blocks, "block long, lang string, words binary, counts binary, ids binary, size long, n long").checkpoint()
    totals = first.groupBy("lang").agg(F.sum("n").alias("n"))
    names, level, _ = _named(first, ["lang", "word"], 1, longest, least)
    blocks = _renamed(first.select("block", "ids"), names, _name_words)
    nothing = F.array().cast("array<long>")
    level = level.select(
        "id", "lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "f", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"),
        nothing.alias("heads"), nothing.alias("tails"), F.col("word").alias("last"),
    )
    found = level
    for k in range(2, longest + 1):
        names, ids, buckets = _named(blocks, ["x", "y"], k, longest, least)
        if k < longest:
            blocks = _renamed(blocks, names, _name_pairs(buckets, k, longest))
        left = level.select(F.col("id").alias("x"), "lang", "phrase", F.col("f").alias("left_f"), F.col("heads").alias("left_heads"))
        right = level.select(F.col("id").alias("y"), F.col("f").alias("right_f"), F.col("tails").alias("right_tails"), "last")
        level = ids.join(left, "x").join(right, "y").select(
            "id", "lang", F.lit(k).alias("k"), F.concat("phrase", F.lit(" "), "last").alias("phrase"), "f", F.col("x").alias("left"), F.col("y").alias("right"),
            F.array_append("left_heads", F.col("left_f")).alias("heads"), F.array_append("right_tails", F.col("right_f")).alias("tails"), "last",
        ).checkpoint()
        found = found.unionByName(level)
    return totals, found.drop("last")


def cut_scores(a: Column, n: Column, heads: Column, tails: Column) -> Column:
    """For each cut of a phrase, from its first word on: (floor(1000 a n / (l r)), words before it, l, r). Products are decimals of up to 36 digits."""
    exact = lambda c: c.cast("decimal(15,0)")
    above = exact(a) * exact(n) * F.lit(1000).cast("decimal(4,0)")

    def one(left: Column, right: Column) -> Column:
        return F.struct(F.call_function("div", above, exact(left) * exact(right)).alias("score"), left.alias("l"), right.alias("r"))

    return F.zip_with(heads, F.reverse(tails), one)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``most`` best phrases of 2 words or more.

    A phrase goes if it stands inside a longer one with ``percent`` of its occurrences. Its score is that of its worst cut, the first of equal ones. A longer phrase
    that is so frequent has parts that are too, down to one that is a word longer than the phrase, so looking at the phrase's own pairs is enough.
    """
    totals, every = phrases(docs, longest, least)
    every = every.where("k > 1")
    inside = every.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
    kept = every.join(inside, "id", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("f")))
    spread = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = kept.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["lang", "salt"])
    cuts = F.transform(cut_scores(F.col("f"), F.col("n"), F.col("heads"), F.col("tails")), lambda c, i: F.struct(c["score"].alias("score"), i.alias("i"), c["l"].alias("l"), c["r"].alias("r")))
    scored = counted.withColumn("cut", F.array_min(cuts)).select("lang", "salt", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
