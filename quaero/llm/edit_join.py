"""Line deduplication: exact copies, and lines within a few edits, by a segment-partition join.

Of two lines within ``edits`` edits, one cut into ``edits + 1`` segments keeps a segment unchanged in the other. Every distinct
line is an entry under each of its segments (with its length and the segment's number) and looks itself up, for each
length that a partner may have, under the few substrings at which such a segment can stand: those whose shift leaves enough edits
on both sides. Candidates are compared by their whole texts with the built-in banded edit distance, a native expression.

Lines of one key may be very many (a template, a common third) and are not paired then. What two of them have beside that segment is within
``edits`` edits too: up to COMPARED lines or so are compared by it inside the join, which passes on near ones only. Of more lines it is cut into segments
again, under the key so far; the same is done with keys of so many lines found there. At the last of LEVELS, two lines that meet have four fifths of their characters in common.

A line is removed if it occurred before, or if an earlier different line (by id, then line number) is within ``edits`` edits of it.
Lines are known by 64-bit hashes (two different lines share one with a chance of 2^-64 for each pair); near lines are decided by their texts. A line
that a third of the corpus repeats is one entry after map-side aggregation.

Defined results: lines are split at ``\\n``; null texts have none; lines without a word (any character but ASCII white space) stay; lines
shorter than ``least`` characters are compared for equality only; rows that share an id are numbered together in order of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import WS_CHARS, likely_among, ready_to_checkpoint

EDITS = 2
LEAST = 16
#: Bits of each of the three maps of keys that are broadcast: 12 MB in all, whatever the input.
MAP_BITS = 1 << 25
#: From about MANY lines under one key on, these are not paired by their ids but compared by what they have beside it, from COMPARED times as many on
#: they are told apart by further segments first; LEVELS is how often lines meet so.
MANY = 24
COMPARED = 2
LEVELS = 4


def _places(edits: int) -> list[tuple[int, int, int]]:
    """(shorter, segment, shift) of every substring that a partner as long, or up to ``edits`` shorter, may have as that segment. Those of shift 0 in one as long are a line's own segments."""
    return [
        (shorter, i, shift) for shorter in range(edits + 1) for i in range(1, edits + 2)
        for shift in range(max(1 - i, shorter - (edits + 1 - i)), min(i - 1, shorter + (edits + 1 - i)) + 1)
    ]


def _at_places(rows: DataFrame, places: list[tuple[int, int, int]], edits: int, wanted: Column | None = None) -> DataFrame:
    """``rows``, which have (raw, n), for each of the places that lie inside the line, with its ``shorter``, ``own``, ``start``, ``size`` and ``cut``, the key of that segment.

    The places are rows of a constant and one short expression makes all keys: an array of a key for each place would be a method too long for the JVM to compile. ``raw`` (UTF-32) has four
    bytes for each character, so it is cut without reading what stands before; it and ``n`` are columns of their own, else they would be computed for each place.
    """
    parts = F.lit(edits + 1)
    known = F.array(*(F.struct(F.lit(s).alias("shorter"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for s, i, shift in places))
    if wanted is not None:
        known = F.filter(known, lambda p: p["shorter"] == wanted)
    at = rows.withColumn("at", F.explode(known)).withColumn("length", F.col("n") - F.col("at.shorter"))
    at = at.withColumn("more", F.pmod("length", parts)).withColumn("base", ((F.col("length") - F.col("more")) / parts).cast("int"))
    start = F.col("base") * (F.col("at.i") - 1) + F.greatest(F.lit(0), F.col("at.i") - 1 - parts + F.col("more")) + 1 + F.col("at.shift")
    at = at.withColumn("start", start.cast("int")).withColumn("size", (F.col("base") + F.when(F.col("more") >= parts - F.col("at.i") + 1, 1).otherwise(0)).cast("int"))
    key = F.xxhash64("length", "at.i", F.substring("raw", 4 * F.col("start") - 3, 4 * F.col("size")))
    own = (F.col("at.shorter") == 0) & (F.col("at.shift") == 0)
    inside = at.where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")))
    return inside.select(*rows.columns, F.col("at.shorter").alias("cut_shorter"), own.alias("cut_own"), "start", "size", key.alias("cut"))


def _meet(index: DataFrame, asks: DataFrame, many: int | None, edits: int | None = None) -> DataFrame:
    """Checkpointed (a, z, key): pairs of ids that meet under a key, or, for a key of about ``many`` lines (None: of none), each asker a with the key and no z.

    A key of many lines is told from a quarter of the lines, chosen by hash; where that misses one, it costs pairs and no result. Its lines are
    not paired: one of them, ``rep``, stands for it. Of two equally long lines, which would find each other, the larger id asks. If rows bring what their
    lines have beside the key (``rest``), lines meet only if these are within ``edits`` edits: near lines are so under one key at least, and only near ones are so under any.
    """
    part = index.where(F.pmod(F.xxhash64("id"), F.lit(4)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"))
    hot = part.where(F.col("n") >= (max(many // 4, 1) if many else 1 << 62)).select("key", "rep")
    stands = index.join(hot, "key", "left").where("rep is null or rep = id")
    pair = (F.col("id") < F.col("asker")) | ((F.col("id") > F.col("asker")) & ~F.col("even"))
    if edits is not None:
        pair &= F.levenshtein("rest", "asked", edits) >= 0
    met = stands.join(asks, "key").where(F.col("rep").isNotNull() | pair)
    own = F.col("rep").isNotNull()
    return met.select(F.when(own, F.col("asker")).otherwise(F.least("id", "asker")).alias("a"), F.when(~own, F.greatest("id", "asker")).alias("z"), F.when(own, F.col("key")).alias("key")).distinct().checkpoint()


def _rests(rows: DataFrame, edits: int) -> DataFrame:
    """(id, key, raw, n, shorter, own): each row's line without each of its substrings that may be a partner's segment. Rows have (id, raw, n), and
    from the second level on the key so far, how much shorter the partner is, and whether all cuts so far were the line's own segments."""
    deeper = "key" in rows.columns
    cut = _at_places(rows, _places(edits), edits, F.col("shorter") if deeper else None)
    before, after = F.substring("raw", F.lit(1), 4 * (F.col("start") - 1)), F.substring("raw", 4 * (F.col("start") + F.col("size")) - 3, F.octet_length("raw"))
    key = F.xxhash64("key", "cut") if deeper else F.col("cut")
    own = F.col("own") & F.col("cut_own") if deeper else F.col("cut_own")
    return cut.select("id", key.alias("key"), F.concat(before, after).alias("raw"), (F.col("n") - F.col("size")).alias("n"), F.col("cut_shorter").alias("shorter"), own.alias("own"))


def _with_offsets(docs: DataFrame) -> DataFrame:
    """(doc, text, before): the number of lines in the earlier rows of the same id, rows in order of their text. A single id's rows are dealt into ranges
    of texts, so one with very many rows is summed range by range."""
    ready_to_checkpoint(docs.sparkSession)
    rows = docs.where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    repeated = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc").alias("again")).checkpoint()
    if repeated.isEmpty():
        return rows.withColumn("before", F.lit(0))
    same = rows["doc"].eqNullSafe(repeated["again"])
    single = rows.join(repeated, same, "left_anti").withColumn("before", F.lit(0))
    ranged = rows.join(repeated, same, "left_semi").withColumn("n", F.size(F.split("text", "\n"))).repartitionByRange(F.col("doc"), F.col("text"))
    ranged = ranged.withColumn("part", F.spark_partition_id()).checkpoint()
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("doc", "part").agg(F.sum("n").alias("n")).select(F.col("doc").alias("d"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier("doc", "part")), F.lit(0)).alias("start"))
    inside = ranged.withColumn("own", F.coalesce(F.sum("n").over(earlier("part", "doc", "text")), F.lit(0)))
    placed = inside.join(parts, inside["doc"].eqNullSafe(parts["d"]) & (inside["part"] == parts["p"]))
    return single.unionByName(placed.select("doc", "text", (F.col("start") + F.col("own")).cast("int").alias("before")))


def line_places(docs: DataFrame) -> DataFrame:
    """(doc, no, line) of every line with a word; ``no`` counts over all rows of the id."""
    placed = _with_offsets(docs).select("doc", "before", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return placed.where(F.length(F.btrim("line", F.lit(WS_CHARS))) > 0).select("doc", (F.col("before") + F.col("at")).alias("no"), "line")


def _candidates(long: DataFrame, edits: int) -> DataFrame:
    """(a, z): ids of lines that share a segment, and under a segment of many lines, further segments of what is left of them."""
    sized = long.select("id", F.length("line").alias("n"), F.encode("line", "UTF-32").alias("raw"))
    own = [p for p in _places(edits) if p[0] == p[2] == 0]
    index = _at_places(sized, own, edits).select("id", F.col("cut").alias("key")).distinct().checkpoint()
    asks = _at_places(sized, [p for p in _places(edits) if p not in own], edits).select(F.col("id").alias("asker"), F.col("cut").alias("key"), (F.col("cut_shorter") == 0).alias("even"))
    asks = likely_among(asks, F.col("key"), index.select("key"), MAP_BITS).distinct().union(index.select("id", "key", F.lit(True)))
    met = _meet(index, asks, MANY)
    found = met.where("z is not null").select("a", "z")
    cuts = None
    for level in range(1, LEVELS + 1):
        many = met.where("z is null").select(F.col("a").alias("id"), "key")
        if many.isEmpty():
            break
        if cuts is None:  # cuts are read several times and made once
            ids = many.select("id").distinct()
            cuts = _rests(likely_among(sized, F.col("id"), ids).join(ids, "id").distinct(), edits).join(many, ["id", "key"]).checkpoint()
        else:
            cuts = _rests(cuts.join(many, ["id", "key"]), edits).checkpoint()
        # A character before the rest, as decoding would take a byte order mark from its begin.
        keys = cuts.select("id", "key", "shorter", "own", F.decode(F.concat(F.encode(F.lit("x"), "UTF-32"), "raw"), "UTF-32").alias("rest"))
        asks = keys.select(F.col("id").alias("asker"), "key", (F.col("shorter") == 0).alias("even"), F.col("rest").alias("asked")).distinct()
        met = _meet(keys.where("own").select("id", "key", "rest").distinct(), asks, COMPARED * MANY if level < LEVELS else None, edits)
        found = found.union(met.where("z is not null").select("a", "z"))
    return found.distinct().checkpoint()


def near_pairs(lines: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(a, z): ids of different lines within ``edits`` edits, each pair once; ``lines`` has (id, line), repeated at will.

    Look-ups whose key no line stands under stay in their task, told by maps of fixed size. Candidates are pairs of ids; only the lines
    among them are read once more, to be compared.
    """
    ready_to_checkpoint(lines.sparkSession)
    long = lines.where(F.length("line") >= max(least, edits + 1)).select("id", "line")
    found = _candidates(long, edits)
    ids = found.select(F.explode(F.array("a", "z")).alias("id")).distinct().checkpoint()
    texts = likely_among(long, F.col("id"), ids).join(ids, "id").distinct()
    both = found.join(texts.select(F.col("id").alias("a"), F.col("line").alias("a_line")), "a").join(texts.select(F.col("id").alias("z"), F.col("line").alias("z_line")), "z")
    near = both.where((F.abs(F.length("a_line") - F.length("z_line")) <= edits) & (F.levenshtein("a_line", "z_line", edits) >= 0))
    return near.select("a", "z").distinct()


def removed_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_copies, n_near, removed): for every document, how many lines with a word it has, how many of them occurred
    before, how many have an earlier near line, and the numbers of the lines that go (from 0, all lines counted)."""
    ready_to_checkpoint(docs.sparkSession)
    lines = line_places(docs).withColumn("id", F.xxhash64("line"))
    places = lines.select("doc", "no", "id").checkpoint()
    order = F.struct(F.col("doc").isNull().alias("last"), "doc", "no")
    by_line = places.groupBy("id").agg(F.min(order).alias("first"))
    pairs = near_pairs(lines, edits, least)
    placed = pairs.join(by_line.select(F.col("id").alias("a"), F.col("first").alias("a_first")), "a").join(by_line.select(F.col("id").alias("z"), F.col("first").alias("z_first")), "z")
    later = placed.select(F.greatest("a_first", "z_first").alias("first")).distinct().select("first.doc", "first.no", F.lit(True).alias("near"))
    seen = places.select("doc", "no", "id", order.alias("place"))
    copies = seen.join(by_line, "id").withColumn("copy", F.col("place") != F.col("first"))
    marked = copies.join(later, copies["doc"].eqNullSafe(later["doc"]) & (copies["no"] == later["no"]), "left").select(copies["doc"], copies["no"], "copy", F.coalesce("near", F.lit(False)).alias("near"))
    per_doc = marked.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("copy").alias("n_copies"), F.count_if(F.col("near") & ~F.col("copy")).alias("n_near"),
        F.array_sort(F.collect_list(F.when(F.col("copy") | F.col("near"), F.col("no")))).alias("removed"),
    )
    zero = F.lit(0).cast("long")
    ids = docs.select("doc_id").distinct()
    joined = ids.join(per_doc, ids["doc_id"].eqNullSafe(per_doc["doc"]), "left")
    return joined.select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
