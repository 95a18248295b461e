"""Benchmark decontamination with a positional inverted index.

The index holds postings (document, position) of training tokens. A benchmark item of n words is searched as its windows of 13; each
window is looked for by its rarest words, by their number of postings. The lists of those words, each moved back by
the word's place in the item, are intersected: what is left are alignments of an item with a document, found without
looking at common words. Alignments are then compared word by word along their diagonal, which gives all exact windows.

The only sides that are broadcast belong to the benchmark, and only below a checked number of words; beyond it the same joins
run as shuffles. Postings are made by one generator inside whole-stage code, and only those of searched words leave their
task. Everything is DataFrame expressions.

Defined results: A-Z is lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null texts have no words; items
without words match nothing; items with equal words are found together; a null item id counts as the empty string; rows of
``documents`` that share an id are searched together and judged each on its own words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 13
#: Rarest words of each window whose lists are intersected.
RAREST = 3
#: Benchmark words up to which its tables are broadcast.
BROADCAST_WORDS = 200_000
#: Stands for a null id in joins.
NO_ID = -(1 << 63) + 1


def search_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _id(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def postings(docs: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """The index of the given words, with the columns of ``terms``: (doc, pos, term, ...)."""
    every = docs.select(_id(F.col("doc_id")).alias("doc"), F.posexplode(search_words(F.col("text"))).alias("pos", "term"))
    return every.join(F.broadcast(terms) if small else terms, "term")


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, words, ids): one row for each distinct sequence of words, which is its key."""
    worded = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), search_words(F.col("text")).alias("words"))
    grouped = worded.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("item_id").alias("ids"))
    return grouped.select(F.sha2(F.array_join("words", " "), 256).alias("item"), "words", "ids")


def searched_windows(items: DataFrame, frequency: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(item, windows): for each window that can occur, the places in the item of its rarest words."""
    each = items.select("item", F.posexplode("words").alias("place", "term")).join(frequency, "term", "left")
    known = each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("known"))
    size = F.least(F.lit(window), F.size("known"))
    rare = F.transform(
        F.sequence(F.lit(0), F.size("known") - size),
        lambda s: F.slice(F.array_sort(F.transform(F.slice("known", s + 1, size), lambda w: F.struct(w["n"].alias("n"), w["term"].alias("term"), w["place"].alias("place")))), 1, rarest),
    )
    found = F.filter(rare, lambda w: F.get(w, F.lit(0))["n"] > 0)
    return known.select("item", F.transform(found, lambda w: F.transform(w, lambda x: x["place"])).alias("windows"))


def alignments(docs: DataFrame, items: DataFrame, small: bool, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(doc, item, shift): the item's word 0 would stand at word ``shift`` of the document, and the rarest words of a window agree."""
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    frequency = postings(docs, vocabulary, small).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    windows = searched_windows(items, frequency, window, rarest).cache()
    places = windows.select("item", F.explode(F.array_distinct(F.flatten("windows"))).alias("place"))
    anchors = places.join(items, "item").select(F.get("words", F.col("place")).alias("term"), F.struct("item", "place").alias("at"))
    anchors = anchors.groupBy("term").agg(F.collect_list("at").alias("at"))
    hits = postings(docs, anchors, small).select("doc", "pos", F.explode("at").alias("at"))
    lists = hits.groupBy("doc", F.col("at.item").alias("item"), (F.col("pos") - F.col("at.place")).alias("shift")).agg(F.collect_set("at.place").alias("found"))
    checked = lists.join(F.broadcast(windows) if small else windows, "item")
    return checked.where(F.exists("windows", lambda w: F.size(F.array_except(w, "found")) == 0)).select("doc", "item", "shift")


def exact_windows(words: Column, item: Column, shift: Column, window: int = WINDOW) -> Column:
    """Positions in ``words`` where a window of the item stands at this shift."""
    size = F.least(F.lit(window), F.size(item))
    starts = F.sequence(F.lit(0), F.size(item) - size)
    same = lambda s: (shift + s >= 0) & (F.slice(words, F.greatest(shift + s + 1, F.lit(1)), size) == F.slice(item, s + 1, size))
    return F.transform(F.filter(starts, same), lambda s: F.struct((shift + s).alias("at"), size.alias("n")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """For every row: doc_id, n_words, n_hit, items (ids of items with windows in it), contaminated."""
    return _judged(docs.select("doc_id", "text"), docs, benchmark, window, percent)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    row = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = _judged(row, docs, benchmark, window, percent).where(~F.col("contaminated"))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _judged(rows: DataFrame, docs: DataFrame, benchmark: DataFrame, window: int, percent: int) -> DataFrame:
    items = items_of(benchmark).cache()
    small = (items.agg(F.sum(F.size("words")).alias("n")).first().n or 0) <= BROADCAST_WORDS
    found = alignments(docs.select("doc_id", "text"), items, small, window).join(F.broadcast(items) if small else items, "item")
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("shift", "words", "ids")).alias("found"))
    joined = rows.withColumn("doc", _id(F.col("doc_id"))).join(per_doc, "doc", "left").withColumn("found", F.coalesce("found", F.array().cast(per_doc.schema["found"].dataType)))
    worded = joined.select(*rows.columns, "found", search_words(F.col("text")).alias("words"))
    hits = F.filter(
        F.transform("found", lambda c: F.struct(exact_windows(F.col("words"), c["words"], c["shift"], window).alias("at"), c["ids"].alias("ids"))), lambda h: F.size(h["at"]) > 0
    )
    judged = worded.select(*(c for c in rows.columns if c != "text"), F.size("words").cast("long").alias("n_words"), F.inline(F.array(F.struct(hits.alias("hits")))))
    covered = F.aggregate(
        F.array_sort(F.flatten(F.transform("hits", lambda h: h["at"]))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, w: F.struct((acc["n"] + F.greatest(F.lit(0), w["at"] + w["n"] - F.greatest(acc["end"], w["at"]))).alias("n"), F.greatest(acc["end"], w["at"] + w["n"]).alias("end")),
        lambda acc: acc["n"],
    ).cast("long")
    items_found = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["ids"]))))
    counted = judged.select(*(c for c in judged.columns if c != "hits"), covered.alias("n_hit"), items_found.alias("items"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def proximity_matches(docs: DataFrame, terms: list[str], span: int) -> DataFrame:
    """(doc_id, start, end): all shortest stretches of at most ``span`` words that hold every term: none has another inside.

    At each posting, the last posting of every term so far gives the stretch that ends there; of those with one start, the shortest stays.
    """
    wanted = sorted(set(terms))
    index = postings(docs, docs.sparkSession.createDataFrame([(t,) for t in wanted], "term string"), True)
    so_far = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.last(F.when(F.col("term") == t, F.col("pos")), ignorenulls=True).over(so_far).alias(f"last{k}") for k, t in enumerate(wanted)]
    names = [f"last{k}" for k in range(len(wanted))]
    ends = index.select("doc", "pos", *last).dropna(subset=names)
    stretch = ends.select("doc", (F.array_min(F.array(*names))).alias("start"), F.col("pos").alias("end")).where(F.col("end") - F.col("start") < span)
    return stretch.groupBy("doc", "start").agg(F.min("end").alias("end")).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "start", "end")
