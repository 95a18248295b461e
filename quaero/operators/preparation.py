"""Joins, sampling, splitting and features for training and evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators.spans import inside  # noqa: F401
from quaero.sources.shared import ready_to_checkpoint


def shuffled(key: Column, seed: int) -> Column:
    """A hash order that any engine with integer arithmetic repeats: (key * 48271 + seed * 69621) mod 2^31 - 1."""
    return (key * 48271 + seed * 69621) % 2147483647


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 0 in an order over the whole table: a range sort, one count for each task, and a running sum of those counts. No task sees more
    than its range; the sorted rows are kept in the shared checkpoint folder."""
    ready_to_checkpoint(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part, within = F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, within + F.col("__before")).drop("__at", "__part", "__before")


def first_part(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``rows`` with ``part`` 'a' for the first n in shuffled order, else 'b'; a top-n and a join, no global sort."""
    chosen = rows.select(key).orderBy(shuffled(F.col(key), seed), key).limit(n).withColumn("__a", F.lit(True))
    return rows.join(chosen, key, "left").withColumn("part", F.when(F.col("__a"), "a").otherwise("b")).drop("__a")


def k_folds(keys: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """(key, fold): equal runs of the shuffled keys, the last fold takes what is left over."""
    distinct = keys.select(key).distinct()
    size = distinct.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / k)).alias("size"))
    placed = numbered(distinct.withColumn("__shuffled", shuffled(F.col(key), seed)), [F.col("__shuffled"), F.col(key)], "n")
    return placed.crossJoin(F.broadcast(size)).select(key, F.least(F.floor(F.col("n") / F.col("size")), F.lit(k - 1)).cast("int").alias("fold"))


def negatives(rows: DataFrame, key: str, item: str, label: str, most: int, seed: int) -> DataFrame:
    """All positives, and of each key's negatives the first ``most`` in shuffled order."""
    w = Window.partitionBy(key, label).orderBy(shuffled(F.col(item), seed), item)
    return rows.withColumn("__n", F.row_number().over(w)).where((F.col(label) > 0) | (F.col("__n") <= most)).drop("__n")


def drawn_negatives(rows: DataFrame, key: str, item: str, label: str, most: int, seed: int, one_in: int = 10) -> DataFrame:
    """All positives, and of each key's negatives, in the order of items, those that are drawn with a chance of one in ``one_in``, ``most`` + 1 at the most. The draw is a hash of
    the item, so that reruns and other engines draw the same."""
    negative = F.coalesce(F.col(label) <= 0, F.lit(True))
    drawn = rows.where(negative & (shuffled(F.col(item), seed) % one_in == 0)).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(item)))
    return rows.where(~negative).unionByName(drawn.where(F.col("__n") <= most + 1).drop("__n"))


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, chances as weights: the least of exponential keys, made from the row's hash, so the partitioning does not matter. Equal rows
    share their luck."""
    chance = (F.pmod(F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in rows.columns)), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    return rows.orderBy(-F.log(chance) / F.col(weight)).limit(n)


def split_by_lists(rows: DataFrame, key: str, lists: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows of each list by white-space-free key, and ``rest``."""
    keyed = rows.withColumn("__key", T.strip_ws(F.col(key)))
    out, rest = {}, keyed
    for name, wanted in lists.items():
        w = wanted.select(T.strip_ws(F.col(key)).alias("__key")).distinct()
        out[name] = keyed.join(w, "__key", "left_semi").drop("__key")
        rest = rest.join(w, "__key", "left_anti")
    return out | {"rest": rest.drop("__key")}


def join_on_text(ranks: DataFrame, questions: DataFrame, column: str = "question") -> DataFrame:
    """Inner join on texts without white space; of equal keys the first question by id."""
    first = questions.withColumn("__key", T.strip_ws(F.col(column))).groupBy("__key").agg(F.min_by("id", "id").alias("id"), F.min_by("type", "id").alias("type"))
    return ranks.withColumn("__key", T.strip_ws(F.col(column))).dropDuplicates(["__key"]).join(first, "__key").drop("__key")


def join_or_prefix(keys: DataFrame, questions: DataFrame) -> DataFrame:
    """(key, id): questions with an equal key, else of those that start with it the one of least id.

    A question that starts with a key is equal to it if it is cut to the key's length: each question is cut to the lengths that keys have (no more than the longest has characters), the
    least id of each cut is found in the tasks, and cuts meet keys by equality.
    """
    ready_to_checkpoint(keys.sparkSession)
    k = keys.select("key", F.lower(T.strip_ws(F.col("key"))).alias("short")).checkpoint()
    longest = k.agg(F.max(F.length("short"))).first()[0] or 0
    # No key reaches beyond the longest one, so a question's text is read once and only its head, one character longer, is kept.
    q = questions.select("id", F.left(F.lower(T.strip_ws(F.col("question"))), F.lit(longest + 1)).alias("full")).checkpoint()
    exact = k.join(q, F.col("short") == F.col("full"))
    rest = k.join(exact.select("short").distinct(), "short", "left_anti").checkpoint()
    lengths = sorted(r[0] for r in rest.select(F.length("short").alias("n")).where("n is not null").distinct().collect())
    at = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("full"))
    heads = q.groupBy("full").agg(F.min("id").alias("id"))
    cuts = heads.select("id", F.explode(F.transform(at, lambda n: F.left("full", n))).alias("short")).groupBy("short").agg(F.min("id").alias("id"))
    return exact.select("key", "id").unionByName(rest.join(cuts, "short").select("key", "id"))


def ordered_pairs(rows: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """(key, a, z, label): all ordered pairs of different items of a key, 1 where a has the greater value; items of a key are few (a question's words)."""
    a = rows.select(key, F.col(item).alias("a"), F.col(value).alias("va"))
    z = rows.select(key, F.col(item).alias("z"), F.col(value).alias("vz"))
    return a.join(z, key).where("a <> z and va <> vz").select(key, "a", "z", F.when(F.col("va") > F.col("vz"), 1).otherwise(0).alias("label"))


def consecutive_runs(rows: DataFrame, partition: str, order: str, key: str) -> DataFrame:
    """(partition, run, key, first, n): runs of equal neighbouring keys."""
    w = Window.partitionBy(partition).orderBy(order)
    turned = rows.withColumn("__new", F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = turned.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(partition, "run", key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))


def zipped(rows: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of one row side by side, one row for each position."""
    return rows.select("*", F.posexplode(F.arrays_zip(*arrays)).alias("pos", "pair"))


def containing_parts(parts: DataFrame) -> DataFrame:
    """(question, part, other): parts one of whose terms contains a term of another part of the question."""
    a, b = parts.alias("a"), parts.alias("b")
    return a.join(b, "question").where((F.col("a.part") != F.col("b.part")) & F.contains(F.lower("a.term"), F.lower("b.term"))).select("question", F.col("a.part").alias("part"), F.col("b.part").alias("other")).distinct()


def word_vectors(tokens: DataFrame, vocabulary: DataFrame, vectors: DataFrame) -> DataFrame:
    """Tokens with weight and vector; those that lack either are dropped."""
    return tokens.withColumn("term", F.translate("token", "_", " ")).join(vocabulary.select("term", "weight"), "term").join(vectors.select(F.col("term").alias("token"), "embedding"), "token")


def concat_features(words: DataFrame, size: int, dim: int) -> DataFrame:
    """(id, features): the vectors of the first ``size`` words, one after another, filled up with zeros; unknown words are zeros."""
    vector = F.coalesce(F.transform("embedding", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), dim))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", vector.alias("v")))), lambda x: x["v"])
    filled = F.concat(F.flatten(ordered), F.array_repeat(F.lit(0.0), size * dim))
    return words.where(F.col("pos") < size).groupBy("id").agg(F.slice(filled, 1, size * dim).alias("features"))


def embedding_vocabulary(tokens: DataFrame, most: int) -> DataFrame:
    """(term, id): the most frequent words, ids from 1 by falling frequency; 0 is for all others."""
    top = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(most)
    return top.select("term", F.row_number().over(Window.orderBy(F.desc("n"), "term")).alias("id"))


def pair_input(question: Column, sentence: Column, most: int = 64) -> Column:
    """``[CLS] a [SEP] b [SEP]`` with the longer side cut a word at a time, padded to ``most``."""
    a, b, room = T.ws_tokens(question), T.ws_tokens(sentence), most - 3
    na, nb = F.size(a), F.size(b)
    half, other = (room + 1) // 2, room // 2
    ka = F.when(na + nb <= room, na).when(nb <= other, F.lit(room) - nb).when(na <= half, na).otherwise(half)
    kb = F.when(na + nb <= room, nb).when(nb <= other, nb).when(na <= half, F.lit(room) - na).otherwise(other)
    whole = F.concat(F.array(F.lit("[CLS]")), F.slice(a, F.lit(1), ka), F.array(F.lit("[SEP]")), F.slice(b, F.lit(1), kb), F.array(F.lit("[SEP]")))
    return F.slice(F.concat(whole, F.array_repeat(F.lit("[PAD]"), most)), 1, most)


def all_unique(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg((F.count(key) == F.count_distinct(key)).alias("unique"))
