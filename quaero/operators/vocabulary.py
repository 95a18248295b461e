"""Term statistics over a corpus: frequencies, normalised inverse document frequencies, phrase weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions import text as T


#: Bytes of text whose n-grams one task counts before the shuffle: at most about 200 MB of memory.
PART = 1 << 24


def lower_words(x: Column) -> Column:
    """Search words of a text: runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def terms(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pos, term)."""
    return docs.select(key, F.posexplode(lower_words(F.col(column))).alias("pos", "term"))


def term_frequency(docs: DataFrame, column: str = "text") -> DataFrame:
    """(term, freq)."""
    return docs.select(F.explode(lower_words(F.col(column))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def document_frequency(docs: DataFrame, column: str = "text") -> DataFrame:
    """(term, df): distinct inside the row before the shuffle, so one row per document and term leaves a task, counted map-side."""
    return docs.select(F.explode(F.array_distinct(lower_words(F.col(column)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_weights(frequencies: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, weight): -ln(df / n) over its largest value; not clamped."""
    idf = -F.log(F.col("df") / F.lit(float(n_docs)))
    valued = frequencies.withColumn("idf", idf)
    top = valued.agg(F.max("idf").alias("top"))
    return valued.crossJoin(F.broadcast(top)).select("term", "df", F.when(F.col("top") != 0, F.col("idf") / F.col("top")).otherwise(F.lit(0.0)).alias("weight"))


def phrases_of(vocabulary: DataFrame) -> DataFrame:
    """Terms of several words."""
    return vocabulary.where(F.instr("term", " ") > 0)


def in_parts(docs: DataFrame, column: str, part: int) -> DataFrame:
    """``docs`` dealt by a hash of their plain columns into as many tasks as have about ``part`` bytes of text each, however large the files' row groups are."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    plain = [F.col(f"`{name}`") for name, kind in docs.dtypes if "<" not in kind and kind != "variant"]
    return docs.repartition(size // part + 1, F.xxhash64(*plain))


def ngram_counts(docs: DataFrame, n: int, at_least: int, column: str = "text") -> DataFrame:
    """(ngram, freq) of frequent n-grams without a stop word.

    A task counts before the shuffle and holds an entry for each n-gram of its text, most of which occur once, so texts are dealt into parts of bounded
    size first. Stop words are told by word where n-grams are made, not searched in each n-gram.
    """
    words = in_parts(docs, column, PART).select(lower_words(F.col(column)).alias("words"))
    starts = F.greatest(F.size("words") - n + 1, F.lit(0))
    names = [f"w{k}" for k in range(n)]
    grams = words.select(F.inline(F.arrays_zip(*(F.slice("words", k + 1, starts) for k in range(n)))).alias(*names))
    for name in names:
        grams = grams.where(~F.col(name).isin(*T.STOP_WORDS))
    return grams.groupBy(F.concat_ws(" ", *names).alias("ngram")).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= at_least)


def threshold_ngrams(ngrams: DataFrame, at_least: float, score: str = "freq") -> DataFrame:
    """n-grams with a score of ``at_least``, without ``_`` and without a stop word."""
    stop = F.array(*map(F.lit, T.STOP_WORDS))
    return ngrams.where((F.col(score) >= at_least) & ~F.contains("ngram", F.lit("_")) & ~F.arrays_overlap(F.split("ngram", " "), stop))


def phrase_weights(phrases: DataFrame, sentences: DataFrame, vocabulary: DataFrame, key: str | None = None) -> DataFrame:
    """(phrase, tf, idf, factor) for phrases of a question: ``factor`` is ln(1 + tf) * idf.

    tf counts word-bounded matches over all sentences, once more for each time the phrase is listed; idf is the phrase's weight, else the
    mean of its tokens' (unknown ones are 0). Phrases come as a small table, sentences as a large one: each task counts its own sentences.
    With ``key``, phrases and sentences belong to it (a question) and are counted with each other only; it is the first column.
    """
    keys = [key] if key else []
    listed = phrases.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("times"))
    met = sentences.join(listed, key) if key else sentences.crossJoin(F.broadcast(listed))
    hits = met.select(*keys, "phrase", "times", F.regexp_count(F.lower("sentence"), F.concat(F.lit(r"\b\Q"), F.lower("phrase"), F.lit(r"\E\b"))).alias("n"))
    tf = hits.groupBy(*keys, "phrase", "times").agg(F.sum("n").alias("n")).select(*keys, "phrase", (F.col("n") * F.col("times")).alias("tf"))
    once = listed.select("phrase").distinct()
    own = once.join(vocabulary.select(F.col("term").alias("phrase"), "weight"), "phrase", "left")
    each = once.select("phrase", F.explode(F.split("phrase", " ")).alias("term")).join(vocabulary.select("term", F.col("weight").alias("w")), "term", "left")
    mean = each.groupBy("phrase").agg(F.avg(F.coalesce("w", F.lit(0.0))).alias("mean"))
    idf = F.coalesce("weight", "mean")
    return tf.join(own, "phrase").join(mean, "phrase").select(*keys, "phrase", "tf", idf.alias("idf"), F.when(idf > 0, F.log(1 + F.col("tf")) * idf).otherwise(F.lit(0.0)).alias("factor"))


def describe_lengths(rows: DataFrame, column: str) -> DataFrame:
    """(longest, mean, deviation) of the word counts of a text column; the deviation is the population's."""
    n = F.size(lower_words(F.col(column)))
    return rows.agg(F.max(n).alias("longest"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("deviation"))


def part_weights(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(question, part, weight) for query parts given as (question, part, term, hyphen).

    A word weighs its idf or 1. A phrase weighs its idf; else, made from a hyphenated word, that word's or 1; else the least of its known tokens', 1 at
    most. A part weighs the mean of its terms, and all parts of a question are divided by the least.
    """
    weights = vocabulary.select("term", "weight")
    own = parts.join(weights, "term", "left").withColumnRenamed("weight", "own")
    own = own.join(weights.select(F.col("term").alias("hyphen"), F.col("weight").alias("hyphened")), "hyphen", "left")
    tokens = own.select("question", "part", "term", F.explode(F.split("term", " ")).alias("token")).join(weights.withColumnRenamed("term", "token"), "token", "left")
    least = tokens.groupBy("question", "part", "term").agg(F.min("weight").alias("least"))
    worth = (
        F.when(F.col("own").isNotNull(), F.col("own")).when(F.instr("term", " ") == 0, 1.0)
        .when(F.col("hyphen").isNotNull(), F.coalesce("hyphened", F.lit(1.0))).otherwise(F.least(F.lit(1.0), F.coalesce("least", F.lit(1.0))))
    )
    per_part = own.join(least, ["question", "part", "term"], "left").groupBy("question", "part").agg(F.avg(worth).alias("raw"))
    return per_part.select("question", "part", (F.col("raw") / F.min("raw").over(Window.partitionBy("question"))).alias("weight"))


def boosted(weight: Column, is_keyword: Column, factor: float = 2.0) -> Column:
    return F.when(is_keyword, weight * factor).otherwise(weight / factor)
