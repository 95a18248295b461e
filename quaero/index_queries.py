"""Registered queries of stored indexes and of operators over many phrases or pairs, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators import index as IX
from quaero.operators import neighbours as N
from quaero.operators import pairwise as PW
from quaero.operators import phrases as PH
from quaero.operators import preparation as P
from quaero.operators import ranking as R
from quaero.operators import vocabulary as VOC
from quaero.queries import EVERY, WORDS, query, table
from quaero.round_trips import scratch
from quaero.sources.shared import ready_to_checkpoint


def _index(spark: SparkSession, sf_dir: str) -> str:
    IX.write_index(table(spark, sf_dir, "documents"), path := scratch(spark))
    return path


@query(f"""SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS n FROM (SELECT doc_id, {WORDS} AS w FROM documents)
WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0""")
def index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase, from the stored positional index."""
    return IX.documents_with_phrase(spark, _index(spark, sf_dir), "of the")


@query(f"SELECT doc_id FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE list_has_all(w, ['the', 'with', 'that'])")
def index_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IX.documents_with_all(spark, _index(spark, sf_dir), ["the", "with", "that"])


_WEIGHTS = {"the": 0.25, "with": 0.5, "que": 0.75, "und": 1.0}


@query(f"""WITH t AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) WHERE term IN {tuple(_WEIGHTS)} GROUP BY ALL),
s AS (SELECT doc_id, round(sum(tf / (tf + 1.2) * CASE term {' '.join(f"WHEN '{t}' THEN {w}" for t, w in _WEIGHTS.items())} END), 9) AS score FROM t GROUP BY doc_id)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 100""")
def index_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best documents by summed contributions, blocks that cannot hold one left out."""
    return IX.top_documents(spark, _index(spark, sf_dir), _WEIGHTS, 100)


@query(f"""WITH b AS (SELECT {WORDS} AS w FROM benchmark), p AS (SELECT DISTINCT array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, (VALUES (2), (3)) v(k) WHERE len(w) >= k)),
d AS (SELECT doc_id, {WORDS} AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (2), (3)) v(k) WHERE len(w) >= k))
SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g SEMI JOIN p USING (phrase) GROUP BY phrase""")
def phrase_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of two or three words of a benchmark text, counted in all documents by one automaton."""
    words = table(spark, sf_dir, "benchmark").select(VOC.lower_words(F.col("text")).alias("w"))
    phrases = words.select(F.explode(F.array_union(T.ngrams(F.col("w"), 2), T.ngrams(F.col("w"), 3))).alias("phrase")).distinct()
    found = PH.occurrences(table(spark, sf_dir, "documents"), phrases)
    return found.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT count(*) AS probes, true AS recall_is_high, true AS few_compared FROM embeddings WHERE vec_id % 100 = 0")
def knn_inverted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours of the probes among all vectors: whether nine tenths of the exact ten are found, and whether under half of the vectors met a probe with all their numbers."""
    e = table(spark, sf_dir, "embeddings")
    probes = e.where(F.col("vec_id") % EVERY == 0)
    quantiser = N.fit(e)
    ready_to_checkpoint(spark)
    indexed = N.index(e, quantiser).checkpoint()
    lists, again = N.tuned(indexed, e, quantiser)
    found = N.search(indexed, e, probes, quantiser, lists=lists, again=again)
    reached = N.recall(found, R.top_similar(e, probes)) >= 0.9
    few = 2 * 10 * again < indexed.count()
    return probes.agg(F.count(F.lit(1)).alias("probes")).select("probes", F.lit(reached).alias("recall_is_high"), F.lit(few).alias("few_compared"))


@query("""WITH q AS (SELECT doc_id AS id, regexp_replace(lower(text), '\\s+', '', 'g') AS full_text FROM documents WHERE length(text) > 0), k AS (SELECT doc_id AS key, left(full_text, 10 + key % 40) AS short FROM (SELECT id AS doc_id, id AS key, full_text FROM q)),
e AS (SELECT key, id FROM k JOIN q ON short = full_text), r AS (SELECT k.key, min(id) AS id FROM k JOIN q ON starts_with(full_text, short) WHERE short NOT IN (SELECT full_text FROM q) GROUP BY k.key)
SELECT key, id FROM e UNION ALL SELECT key, id FROM r""")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of every document against all documents."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    keys = d.select(F.col("doc_id").alias("id"), F.expr("left(regexp_replace(lower(text), '\\\\s+', ''), cast(10 + doc_id % 40 as int))").alias("key"))
    found = P.join_or_prefix(keys.select("key").distinct(), d.select(F.col("doc_id").alias("id"), F.col("text").alias("question")))
    return keys.withColumnRenamed("id", "of").join(found, "key").select(F.col("of").alias("key"), "id")


@query("""WITH r AS (SELECT doc_id, quality, doc_id % 20 AS q, (doc_id * 48271 + 5 * 69621) % 2147483647 AS h FROM labels), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY doc_id) AS n FROM r WHERE quality = 0 AND h % 10 = 0)
SELECT doc_id, quality FROM r WHERE quality > 0 UNION ALL SELECT doc_id, quality FROM n WHERE n <= 6""")
def neg_sample_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("q", F.col("doc_id") % 20)
    return P.drawn_negatives(rows, "q", "doc_id", "quality", 5, 5).select("doc_id", "quality")


@query(f"""WITH d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({WORDS})) AS term FROM documents) GROUP BY term),
w AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark)), j AS (SELECT item_id, term, df FROM w JOIN d USING (term))
SELECT count(*) AS pairs, true AS accurate FROM j a JOIN j b ON a.item_id = b.item_id WHERE a.term <> b.term AND a.df <> b.df AND a.item_id % 5 = 0""")
def pair_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network learns from four fifths of the questions which of two of their words is the commoner one, by their spelling; whether it orders four fifths of the other questions' pairs."""
    ready_to_checkpoint(spark)
    frequency = VOC.document_frequency(table(spark, sf_dir, "documents"))
    words = VOC.terms(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "term").distinct().join(frequency, "term").checkpoint()
    vowels = F.length("term") - F.length(F.regexp_replace("term", "[aeiou]", ""))
    spelling = words.select("term", F.array(F.length("term") / 8, vowels / F.length("term"), F.ascii("term") / 100, (F.length("term") <= 4).cast("double")).alias("vector")).distinct()
    pairs = P.ordered_pairs(words, "item_id", "term", "df")
    pairs = pairs.join(spelling.select(F.col("term").alias("a"), F.col("vector").alias("va")), "a").join(spelling.select(F.col("term").alias("z"), F.col("vector").alias("vz")), "z").checkpoint()
    tower = PW.fit(pairs.where("item_id % 5 > 0"), 4, rounds=30)
    right = (PW.score(F.col("va"), tower) > PW.score(F.col("vz"), tower)) == (F.col("label") > 0)
    return pairs.where("item_id % 5 = 0").agg(F.count(F.lit(1)).alias("pairs"), (F.avg(right.cast("double")) >= 0.8).alias("accurate"))
