"""Registered queries of the question-answering operators on the driver's tables, each beside the SQL that gives the same rows.

``documents`` stand for abstracts, ``benchmark`` for questions, ``embeddings`` for term vectors and ``labels`` for relevance. The tables have no term vectors, so the term of rank r
(by falling document frequency, then by name) is given the vector r mod n: that exercises the operators and means nothing as language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions import vectors as V
from quaero.operators import answers as A
from quaero.operators import entities as E
from quaero.operators import metrics as M
from quaero.operators import preparation as P
from quaero.operators import questions as Q
from quaero.operators import ranking as R
from quaero.operators import search as S
from quaero.operators import vocabulary as VOC
from quaero.plans.batch import SharedVectors, all_sentence_scores, ask_all, best_sentences
from quaero.plans.query import Part, Query, Term

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Probes and questions of a search over all rows: every id divisible by it.
EVERY = 100


def _every(id_column: str) -> Column:
    return F.col(id_column) % EVERY == 0


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"
SENTENCES = r"""s AS (SELECT doc_id, i - 1 AS sid, regexp_replace(p[i], '^\s+|\s+$', '', 'g') AS raw FROM
  (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.?!]+[.?!]?') AS p FROM documents))),
sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS sid, raw AS sentence FROM s WHERE raw <> '')"""


# Text and vocabulary --------------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct({WORDS})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM t GROUP BY term),
n AS (SELECT count(*) AS n FROM documents), i AS (SELECT term, df, -ln(df / n.n::DOUBLE) AS idf FROM d, n)
SELECT term, df, round(idf / max(idf) OVER (), 6) AS weight FROM i""")
def idf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return VOC.idf_weights(VOC.document_frequency(docs), docs.count()).withColumn("weight", F.round("weight", 6))


@query(f"SELECT term, count(*) AS freq FROM (SELECT unnest({WORDS}) AS term FROM documents) GROUP BY term")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VOC.term_frequency(table(spark, sf_dir, "documents"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (NOT regexp_matches(w, '[\p{L}\p{Nd}]')) AS n_special, count(*) FILTER (regexp_matches(w, '^\p{Lu}+$')) AS n_capital,
count(*) FILTER (regexp_matches(w, '^\p{L}+$')) AS n_letters, count(*) FILTER (regexp_matches(w, '\p{Nd}')) AS n_numbers FROM t GROUP BY doc_id""")
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\f\r]+"), F.lit(0))).alias("w"))
    w = F.col("w")
    tests = {"n_special": T.is_all_special(w), "n_capital": T.is_all_capital(w), "n_letters": T.is_all_letters(w), "n_numbers": T.has_numbers(w)}
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), *(F.count_if(c).alias(n) for n, c in tests.items()))


@query(f"WITH {SENTENCES} SELECT doc_id, sid, sentence FROM sentences")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.split_documents(table(spark, sf_dir, "documents")).withColumn("sid", F.col("sid").cast("long"))


@query(rf"""WITH {SENTENCES}, k AS (SELECT *, regexp_replace(sentence, '\s+', '', 'g') AS key, (doc_id * 31 + sid * 17) % 101 AS score FROM sentences),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id, sid) AS n FROM k) SELECT doc_id, sid, sentence, score FROM r WHERE n = 1 AND length(sentence) >= 40""")
def dedup_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sentence_split(spark, sf_dir).withColumn("score", (F.col("doc_id") * 31 + F.col("sid") * 17) % 101)
    return A.deduplicated(s)


# Fixed values, written out here too, so that the SQL does not take them from the code that it checks.
_STOP = """string_split(replace('a able about across after all almost also am among an and any are as at be because been but by can cannot could dear
did do does either else ever every for from get got had has have he her hers him his how however i if in into is it
its just least let like likely may me might most must my neither no nor not of off often on only or other our own
rather said say says she should since so some than that the their them then there these they this tis to too twas us
wants was we were what when where which while who whom why will with would yet you your', chr(10), ' '), ' ')"""


@query(f"""WITH w AS (SELECT {WORDS} AS p FROM documents), g AS (SELECT p[i] || ' ' || p[i + 1] AS ngram, p[i] AS a, p[i + 1] AS b FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM w WHERE len(p) > 1))
SELECT ngram, count(*) AS freq FROM g WHERE NOT list_contains({_STOP}, a) AND NOT list_contains({_STOP}, b) GROUP BY ngram HAVING count(*) >= 3""")
def ngram_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VOC.ngram_counts(table(spark, sf_dir, "documents"), 2, 3)


@query(f"""WITH w AS (SELECT item_id, {WORDS} AS p FROM benchmark), l AS (SELECT item_id, p, len(p) AS n FROM w)
SELECT item_id, array_to_string(p[2:], ' ') AS first_suffix, array_to_string(p[:n - 1], ' ') AS first_prefix, n::INT AS n_tokens FROM l WHERE n > 2""")
def phrase_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select("item_id", VOC.lower_words(F.col("text")).alias("p")).where(F.size("p") > 2)
    return w.select("item_id", F.get(T.suffixes(F.col("p"), 2), F.lit(0)).alias("first_suffix"), F.get(T.prefixes(F.col("p"), 2), F.lit(0)).alias("first_prefix"), F.size("p").alias("n_tokens"))


@query(r"""SELECT max(n)::INT AS longest, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM (SELECT len(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS n FROM documents)""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VOC.describe_lengths(table(spark, sf_dir, "documents"), "text").select("longest", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(r"""SELECT user_id, event_type, props IS NOT NULL AS has_props, try_cast(round(value, 0) AS BIGINT) AS n, CASE WHEN value >= 0 THEN 'pos' ELSE 'neg' END AS sign,
length(event_type) - length(replace(event_type, 'e', '')) AS n_e FROM events""")
def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = T.to_number(F.round("value", 0).cast("string"), "double", 0.0).cast("long")
    return e.select("user_id", "event_type", F.col("props").isNotNull().alias("has_props"), n.alias("n"), F.when(F.col("value") >= 0, "pos").otherwise("neg").alias("sign"), T.count_char(F.col("event_type"), "e").cast("long").alias("n_e"))


_PHRASES = ("the of", "of the", "and the", "to the")


@query(rf"""WITH {SENTENCES}, p AS (SELECT unnest({list(_PHRASES)}) AS phrase), v AS ({ORACLE_SQL['idf_vocab']}),
tf AS (SELECT phrase, sum(len(regexp_extract_all(lower(sentence), '\b' || phrase || '\b'))) AS tf FROM p, sentences GROUP BY phrase),
i AS (SELECT phrase, avg(coalesce(weight, 0)) AS idf FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS term FROM p) LEFT JOIN v USING (term) GROUP BY phrase)
SELECT phrase, tf::BIGINT AS tf, round(idf, 5) AS idf, round(ln(1 + tf) * idf, 4) AS factor FROM tf JOIN i USING (phrase)""")
def tfidf_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = spark.createDataFrame([(p,) for p in _PHRASES], "phrase string")
    found = VOC.phrase_weights(phrases, sentence_split(spark, sf_dir), idf_vocab(spark, sf_dir))
    return found.select("phrase", "tf", F.round("idf", 5).alias("idf"), F.round("factor", 4).alias("factor"))


# Search ---------------------------------------------------------------------------------------------------------------

_TERMS = ("the", "and", "tion")


def _query(*terms: str, phrase: bool = False) -> Query:
    return Query.of(Part((Term(t, phrase=phrase),)) for t in terms)


def _rx(term: str) -> str:
    body = r"[^\p{L}\p{Nd}]+".join(term.split())
    return rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{Nd}}]){body}($|[^\p{{L}}\p{{Nd}}])')"


@query(f"SELECT doc_id FROM documents WHERE {' AND '.join(map(_rx, ('the', 'and')))} ORDER BY doc_id LIMIT 2000")
def bool_search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(table(spark, sf_dir, "documents"), _query("the", "and")).select("doc_id")


@query(f"SELECT doc_id, n::DOUBLE AS score FROM (SELECT doc_id, {' + '.join(f'{_rx(t)}::INT' for t in ('the', 'und', 'que'))} AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 2000")
def bool_search_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(table(spark, sf_dir, "documents"), _query("the", "und", "que"), connective="OR").select("doc_id", "score")


@query(f"SELECT doc_id FROM documents WHERE {_rx('of the')} ORDER BY doc_id LIMIT 2000")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search(table(spark, sf_dir, "documents"), _query("of the", phrase=True)).select("doc_id")


@query(f"SELECT count(*) AS n FROM documents WHERE {' AND '.join(map(_rx, ('the', 'that')))}")
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.searchable(table(spark, sf_dir, "documents"))
    return docs.agg(F.count_if(_query("the", "that").predicate(F.col("__lower"))).alias("n"))


@query(f"""WITH p AS (SELECT doc_id, unnest(list_distinct({WORDS})) AS term FROM documents) SELECT doc_id FROM p WHERE term IN ('the', 'with') GROUP BY doc_id HAVING count(*) = 2""")
def postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_postings(S.postings(table(spark, sf_dir, "documents")), ["the", "with"])


_LADDER = ("the", "with", "tion", "zzzz")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS rung, {len(_LADDER) - k} AS n_terms, count(*) FILTER ({' AND '.join(map(_rx, _LADDER[:len(_LADDER) - k]))}) AS n FROM documents" for k in range(len(_LADDER))) + ")")
def relax_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.searchable(table(spark, sf_dir, "documents"))
    rungs = list(_query(*_LADDER).ladder())
    counted = docs.agg(F.array(*(F.struct(F.lit(k).alias("rung"), F.lit(q.n_terms).alias("n_terms"), F.count_if(q.predicate(F.col("__lower"))).alias("n")) for k, q in enumerate(rungs))).alias("r"))
    return counted.select(F.inline("r"))


@query(f"""WITH a AS (SELECT doc_id, 0 AS src, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE {_rx('the')} AND {_rx('with')} ORDER BY doc_id LIMIT 50),
b AS (SELECT doc_id, 1 AS src, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE {_rx('que')} ORDER BY doc_id LIMIT 50),
f AS (SELECT doc_id, min((src, rank)) AS place FROM (FROM a UNION ALL FROM b) GROUP BY doc_id) SELECT doc_id, row_number() OVER (ORDER BY place, doc_id)::INT AS rank FROM f""")
def ensemble_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return S.ordered_union([S.ranked(S.search(docs, _query("the", "with"), 50)), S.ranked(S.search(docs, _query("que"), 50))])


@query("SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0")
def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 0")).select("doc_id", "quality")


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def append_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.append_new(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"))


# Vectors --------------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH c AS (SELECT a.vec_id AS probe, b.vec_id, round({_COS}, 6) AS cos FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY cos DESC, vec_id)::INT AS rank FROM c) SELECT probe, vec_id, cos, rank FROM r WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.top_similar(e, e.where(_every("vec_id")))


@query(f"""WITH c AS (SELECT a.vec_id AS probe, a.label AS own, b.vec_id, b.label, round({_COS}, 6) AS cos FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY cos DESC, vec_id) AS rank FROM c), v AS (SELECT probe, own, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY n DESC, label) AS k FROM v) SELECT probe, own, label AS voted, n FROM b WHERE k = 1""")
def knn_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that each vector's five nearest ones have most often: every vector is a probe."""
    e = table(spark, sf_dir, "embeddings")
    return _voted(e, e)


def _voted(e: DataFrame, probes: DataFrame) -> DataFrame:
    near = R.top_similar(e, probes, 5).join(e.select("vec_id", "label"), "vec_id")
    votes = near.groupBy("probe", "label").agg(F.count(F.lit(1)).alias("n"))
    return A.best_by(votes, ["probe"], "n", "label").join(e.select(F.col("vec_id").alias("probe"), F.col("label").alias("own")), "probe").select("probe", "own", F.col("label").alias("voted"), "n")


@query("SELECT dim - 1 AS dim, min(x) AS low, max(x) AS high FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY dim")
def dim_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dimension_ranges(table(spark, sf_dir, "embeddings")).withColumn("dim", F.col("dim").cast("long"))


_BITS = """x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), r AS (SELECT dim, min(x) AS low, max(x) AS high FROM x GROUP BY dim),
b AS (SELECT vec_id, dim, greatest(0, ceil((x - low) / ((high - low) / 8)) - 1)::INT AS bin FROM x JOIN r USING (dim)), bits AS (SELECT vec_id, dim * 8 + bin AS bit FROM b WHERE bin < 8)"""


@query(f"WITH {_BITS} SELECT vec_id, count(*) AS n_bits, sum(bit)::BIGINT AS bit_sum FROM bits GROUP BY vec_id")
def bin_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.bit_sets(table(spark, sf_dir, "embeddings"), "vec_id", 8)
    return b.select("vec_id", F.size("bits").cast("long").alias("n_bits"), F.aggregate("bits", F.lit(0).cast("long"), lambda s, i: s + i).alias("bit_sum"))


#: For the whole Jaccard join: vectors in a block while there are few, blocks then, and most vectors in a block. A vector travels once for each block and once more.
BLOCK_ROWS, BLOCKS, MOST_ROWS = 2000, 8, 1 << 17


@query(f"""WITH {_BITS}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, count(*) AS both FROM bits a JOIN bits b USING (bit) WHERE a.vec_id < b.vec_id GROUP BY ALL),
n AS (SELECT vec_id, count(*) AS n FROM bits GROUP BY vec_id) SELECT p.a, p.b, round(p.both / (x.n + y.n - p.both)::DOUBLE, 6) AS jaccard FROM p JOIN n x ON x.vec_id = p.a JOIN n y ON y.vec_id = p.b""")
def jaccard_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors with a common bit: the vectors are dealt into blocks and every pair of blocks meets once."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    return V.jaccard_pairs(V.bit_sets(e, "vec_id", 8), "vec_id", max(min(n // BLOCK_ROWS + 1, BLOCKS), n // MOST_ROWS + 1))


@query("SELECT label, dim - 1 AS dim, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"])
    return c.select("label", F.posexplode("vector").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


_VECTORS = f"""d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({WORDS})) AS term FROM documents) GROUP BY term),
nd AS (SELECT count(*) AS n FROM documents), ne AS (SELECT count(*) AS n FROM embeddings), i AS (SELECT term, df, -ln(df / nd.n::DOUBLE) AS idf FROM d, nd), t AS (SELECT max(idf) AS top FROM i),
k AS (SELECT term, idf / top AS weight, (row_number() OVER (ORDER BY df DESC, term) - 1) % ne.n AS vec_id FROM i, t, ne ), v AS (SELECT term, weight, embedding::DOUBLE[] AS e FROM k JOIN embeddings USING (vec_id))"""


def term_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SharedVectors]:
    """(term, weight) and the vectors of all terms. The vocabulary is numbered and kept once; a vector joins only the terms that a query asks for."""
    docs, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    vocabulary = VOC.idf_weights(VOC.document_frequency(docs), docs.count())
    placed = P.numbered(vocabulary, [F.desc("df"), F.col("term")], "place").withColumn("vec_id", F.col("place") % e.count())
    return placed.select("term", "weight"), SharedVectors(placed.select("term", "vec_id", "place"), e.select("vec_id", "embedding"))


_RWMD = f"""WITH {SENTENCES}, {_VECTORS}, q AS (SELECT DISTINCT item_id AS qid, term FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark WHERE item_id % 100 = 0)),
w AS (SELECT DISTINCT doc_id, sid, term FROM (SELECT doc_id, sid, unnest({WORDS.replace('text', 'sentence')}) AS term FROM sentences)),
qv AS (SELECT qid, term, weight, e FROM q JOIN v USING (term)), wv AS (SELECT DISTINCT term, e FROM w JOIN v USING (term)),
c AS (SELECT qid, qv.term AS q, wv.term, list_cosine_similarity(qv.e, wv.e) AS cos FROM qv, wv), ss AS (SELECT qid, doc_id, sid FROM (SELECT DISTINCT qid FROM q), (SELECT DISTINCT doc_id, sid FROM w)),
m AS (SELECT qid, doc_id, sid, q, greatest(-1, max(cos)) AS m FROM w JOIN c USING (term) GROUP BY ALL), a AS (SELECT m.qid, doc_id, sid, sum(weight * m) AS above FROM m JOIN qv ON qv.qid = m.qid AND qv.term = m.q GROUP BY ALL),
b AS (SELECT qid, sum(weight) AS below FROM qv GROUP BY qid), r AS (SELECT ss.qid, ss.doc_id, ss.sid, CASE WHEN above > 0 AND below > 0 THEN above / below ELSE 0 END AS score FROM ss LEFT JOIN a USING (qid, doc_id, sid) LEFT JOIN b USING (qid))"""


@query(_RWMD + " SELECT qid, doc_id, sid, round(score::REAL::DOUBLE, 4) AS score FROM r")
def rwmd_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document for each question whose id is a multiple of ``EVERY``."""
    vocabulary, vectors = term_tables(spark, sf_dir)
    asked = VOC.terms(table(spark, sf_dir, "benchmark").where(_every("item_id")), "item_id").select(F.col("item_id").alias("qid"), "term")
    scored = all_sentence_scores(table(spark, sf_dir, "documents"), asked, vectors, vocabulary)
    return scored.select("qid", "doc_id", "sid", F.round(F.col("score").cast("double"), 4).alias("score"))


_RWMD_ALL = _RWMD.replace(" WHERE item_id % 100 = 0", "")


@query(_RWMD_ALL + """, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score::REAL::DOUBLE, 4) DESC, doc_id, sid)::INT AS rank FROM r) SELECT qid, doc_id, sid, rank FROM o WHERE rank <= 10""")
def rwmd_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all sentences for every question."""
    return _best_sentences(spark, sf_dir, table(spark, sf_dir, "benchmark"))


def _best_sentences(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    vocabulary, vectors = term_tables(spark, sf_dir)
    asked = VOC.terms(items, "item_id").select(F.col("item_id").alias("qid"), "term")
    found = best_sentences(table(spark, sf_dir, "documents"), asked, vectors, vocabulary, 10)
    return A.top_per_question(found, 10).select("qid", "doc_id", "sid", "rank")


@query(f"""WITH {_VECTORS}, q AS (SELECT item_id AS qid, unnest({WORDS}) AS term FROM benchmark), x AS (SELECT qid, weight, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM q JOIN v USING (term))
SELECT qid, dim, round(sum(weight * x), 4) AS x FROM x GROUP BY qid, dim""")
def tfidf_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, vectors = term_tables(spark, sf_dir)
    q = VOC.terms(table(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("qid"), "term")
    c = R.question_centroid(q, vectors.names.join(q.select("term").distinct(), "term").join(vectors.values, "vec_id").select("term", "embedding"), vocabulary)
    return c.select("qid", F.posexplode("vector").alias("dim", "x")).select("qid", F.col("dim").cast("long").alias("dim"), F.round("x", 4).alias("x"))


# Answers --------------------------------------------------------------------------------------------------------------


@query(rf"""WITH {SENTENCES} SELECT doc_id, sid FROM sentences WHERE contains(lower(sentence), 'the') AND (regexp_matches(sentence, '\s+such\s+as\s+the') OR regexp_matches(sentence, '\s+also\s+called\s+the')
OR regexp_matches(sentence, 'the\s*,\s*an?\s+\w+\s+') OR regexp_matches(sentence, 'the\s+are\s+\w+\s+') OR regexp_matches(substr(sentence, instr(lower(sentence), 'the') + 3), '^[^\p{{L}}\p{{Nd}}]*is[\s.]\s*\S'))""")
def definition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.definition_answers(sentence_split(spark, sf_dir), "the").select("doc_id", "sid")


#: A dictionary over words of the driver's invented languages.
DICTIONARY = (("the", "gene"), ("and", "protein"), ("und", "disease"), ("que", "drug"), ("of the", "disease"), ("tion", "organism"))
_DICT = "d(term, entity_type) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DICTIONARY) + ")"


@query(f"""WITH {_DICT}, w AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents) SELECT doc_id, entity_type, count(*) AS n, count(DISTINCT term) AS n_terms FROM w JOIN d USING (term) GROUP BY doc_id, entity_type""")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(DICTIONARY, "term string, entity_type string")
    words = VOC.terms(table(spark, sf_dir, "documents")).select("doc_id", "term")
    typed = E.typed(words.select("term").distinct(), known)
    return words.join(typed.where(F.size("types") > 0), "term").select("doc_id", "term", F.explode("types").alias("entity_type")).groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("term").alias("n_terms"))


@query()
def tagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(DICTIONARY, "term string, entity_type string")
    return E.tagged(sentence_split(spark, sf_dir), known).select("doc_id", "sid", F.inline("entities"))


@query("""WITH e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region)
SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT a.child, b.parent, 2 FROM e a JOIN e b ON a.parent = b.child""")
def isa_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    edges = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return E.ancestors(edges.unionByName(r.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent"))))


_FOCUS = f"""WITH {_DICT}, {SENTENCES}, w AS (SELECT DISTINCT doc_id, sid, unnest({WORDS.replace('text', 'sentence')}) AS term FROM sentences),
e AS (SELECT doc_id, sid, count(*) FILTER (term IN ('the', 'and')) AS shared, count(*) FILTER (term NOT IN ('the', 'and') AND entity_type IN ('disease', 'drug')) AS focus
FROM w JOIN d USING (term) GROUP BY doc_id, sid), f AS (SELECT doc_id, sid, 1 + shared / 2.0 AS focus_score FROM e WHERE focus >= 1)"""


def _focus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(DICTIONARY, "term string, entity_type string")
    s = sentence_split(spark, sf_dir)
    words = s.select("doc_id", "sid", F.explode(F.array_distinct(VOC.lower_words(F.col("sentence")))).alias("phrase"))
    entities = words.join(F.broadcast(known.withColumnRenamed("term", "phrase")), "phrase").groupBy("doc_id", "sid").agg(F.collect_list(F.struct("phrase", F.array("entity_type").alias("types"))).alias("entities"))
    return A.focus_scores(s.join(entities, ["doc_id", "sid"]), ["the", "and"], ["disease", "drug"])


@query(_FOCUS + " SELECT doc_id, sid, focus_score::DOUBLE AS focus_score FROM f")
def focus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _focus_scores(spark, sf_dir).select("doc_id", "sid", "focus_score")


@query(_FOCUS + " SELECT doc_id, sid, round(0.8 * ((doc_id * 31 + sid * 17) % 101) / 101.0 + 0.2 * focus_score / (SELECT max(focus_score) FROM f), 6)::DOUBLE AS score FROM f")
def combined_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _focus_scores(spark, sf_dir).withColumn("score", ((F.col("doc_id") * 31 + F.col("sid") * 17) % 101) / 101.0)
    return A.combined(scored).select("doc_id", "sid", F.round("score", 6).alias("score"))


# Measures and preparation ---------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT quality, CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE 1.0 / (doc_id % 7) END AS v FROM labels)
SELECT quality, count(*) AS questions, count(*) FILTER (v > 0) AS answered, round(avg(v), 6)::DOUBLE AS mrr, round(avg((v = 1)::INT), 6) AS p1 FROM r GROUP BY quality""")
def mrr_p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "labels").withColumn("rank", F.when(F.col("doc_id") % 7 == 0, "N/A").otherwise((F.col("doc_id") % 7).cast("string")))
    return M.rank_measures(ranks, "rank", ["quality"]).withColumns({"mrr": F.round("mrr", 6), "p1": F.round("p1", 6)})


@query("""WITH r AS (SELECT doc_id % 20 AS qid, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT qid, round(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / 10.0, 6)::DOUBLE AS precision FROM r LEFT JOIN labels USING (doc_id) WHERE rank <= 10 GROUP BY qid""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("qid"), "doc_id", F.col("n_chars").alias("score"))
    gold = table(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") % 20).alias("qid"), "doc_id")
    return M.precision_at(A.top_per_question(docs, 10, tie=["doc_id"]), gold, 10).withColumn("precision", F.round("precision", 6))


_COVER = """WITH g AS (SELECT DISTINCT doc_id % 20 AS qid, doc_id FROM labels WHERE quality = 1), r AS (SELECT doc_id % 20 AS qid, doc_id FROM documents WHERE lang = 'en'),
c AS (SELECT g.qid, count(*) AS gold, count(r.doc_id) AS found FROM g LEFT JOIN r USING (qid, doc_id) GROUP BY g.qid)"""


@query(_COVER + " SELECT qid, gold, found, round(found / gold, 6) AS coverage FROM c")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = (F.col("doc_id") % 20).alias("qid")
    found = table(spark, sf_dir, "documents").where("lang = 'en'").select(q, "doc_id")
    return M.coverage(found, table(spark, sf_dir, "labels").where("quality = 1").select(q, "doc_id")).withColumn("coverage", F.round("coverage", 6))


@query(_COVER + " SELECT round(avg(found / gold), 5) AS mean, round(stddev_pop(found / gold), 5) AS deviation, sum(found)::BIGINT AS found, sum(gold)::BIGINT AS gold, count(*) FILTER (found = gold) AS \"full\", count(*) FILTER (found = 0) AS \"none\" FROM c")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coverage_summary(coverage(spark, sf_dir)).withColumns({"mean": F.round("mean", 5), "deviation": F.round("deviation", 5)})


_FOLD = "(doc_id * 48271 + 7 * 69621) % 2147483647"


@query(f"""WITH k AS (SELECT DISTINCT doc_id FROM labels), n AS (SELECT doc_id, row_number() OVER (ORDER BY {_FOLD}, doc_id) - 1 AS n, greatest(1, floor(count(*) OVER () / 5)) AS size FROM k)
SELECT doc_id, least(floor(n / size), 4)::INT AS fold FROM n""")
def kfold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.k_folds(table(spark, sf_dir, "labels"), "doc_id", 5, 7)


@query("""WITH r AS (SELECT doc_id % 8 AS fold, quality AS label, (doc_id * 37 % 100) / 100.0 AS p FROM labels), c AS (SELECT fold, count(*) FILTER (p >= 0.5 AND label > 0) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp, count(*) FILTER (p < 0.5 AND label > 0) AS fn FROM r GROUP BY fold),
m AS (SELECT fold, tp, fp, fn, CASE WHEN tp + fp > 0 THEN 100.0 * tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN 100.0 * tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT fold, tp, fp, fn, round(p, 5)::DOUBLE AS precision, round(r, 5)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5)::DOUBLE AS f1 FROM m""")
def prf_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 8).alias("fold"), F.col("quality").alias("label"), ((F.col("doc_id") * 37 % 100) / 100.0).alias("p"))
    return M.precision_recall(rows, "label", "p", ["fold"]).withColumns({c: F.round(c, 5) for c in ("precision", "recall", "f1")})


@query("""WITH r AS (SELECT value, user_id % 2 = 0 AS g FROM events WHERE value IS NOT NULL), s AS (SELECT count(*) FILTER (g) AS n, count(*) FILTER (NOT g) AS m, avg(value) FILTER (g) AS x, avg(value) FILTER (NOT g) AS y, var_samp(value) FILTER (g) AS v, var_samp(value) FILTER (NOT g) AS w FROM r)
SELECT round((x - y) / sqrt(((n - 1) * v + (m - 1) * w) / (n + m - 2) * (1.0 / n + 1.0 / m)), 5) AS t, n + m - 2 AS df FROM s""")
def t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value is not null").select("value", (F.col("user_id") % 2 == 0).alias("g"))
    return M.t_test(rows, "value", "g").withColumn("t", F.round("t", 5))


@query("SELECT count(*) FILTER ((quality = 1) = (doc_id % 3 > 0)) AS correct, count(*) FILTER (quality <> 1 AND doc_id % 3 > 0) AS fp, count(*) FILTER (quality = 1 AND doc_id % 3 = 0) AS fn FROM labels")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("y"), (F.col("doc_id") % 3 > 0).alias("p")), "y", "p")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 20, quality ORDER BY (doc_id * 48271 + 3 * 69621) % 2147483647, doc_id) AS n FROM labels) SELECT doc_id, quality FROM r WHERE quality > 0 OR n <= 2""")
def neg_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("q", F.col("doc_id") % 20)
    return P.negatives(rows, "q", "doc_id", "quality", 2, 3).select("doc_id", "quality")


@query("""WITH a AS (SELECT doc_id FROM documents ORDER BY (doc_id * 48271 + 11 * 69621) % 2147483647, doc_id LIMIT 100) SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'b' ELSE 'a' END AS part FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id""")
def first_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_part(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 11)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
r AS (SELECT *, sum(CASE WHEN rn > 1 AND p IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT user_id, run::BIGINT AS run, event_type, min(event_id) AS first, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.consecutive_runs(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""SELECT a.conv_id, a.turn AS a, b.turn AS z, (length(a.text) > length(b.text))::INT AS label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id
WHERE a.turn <> b.turn AND length(a.text) <> length(b.text)""")
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return P.ordered_pairs(rows, "conv_id", "turn", "n")


@query(r"""WITH k AS (SELECT regexp_replace(text, '\s+', '', 'g') AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT doc_id FROM k""")
def first_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_by_key(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source")
def group_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT count(doc_id) = count(DISTINCT doc_id) AS \"unique\" FROM documents")
def all_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.all_unique(table(spark, sf_dir, "documents"), "doc_id")


@query()
def question_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus, definition phrase and query of every benchmark question, all of its sentences read."""
    schema = "item_id long, focus string, definition string, query string"

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b["item_id"], b["text"], strict=True):
                out.append((i, *Q.analysed(t or "")))
            yield b.__class__(out, columns=["item_id", "focus", "definition", "query"])

    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, schema)


@query()
def ask_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every benchmark question against all documents, ten answers for each, by all retrieval strategies together."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    vocabulary, vectors = term_tables(spark, sf_dir)
    known = spark.createDataFrame(DICTIONARY, "term string, entity_type string")
    return ask_all(table(spark, sf_dir, "documents"), questions, vocabulary, vectors, known, mode="ensemble")


# Other names of queries that read whole tables, under which tests hold them against brute force.
cosine_topk_all, jaccard_bits_all, ordered_pairs_all, rwmd_score_all = cosine_topk, jaccard_bits, ordered_pairs, rwmd_score


def knn_label_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote for a few probes only, those that :func:`cosine_topk` has: a test asks for it. The query ``knn_label`` takes every vector as a probe."""
    e = table(spark, sf_dir, "embeddings")
    return _voted(e, e.where(_every("vec_id")))


def rwmd_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentences of a few questions only, those that :func:`rwmd_score` has: a test asks for it. The query ``rwmd_rank`` takes every question."""
    return _best_sentences(spark, sf_dir, table(spark, sf_dir, "benchmark").where(_every("item_id")))
