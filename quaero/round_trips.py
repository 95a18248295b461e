"""Registered queries of sources, sinks and text helpers: driver tables are written in the shape of a source and read back, or run through a function, beside SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators import entities as E
from quaero.operators import metrics as M
from quaero.operators import preparation as P
from quaero.operators import vocabulary as VOC
from quaero.queries import WORDS, query, table
from quaero.sources import readers as RD
from quaero.sources import writers as WR
from quaero.sources.shared import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder where the driver and all executors can read: below the cluster's checkpoint folder, else below the warehouse."""
    return f"{shared_folder(spark)}/quaero-files/{uuid.uuid4().hex}"


def _grouped(rows: DataFrame, path: str, items: str) -> None:
    """One file for each thousand ids, with one JSON object whose array ``items`` has the rows' ``item``."""
    groups = rows.groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.collect_list("item").alias("items"))
    nested = F.struct(F.col("items").alias(items.split(".")[1])) if "." in items else F.col("items")
    groups.select("part", nested.alias(items.split(".")[0])).write.partitionBy("part").json(path)


# Sources and sinks ----------------------------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS doc_id, source AS title, text, lang AS year, source AS journal, (doc_id % 7)::DOUBLE AS score FROM documents WHERE length(text) > 0")
def read_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    dc = F.struct(F.concat(F.lit("pmid:"), "doc_id").alias("identifier"), F.col("source").alias("title"), F.col("text").alias("description"), F.col("lang").alias("publicationYear"), F.array(F.struct(F.col("source").alias("name"))).alias("publishers"))
    hit = F.struct((F.col("doc_id") % 7).cast("double").alias("_score"), F.struct(dc.alias("dc")).alias("_source"))
    _grouped(table(spark, sf_dir, "documents").select("doc_id", hit.alias("item")), path := scratch(spark), "hits.hits")
    return RD.search_hits(spark, path)


@query("SELECT doc_id::VARCHAR AS doc_id, source AS title, text, lang AS journal, 'D' || (doc_id % 5) AS mesh_id, source AS mesh_label FROM documents")
def read_legacy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.struct(F.col("source").alias("termLabel"), F.concat(F.lit("http://mesh/D"), F.col("doc_id") % 5).alias("uri"), F.lit("mesh").alias("namespace"))
    item = F.struct(F.col("doc_id").cast("string").alias("pmid"), F.col("source").alias("title"), F.col("text").alias("documentAbstract"), F.col("lang").alias("journal"), F.array("source").alias("meshHeading"), F.array(note).alias("meshAnnotations"))
    _grouped(table(spark, sf_dir, "documents").select("doc_id", item.alias("item")), path := scratch(spark), "result.documents")
    mesh = F.get("mesh", F.lit(0))
    return RD.legacy_results(spark, path).select("doc_id", "title", "text", "journal", mesh["id"].alias("mesh_id"), mesh["termLabel"].alias("mesh_label"))


@query("SELECT item_id::VARCHAR AS id, text AS question, 'factoid' AS type, 'u' || (item_id % 3) AS doc, (item_id % 4)::VARCHAR AS exact FROM benchmark")
def read_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("body"), F.lit("factoid").alias("type"), F.array(F.concat(F.lit("http://x/u"), F.col("item_id") % 3)).alias("documents"), F.array(F.array((F.col("item_id") % 4).cast("string"))).alias("exact_answer"))
    _grouped(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), item.alias("item")), path := scratch(spark), "questions")
    return RD.questions(spark, path).select("id", "question", "type", F.get("doc_ids", F.lit(0)).alias("doc"), F.get(F.get("exact", F.lit(0)), F.lit(0)).alias("exact"))


@query("SELECT doc_id::VARCHAR AS doc_id, source AS title, lang AS journal, '2001' AS year, lang || ' ' || source AS text FROM documents")
def read_article_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.struct(F.struct(F.lit("2001").alias("Year")).alias("PubDate"))
    article = F.struct(F.col("source").alias("ArticleTitle"), F.struct(F.array("lang", "source").alias("AbstractText")).alias("Abstract"), F.struct(F.col("lang").alias("Title"), issue.alias("JournalIssue")).alias("Journal"))
    citation = F.struct(F.struct(F.col("doc_id").cast("string").alias("_VALUE")).alias("PMID"), article.alias("Article"))
    WR.table_xml(table(spark, sf_dir, "documents").select(citation.alias("MedlineCitation")), path := scratch(spark), "PubmedArticle", "PubmedArticleSet")
    return RD.article_xml(spark, path)


@query("SELECT doc_id::VARCHAR AS id, lang AS label, source AS \"documentId\", '7' AS \"sentenceId\", lang AS sentence, source AS tree, 'NN VB' AS tags FROM documents")
def read_parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("lang").alias("sentence"), F.col("source").alias("pt"), F.lit("NN VB").alias("pos-tags"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("_label"), F.col("source").alias("_documentId"), F.lit("7").alias("_sentenceId"), F.lit("x").alias("text"), F.struct(F.array(one).alias("parsed-sentence")).alias("parsed-sentences")
    )
    WR.table_xml(rows, path := scratch(spark))
    return RD.parsed_questions(spark, path).select("id", "label", "documentId", "sentenceId", "sentence", "tree", F.array_join("tags", " ").alias("tags"))


@query("SELECT 'N' || n_nationkey AS node, lower(n_name) AS label, 'R' || n_regionkey AS parent FROM nation")
def read_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("k"), F.array(F.array(F.lower("n_name")), none, F.array(F.concat(F.lit("R"), "n_regionkey"))).alias("v"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).write.text(path := scratch(spark))
    labels, edges = RD.ontology(spark, path)
    return labels.join(edges.select(F.col("child").alias("node"), "parent"), "node")


@query("SELECT 't' || vec_id AS term, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def read_vectors_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    e.select(F.concat_ws(" ", F.concat(F.lit("t"), "vec_id"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("value")).write.text(path := scratch(spark))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return RD.vectors_text(spark, path, 64).select("term", F.size("embedding").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT doc_id, text, lang, source FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    WR.table_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path := scratch(spark))
    return RD.csv(spark, path, schema="doc_id long, text string, lang string, source string")


@query("SELECT 'l' || quality AS label, 'q' || doc_id AS question, 'a' || toxic AS candidate FROM labels")
def triples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("l"), "quality").alias("label"), F.concat(F.lit("q"), "doc_id").alias("question"), F.concat(F.lit("a"), "toxic").alias("answer_candidate"))
    WR.triples(rows, path := scratch(spark))
    return RD.tsv(spark, path, ["label", "question", "candidate"]).where("label <> 'label'")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    WR.table_json(rows, path := scratch(spark))
    return spark.read.schema(rows.schema).json(path)


@query("SELECT vec_id, embedding[1] AS first, label FROM embeddings")
def parquet_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = WR.TableCache(spark, scratch(spark))
    cache.put("embeddings", table(spark, sf_dir, "embeddings"))
    return cache.get("embeddings").select("vec_id", F.get("embedding", F.lit(0)).alias("first"), "label")


@query(f"SELECT term, count(*) AS freq FROM (SELECT unnest({WORDS}) AS term FROM benchmark) GROUP BY term")
def frequency_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(VOC.lower_words(F.col("text"))).alias("term"))
    WR.frequencies(words.groupBy("term").agg(F.count(F.lit(1)).alias("freq")), path := scratch(spark))
    return RD.tsv(spark, path, ["term", "freq"]).withColumn("freq", F.col("freq").cast("long"))


@query(f"""SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) - 1 AS place FROM (SELECT term, count(*) AS freq FROM (SELECT unnest({WORDS}) AS term FROM benchmark) GROUP BY term)""")
def frequency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(VOC.lower_words(F.col("text"))).alias("term"))
    ordered = WR.by_frequency(words.groupBy("term").agg(F.count(F.lit(1)).alias("freq")))
    return ordered.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query("SELECT doc_id, quality, (doc_id % 4)::INT AS fold FROM labels")
def fold_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    WR.folds(table(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("doc_id") % 4).cast("int").alias("fold")), path := scratch(spark))
    return spark.read.option("sep", "\t").option("header", True).schema("doc_id long, quality int, fold int").csv(path)


@query(f"SELECT array_to_string(w, ' ') AS tokens, len(w)::INT AS n, list_sum(list_transform(w, lambda x: length(x) % 2))::INT AS ones FROM (SELECT {WORDS} AS w FROM benchmark) WHERE len(w) > 0")
def two_line_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(VOC.lower_words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    WR.two_lines(w.withColumn("labels", F.transform("tokens", lambda x: (F.length(x) % 2).cast("int"))), path := scratch(spark))
    return RD.two_line_records(spark, path).select(F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"), F.aggregate("labels", F.lit(0), lambda s, x: s + x).alias("ones"))


@query("SELECT 'q' || doc_id AS question, 1 AS no, lang || ' ' || source AS sentence, (0.25 * (doc_id % 4))::DOUBLE AS score, doc_id::VARCHAR AS doc_id FROM documents")
def answer_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    WR.answer_log(d.select(F.concat(F.lit("q"), "doc_id").alias("question"), F.lit(1).alias("rank"), F.concat_ws(" ", "lang", "source").alias("sentence"), (0.25 * (F.col("doc_id") % 4)).alias("score"), "doc_id"), path := scratch(spark))
    return RD.answer_logs(spark, path).select("question", F.inline("candidates")).select("question", "no", "sentence", "score", "doc_id")


@query("SELECT trim(p_name) AS line FROM part WHERE trim(p_name) <> '' AND trim(p_name) NOT LIKE '#%'")
def read_plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    part.select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("value")).union(spark.createDataFrame([("# comment",), ("  ",)], "value string")).write.text(path := scratch(spark))
    return RD.plain_lines(spark, path)


@query("SELECT DISTINCT 'part=' || n_regionkey AS folder FROM nation")
def walk_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    n.select(F.col("n_regionkey").alias("part"), F.col("n_name").alias("value")).write.partitionBy("part").text(path := scratch(spark))
    return RD.files_below(spark, path, "*.txt").select(F.regexp_extract("path", r"(part=\d+)/[^/]*$", 1).alias("folder")).distinct()


@query("SELECT 'q' || vec_id AS qid, label::FLOAT AS label, embedding[1] AS \"left\", embedding[2] AS \"right\" FROM embeddings")
def read_pair_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.get("embedding", F.lit(k)).cast("string")
    lines = table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.concat(F.lit("q"), "vec_id"), F.col("label").cast("string"), F.lit("0"), F.lit("1"), at(0), at(1)).alias("value"))
    lines.write.text(path := scratch(spark))
    return RD.pair_file(spark, path).select("qid", "label", F.get("left", F.lit(0)).alias("left"), F.get("right", F.lit(0)).alias("right"))


@query(r"SELECT lower(p_brand) AS term, 0 AS ord, lower(p_type) AS base, 'VB' AS pos, 'base' AS inflection FROM part UNION ALL SELECT lower(p_brand), 1, lower(p_name), 'NN', 'plural' FROM part")
def morphology_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.concat(F.translate(F.lower("p_type"), " \t#", " "), F.lit("\tVB base#"), F.translate(F.lower("p_name"), " \t#", " "), F.lit("\tNN plural"))
    rows = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("key_term"), packed.alias("content"))
    return RD.morphology(rows).withColumn("base", F.translate("base", " ", " "))


@query("SELECT s_name AS term, list_sort(list(DISTINCT n_name)) AS nouns FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY s_name")
def nominalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    known = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.upper("s_name").alias("verb"), F.col("n_name").alias("nom"))
    return RD.nominalizations(s.select(F.col("s_name").alias("term")).distinct(), known, "verb", "nom")


# Text -----------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, regexp_replace(text, '\s+', '', 'g') = regexp_replace(lower(text), '\s+', '', 'g') AS same FROM documents")
def equal_without_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.regexp_replace(F.lower("text"), " ", "\n ")
    return table(spark, sf_dir, "documents").select("doc_id", T.equal_no_ws(F.translate("text", "‘’“”", "''\"\""), spaced).alias("same"))


@query(r"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '\s*\S+') AS p FROM conversations), e AS (SELECT conv_id, turn, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM p),
o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY k)::INT AS "end" FROM e) SELECT conv_id, turn, (k - 1)::INT AS pos, regexp_replace(piece, '^\s+', '') AS token, ("end" - length(regexp_replace(piece, '^\s+', '')))::INT AS start, "end" FROM o""")
def tokens_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.ws_tokens_with_offsets(F.col("text"))).alias("pos", "t"))
    return rows.select("conv_id", "turn", "pos", "t.token", "t.start", "t.end")


@query(r"SELECT item_id, regexp_replace(text, '^\s*(the|a|an)\s+', '', 'i') AS bare, list_filter(list_transform(regexp_split_to_array(text, '(?i)\s+(?:and|or)\s+'), lambda p: trim(regexp_replace(p, '^\s*(the|a|an)\s+', '', 'i'))), lambda p: p <> '') AS parts FROM benchmark")
def articles_and_conjunctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.strip_article(F.col("text")).alias("bare"), T.split_conjunctions(F.col("text")).alias("parts"))


@query(r"SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'https://' WHEN starts_with(url, 'http') THEN 'http' END AS prefix, list_last(string_split(url, '/')) AS last FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    prefix = T.common_prefix(F.col("url"), F.lit("https://\u0001"))
    return pages.select("page_id", prefix.alias("prefix"), T.id_of_url(F.col("url")).alias("last"))


@query(r"""SELECT DISTINCT word, regexp_matches(word, '^\pL') AND NOT regexp_matches(word, '^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$') AND lower(word) NOT IN ('the', 'of', 'and', 'a', 'in', 'to') AS eligible
FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS word FROM benchmark) WHERE length(word) > 1 AND length(word) > 12""")
def eligible_long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.ws_tokens(F.col("text"))).alias("word")).where(F.length("word") > 12).distinct()
    return words.select("word", T.eligible_phrase(F.col("word")).alias("eligible"))


@query("SELECT vec_id, list_sum(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN i + 1 ELSE 0 END))::DOUBLE AS hot, round(list_sum(embedding[1:40]::DOUBLE[]), 4) AS head, 70 AS n FROM embeddings")
def fixed_size_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    hot = F.aggregate(F.zip_with(T.one_hot(F.col("label"), 10), F.sequence(F.lit(1), F.lit(10)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    wide = F.transform("embedding", lambda x: x.cast("double"))
    head = F.aggregate(T.padded(wide, 40), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", hot.alias("hot"), F.round(head, 4).alias("head"), F.size(T.padded(wide, 70)).alias("n"))


# Joins, splits and measures -------------------------------------------------------------------------------------------


@query(r"""WITH k AS (SELECT doc_id, quality, regexp_replace(text, '\s+', '', 'g') AS key FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN key IN (SELECT key FROM k WHERE quality = 1) THEN 'good' ELSE 'rest' END AS part FROM k""")
def split_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select(F.concat("text", F.lit(" ")).alias("text"))
    parts = P.split_by_lists(d, "text", {"good": good})
    return parts["good"].select("doc_id", F.lit("good").alias("part")).union(parts["rest"].select("doc_id", F.lit("rest").alias("part")))


@query(r"""WITH d AS (SELECT regexp_replace(text, '\s+', '', 'g') AS key, min(doc_id) AS id, arg_min(lang, doc_id) AS type FROM documents GROUP BY 1) SELECT id, type, length(key) AS n FROM d""")
def join_on_bare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ranks = d.select(F.regexp_replace("text", " ", "  ").alias("question"))
    joined = P.join_on_text(ranks, d.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("text").alias("question")))
    return joined.select("id", "type", F.length(T.strip_ws(F.col("question"))).cast("long").alias("n"))


@query("""WITH i AS (SELECT l_orderkey AS k, l_linenumber AS s, l_linenumber + 1 AS e FROM lineitem), o AS (SELECT l_orderkey AS k, l_linenumber - 1 AS s, l_linenumber + 2 + (l_partkey % 3)::INT AS e FROM lineitem),
j AS (SELECT i.k, i.s, i.e, o.s AS os, o.e AS oe, row_number() OVER (PARTITION BY i.k, i.s, i.e ORDER BY o.e - o.s DESC, o.s DESC, o.e DESC) AS n FROM i JOIN o ON i.k = o.k AND i.s >= o.s AND i.e <= o.e)
SELECT k, s AS start, e AS "end", os AS outer_start, oe AS outer_end FROM j WHERE n = 1""")
def spans_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    inner = rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    outer = rows.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("start"), (F.col("l_linenumber") + 2 + (F.col("l_partkey") % 3).cast("int")).alias("end"))
    return P.inside(inner, outer, "k")


@query(f"""WITH p AS (SELECT item_id AS question, unnest({WORDS}) AS term, generate_subscripts({WORDS}, 1) - 1 AS part FROM benchmark) SELECT DISTINCT a.question, a.part::INT AS part, b.part::INT AS other FROM p a JOIN p b USING (question) WHERE a.part <> b.part AND contains(a.term, b.term)""")
def parts_that_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.containing_parts(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), F.posexplode(VOC.lower_words(F.col("text"))).alias("part", "term")))


@query("SELECT vec_id, (k - 1)::INT AS pos, embedding[k] AS x, embedding[65 - k] AS y FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)")
def zipped_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.reverse("embedding").alias("y"))
    return P.zipped(e, "x", "y").select("vec_id", "pos", "pair.x", "pair.y")


@query("""WITH r AS (SELECT doc_id % 20 AS qid, doc_id AS key, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id)::INT AS rank FROM documents), g AS (SELECT doc_id % 20 AS qid, doc_id AS key FROM labels WHERE toxic = 1)
SELECT r.qid, coalesce(min(r.rank) FILTER (g.key IS NOT NULL), 0)::INT AS rank FROM r LEFT JOIN g ON g.qid = r.qid AND g.key = r.key GROUP BY r.qid""")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    q = (F.col("doc_id") % 20).alias("qid")
    ranked = table(spark, sf_dir, "documents").select(q, F.col("doc_id").alias("key")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("key")))
    return M.first_hit_rank(ranked, table(spark, sf_dir, "labels").where("toxic = 1").select(q, F.col("doc_id").alias("key")))


@query("SELECT round(avg((((doc_id * 37 % 100) / 100.0 >= 0.5) = (quality >= 0.5))::INT), 6) AS accuracy FROM labels")
def pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", ((F.col("doc_id") * 37 % 100) / 100.0).alias("p"))
    return M.pair_accuracy(rows, "quality", "p").select(F.round("accuracy", 6).alias("accuracy"))


@query("SELECT (k - 1)::INT AS epoch, round(100 * avg(embedding[k]::DOUBLE), 5) AS mean FROM (SELECT embedding, unnest(range(1, 65)) AS k FROM embeddings) GROUP BY k")
def curve_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    return M.learning_curve(e, "s").select("epoch", F.round("mean", 5).alias("mean"))


@query("SELECT n_nationkey::VARCHAR AS node FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def nodes_of_a_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = n.select(F.col("n_nationkey").cast("string").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    labels = r.select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.col("r_name").alias("label"))
    return E.is_a(n.select(F.col("n_nationkey").cast("string").alias("node")), labels, E.ancestors(edges), "asia")


@query("SELECT p_name AS phrase, min(p_partkey) AS node FROM part GROUP BY p_name")
def longest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    labels = part.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("node"))
    found = E.longest_match(part.select(F.concat(F.lit("unlisted "), "p_name").alias("phrase")).distinct(), labels)
    return found.select(F.expr("substring(phrase, 10)").alias("phrase"), "node")
