"""Readers for the file shapes of literature question answering; each returns a DataFrame with a fixed schema."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaero.functions import text as T

_HIT = """hits struct<total:bigint, hits:array<struct<_score:double, _source:struct<dc:struct<
  identifier:string, title:string, description:string, publicationYear:string, publishers:array<struct<name:string>>>>>>>"""
_LEGACY = """result struct<documents:array<struct<pmid:string, title:string, documentAbstract:string, journal:string, year:string, fulltextAvailable:boolean,
  meshHeading:array<string>, meshAnnotations:array<struct<termLabel:string, uri:string, namespace:string>>>>>"""
_QUESTIONS = """questions array<struct<id:string, body:string, type:string, documents:array<string>, concepts:array<string>, triples:array<struct<p:string, s:string, o:string>>,
  snippets:array<struct<text:string, document:string, beginSection:string, endSection:string, offsetInBeginSection:int, offsetInEndSection:int>>,
  exact_answer:string, ideal_answer:string>>"""


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Saved search results: (doc_id, title, text, year, journal, score); hits without an abstract are dropped."""
    hits = spark.read.schema(_HIT).json(path, multiLine=True).select(F.explode("hits.hits").alias("h"))
    dc = "h._source.dc"
    found = hits.select(
        F.substring_index(f"{dc}.identifier", ":", -1).alias("doc_id"), F.col(f"{dc}.title").alias("title"), F.col(f"{dc}.description").alias("text"),
        F.col(f"{dc}.publicationYear").alias("year"), F.get(f"{dc}.publishers", F.lit(0))["name"].alias("journal"), F.col("h._score").alias("score"),
    )
    return found.where(F.length("text") > 0)


def search_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_HIT).json(path, multiLine=True).select(F.col("hits.total").alias("total"))


def legacy_results(spark: SparkSession, path: str) -> DataFrame:
    """Older result files: documents with mesh headings joined to their annotations by label."""
    docs = spark.read.schema(_LEGACY).json(path, multiLine=True).select(F.inline("result.documents"))
    joined = F.transform("meshHeading", lambda label: F.struct(label.alias("label"), F.get(F.filter("meshAnnotations", lambda a: a["termLabel"] == label), F.lit(0)).alias("note")))
    mesh = F.transform(joined, lambda j: F.struct(j["label"].alias("termLabel"), F.substring_index(j["note"]["uri"], "/", -1).alias("id"), j["note"]["namespace"].alias("namespace")))
    return docs.select(F.col("pmid").alias("doc_id"), "title", F.col("documentAbstract").alias("text"), "journal", "year", F.col("fulltextAvailable").alias("full_text"), mesh.alias("mesh"))


def article_xml(spark: SparkSession, path: str) -> DataFrame:
    """Article records: (doc_id, title, journal, year, text); without an abstract they are dropped."""
    schema = """MedlineCitation struct<PMID:struct<_VALUE:string>, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<string>>,
      Journal:struct<Title:string, JournalIssue:struct<PubDate:struct<Year:string>>>>>"""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path)
    a = "MedlineCitation.Article"
    found = rows.select(
        F.col("MedlineCitation.PMID._VALUE").alias("doc_id"), F.col(f"{a}.ArticleTitle").alias("title"), F.col(f"{a}.Journal.Title").alias("journal"),
        F.col(f"{a}.Journal.JournalIssue.PubDate.Year").alias("year"), F.array_join(f"{a}.Abstract.AbstractText", " ").alias("text"),
    )
    return found.where(F.length("text") > 0)


def nested_answers(raw: Column) -> Column:
    """An exact answer given as text, a list or a list of lists, as a list of lists."""
    lists, flat = F.from_json(raw, "array<array<string>>"), F.from_json(raw, "array<string>")
    is_list, is_nested = F.startswith(F.ltrim(raw), F.lit("[")), raw.rlike(r"^\s*\[\s*\[")
    return F.when(raw.isNull(), F.array().cast("array<array<string>>")).when(is_nested, lists).when(is_list, F.transform(flat, lambda x: F.array(x))).otherwise(F.array(F.array(raw)))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question records, one row for each, with snippets and triples as arrays of structs."""
    q = spark.read.schema(_QUESTIONS).json(path, multiLine=True).select(F.inline("questions"))
    ideal = F.when(q["ideal_answer"].rlike(r"^\s*\["), F.from_json("ideal_answer", "array<string>")).when(q["ideal_answer"].isNotNull(), F.array("ideal_answer"))
    docs = F.transform("documents", T.id_of_url)
    return q.withColumnRenamed("body", "question").withColumns({"doc_ids": docs, "exact": nested_answers(F.col("exact_answer")), "ideal": ideal}).drop("exact_answer", "ideal_answer")


def parsed_questions(spark: SparkSession, path: str) -> DataFrame:
    """Parsed sentences: (id, label, documentId, sentenceId, text, sentence, tree, tags)."""
    schema = "_id string, _label string, _documentId string, _sentenceId string, text string, `parsed-sentences` struct<`parsed-sentence`:array<struct<sentence:string, pt:string, `pos-tags`:string>>>"
    rows = spark.read.format("xml").option("rowTag", "dr").schema(schema).load(path)
    each = rows.select(*(F.col(f"_{c}").alias(c) for c in ("id", "label", "documentId", "sentenceId")), "text", F.explode_outer("`parsed-sentences`.`parsed-sentence`").alias("p"))
    return each.select("id", "label", "documentId", "sentenceId", "text", "p.sentence", F.col("p.pt").alias("tree"), F.split("p.`pos-tags`", " ").alias("tags"))


def by_question(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("documentId").agg(F.array_sort(F.collect_list(F.struct("sentenceId", "text", "tree"))).alias("sentences"))


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node, label) of labels and synonyms, and (child, parent), from ``{curie: [[labels], [synonyms], [parents]]}``."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("node", "v"))
    names = F.array_distinct(F.concat(F.get("v", F.lit(0)), F.get("v", F.lit(1))))
    return rows.select("node", F.explode(names).alias("label")), rows.select(F.col("node").alias("child"), F.explode(F.get("v", F.lit(2))).alias("parent"))


def vectors_text(spark: SparkSession, path: str, dim: int | None = None, skip_phrases: bool = False) -> DataFrame:
    """(term, embedding) from lines ``term v1 v2 ...``."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p")).where(F.size("p") > 2)
    found = parts.select(F.get("p", F.lit(0)).alias("term"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("float")).alias("embedding"))
    found = found.where(F.size("embedding") == dim) if dim else found
    return found.where(~F.contains("term", F.lit("_"))) if skip_phrases else found


def _decoded(blobs: Column, kind: str, skip: int) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, kind, offset=skip).astype("float32"))

    return run(blobs)


def vectors_of_blobs(rows: DataFrame, column: str = "vector") -> DataFrame:
    """Little-endian float32 blobs as arrays."""
    return rows.withColumn("embedding", _decoded(F.col(column), "<f4", 0)).drop(column)


def centroids_of_blobs(rows: DataFrame, column: str = "centroid", after: int | None = None) -> DataFrame:
    """Blobs of a two-byte length and big-endian float32s; null blobs are skipped, ids above ``after`` only (a pushed filter)."""
    kept = rows.where(F.col(column).isNotNull())
    kept = kept if after is None else kept.where(F.col("doc_id") > after)
    return kept.withColumn("embedding", _decoded(F.col(column), ">f4", 2)).drop(column)


def csv(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    """RFC 4180 files; header names are trimmed."""
    reader = spark.read.option("quote", '"').option("escape", '"').option("multiLine", True).option("header", header)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.toDF(*(c.strip() for c in rows.columns)) if header else rows


def tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").csv(path).toDF(*names)


def irregular_verbs(spark: SparkSession, path: str) -> DataFrame:
    """(verb, past, participle); of several forms the first."""
    return tsv(spark, path, ["verb", "past", "participle"]).select("verb", F.substring_index("past", "/", 1).alias("past"), F.substring_index("participle", "/", 1).alias("participle"))


def two_line_records(spark: SparkSession, path: str, second: str = "labels", as_int: bool = True) -> DataFrame:
    """(file, record, tokens, second) from files whose lines come in pairs; lines that start with ``<`` are skipped, unequal pairs dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    kept = lines.select("file", F.filter("l", lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("<"))).alias("l"))
    starts = F.when(F.size("l") >= 2, F.sequence(F.lit(0), F.size("l") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    pairs = kept.select("file", F.posexplode(F.transform(starts, lambda i: F.struct(F.get("l", i).alias("a"), F.get("l", i + 1).alias("b")))).alias("record", "p"))
    values = T.ws_tokens(F.col("p.b"))
    values = F.transform(values, lambda x: x.try_cast("int")) if as_int else values
    return pairs.select("file", "record", T.ws_tokens(F.col("p.a")).alias("tokens"), values.alias(second)).where(F.size("tokens") == F.size(second))


def answer_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, question, answer, rank, method, manual, candidates) from text logs with blocks between ``=====`` lines; wrapped candidate lines are joined again."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?m)^=====+\s*$")).alias("block", "b"))
    blocks = files.where(F.col("b").contains("Question:"))
    candidates = F.regexp_extract_all("b", F.lit(r"(?ms)^\s*(\d+\).*?)(?=^\s*\d+\)|^Manual:|\z)"), F.lit(1))
    parsed = F.transform(candidates, lambda c: F.struct(
        T.item_number(c).alias("no"), F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)^\d+\)|\[[-+0-9.eE]+\].*$", ""), r"\s+", " ")).alias("sentence"),
        T.score_suffix(c).alias("score"), F.regexp_extract(c, r"PMID:(\d+)", 1).alias("doc_id"),
    ))
    first = lambda pattern: F.regexp_extract("b", pattern, 1)
    return blocks.select(
        "file", "block", F.trim(first(r"Question:([^\n]*)")).alias("question"), F.trim(first(r"Answer:([^\n]*)")).alias("answer"), first(r"(?m)^rank:(\d+)").try_cast("int").alias("rank"),
        first(r"method:(\S+)").alias("method"), F.transform(F.split(first(r"(?s)Manual:.*?rank:([\d, ]+)"), r"\s*,\s*"), lambda x: F.trim(x).try_cast("int")).alias("manual"), F.slice(parsed, 1, 100).alias("candidates"),
    )


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): without blank lines and comments."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where(~F.startswith("line", F.lit("#")) & (F.col("line") != ""))


def counted_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase) from lines ``phrase<TAB>count``."""
    return plain_lines(spark, path).select(F.trim(F.substring_index("line", "\t", 1)).alias("phrase"))


def files_below(spark: SparkSession, path: str, glob: str = "*.nxml") -> DataFrame:
    """(path, length) of all files of a tree that match; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def pair_file(spark: SparkSession, path: str) -> DataFrame:
    """(qid, label, i, j, left, right) from a header ``n dim`` and lines ``qid label i j v...``."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 4)
    dim = ((F.size("p") - 4) / 2).cast("int")
    cut = lambda start: F.transform(F.slice("p", start, dim), lambda x: x.cast("float"))
    at = lambda k, kind: F.get("p", F.lit(k)).cast(kind)
    return lines.select(at(0, "string").alias("qid"), at(1, "float").alias("label"), at(2, "int").alias("i"), at(3, "int").alias("j"), cut(F.lit(5)).alias("left"), cut(5 + dim).alias("right"))


def morphology(rows: DataFrame) -> DataFrame:
    """(term, ord, base, pos, inflection) from packed texts ``base<TAB>POS inflection#...`` in (key_term, content)."""
    each = rows.select(F.col("key_term").alias("term"), F.posexplode(F.split("content", "#")).alias("ord", "r")).withColumn("f", F.split("r", r"[\t ]"))
    return each.where(F.size("f") >= 2).select("term", "ord", F.get("f", F.lit(0)).alias("base"), F.get("f", F.lit(1)).alias("pos"), F.get("f", F.lit(2)).alias("inflection"))


def infinitives(morph: DataFrame) -> DataFrame:
    """(term, base): the first verb record without a hyphen (unless behind co, vitro, down or up)."""
    ok = F.startswith("pos", F.lit("V")) & (~F.contains("base", F.lit("-")) | F.col("base").rlike("^(co|vitro|down|up)-"))
    return morph.where(ok).groupBy("term").agg(F.min_by("base", "ord").alias("base"))


def nominalizations(words: DataFrame, table: DataFrame, word: str, noun: str, column: str = "term") -> DataFrame:
    """``words`` with ``nouns``, the nominalizations of their lower-cased form."""
    grouped = table.groupBy(F.lower(word).alias("__w")).agg(F.array_sort(F.collect_set(noun)).alias("nouns"))
    return words.withColumn("__w", F.lower(column)).join(grouped, "__w", "left").drop("__w")


def annotations(texts: DataFrame, column: str = "html") -> DataFrame:
    """``texts`` with ``spans``: (phrase, categories) of marked-up annotation spans."""
    found = F.regexp_extract_all(column, F.lit(r'(<span[^>]*data-\w+="[^"]*"[^>]*>[^<]*</span>)'), F.lit(1))
    parse = lambda s: F.struct(F.regexp_extract(s, ">([^<]*)</span>", 1).alias("phrase"), F.split(F.regexp_extract(s, r'data-\w+="([^"]*)"', 1), r"\|").alias("concepts"))
    return texts.withColumn("spans", F.transform(found, parse))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Line numbers over a small table."""
    return rows.withColumn("no", F.row_number().over(Window.orderBy(order)) - 1)
