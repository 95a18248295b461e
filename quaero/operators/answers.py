"""Answer selection: filters, score combination, ordering, deduplication, exact answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators.entities import GENERIC_NOUNS


#: Fixed value: characters that an answer has at least.
LEAST_LENGTH = 40


def split_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sid, sentence): the sentences of every document, in order."""
    return docs.select(key, F.posexplode(T.sentences(F.col("text"))).alias("sid", "sentence"))


def deduplicated(answers: DataFrame, least: int = LEAST_LENGTH, key: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """For each text (white space ignored) the answer with the best score, if it has ``least`` characters; a short one still stands for its text."""
    ties = tie or ["doc_id", "sid"]
    first = Window.partitionBy(*(key or []), "__key").orderBy(F.desc("score"), *ties)
    return answers.withColumn("__key", T.strip_ws(F.col("sentence"))).withColumn("__n", F.row_number().over(first)).where((F.col("__n") == 1) & (F.length("sentence") >= least)).drop("__key", "__n")


def best_first(answers: DataFrame, most: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """By falling score, ties in the order of documents and sentences."""
    ordered = answers.orderBy(F.desc("score"), *(tie or ["doc_id", "sid"]))
    return ordered if most is None else ordered.limit(most)


def top_per_question(answers: DataFrame, most: int, key: str = "qid", tie: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), *(tie or ["doc_id", "sid"]))
    return answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def best_by(rows: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """For each key the row with the best score; of equal ones that with the least ``tie``."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), tie)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def defines(sentence: Column, phrase: str | Column) -> Column:
    """Whether a sentence defines the phrase: ``such as P``, ``also called P``, ``P, a(n) word``, ``P are word``, or ``is`` right behind P."""
    if isinstance(phrase, str):
        p, low = F.lit(re.escape(phrase)), F.lit(phrase.lower())
    else:
        p, low = F.regexp_replace(phrase, r"([^\p{L}\p{Nd}\s])", r"\\$1"), F.lower(phrase)
    patterns = ("\\s+such\\s+as\\s+", p), ("\\s+also\\s+called\\s+", p), (p, "\\s*,\\s*an?\\s+\\w+\\s+"), (p, "\\s+are\\s+\\w+\\s+"), ("(?is)^(?:(?!", p, ").)*", p, r"[^\p{L}\p{Nd}]*(?-i:is[\s.]\s*\S)")
    found = F.lit(False)
    for pieces in patterns:
        found = found | F.rlike(sentence, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in pieces)))
    return F.contains(F.lower(sentence), low) & found


def definition_answers(sentences: DataFrame, phrase: str) -> DataFrame:
    return sentences.where(defines(F.col("sentence"), phrase)).withColumn("score", F.lit(1.0))


def focus_scores(tagged: DataFrame, query_entities: list[str] | Column, focus_types: list[str] | Column) -> DataFrame:
    """Sentences with an entity of the focus's types that the query does not name, with ``focus_score`` 1 + the share of query entities that they have. Entities and types are those of one
    question, or columns where each row has those of its own."""
    listed = lambda x: x if isinstance(x, Column) else F.array(*map(F.lit, x)).cast("array<string>")
    asked, types = listed(query_entities), listed(focus_types)
    named = lambda e: F.array_contains(asked, e["phrase"])
    focus = F.size(F.filter("entities", lambda e: ~named(e) & F.arrays_overlap(e["types"], types)))
    shared = F.size(F.filter("entities", named))
    score = F.when(F.size(asked) > 0, 1 + shared / F.size(asked)).otherwise(1.0)
    return tagged.withColumn("focus_count", focus).where("focus_count >= 1").withColumn("focus_score", score.cast("double"))


def combined(answers: DataFrame, similarity: str = "score", focus: str = "focus_score", share: float = 0.8, key: list[str] | None = None) -> DataFrame:
    """``share`` of the similarity, the rest from the focus score over the best focus score (of each key, or of all: a joined one-row maximum)."""
    best = answers.groupBy(*key).agg(F.max(focus).alias("__best")) if key else answers.agg(F.max(focus).alias("__best"))
    joined = answers.join(best, key) if key else answers.crossJoin(F.broadcast(best))
    return joined.withColumn("score", share * F.col(similarity) + (1 - share) * F.col(focus) / F.col("__best")).drop("__best")


def exact_answers(tagged: DataFrame, query_entities: list[str], focus_types: list[str], most: int = 10) -> DataFrame:
    """(answer, n, score): entities of the focus's types in the best sentences, without class nouns, numbers, single characters and what the query names."""
    types = F.array(*map(F.lit, focus_types)).cast("array<string>")
    top = best_first(tagged, most).select("score", F.explode("entities").alias("e"))
    named = [q.lower() for q in query_entities]
    low = F.lower("e.phrase")
    bare = F.trim(T.strip_article(F.col("e.phrase")))
    wanted = top.where(F.arrays_overlap("e.types", types) & ~low.isin(*named, *GENERIC_NOUNS) & (F.length(bare) >= 2) & ~T.is_number(bare))
    return wanted.groupBy(F.lower("e.phrase").alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score")).orderBy(F.desc("n"), F.desc("score"), "answer")


def candidate_phrases(sentences: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, sid, phrase): factoid candidates, conjunctions split, articles stripped, eligible ones only; of ``most`` words at most, if it is given."""
    runs = F.regexp_extract_all("sentence", F.lit(r"(?:[\p{L}\p{Nd}][\p{L}\p{Nd}'-]*)(?: [\p{L}\p{Nd}][\p{L}\p{Nd}'-]*)*"), F.lit(0))
    each = sentences.select("doc_id", "sid", F.explode(runs).alias("run")).select("doc_id", "sid", F.explode(T.split_conjunctions(F.col("run"))).alias("run"))
    phrases = each.select("doc_id", "sid", F.explode(T.sub_phrases(F.split("run", " "))).alias("phrase"))
    short = F.lit(True) if most is None else F.size(F.split("phrase", " ")) <= most
    return phrases.where(T.eligible_phrase(F.col("phrase")) & short).distinct()


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each white-space-free key."""
    w = Window.partitionBy(T.strip_ws(F.col(key))).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
