"""Factoid answers: candidate phrases of ranked sentences, scored by their nearness to the focus and their frequency, and matched to gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.operators import answers as A
from quaero.operators import ranking as R
from quaero.operators import vocabulary as VOC

#: The least similarity to the focus, and the share of a phrase that may repeat the question.
LEAST_NEARNESS, LEAST_FUZZY = 0.1, 0.8


def candidates(sentences: DataFrame, focus: DataFrame, question_words: DataFrame, vectors: DataFrame, vocabulary: DataFrame, most: int = 100) -> DataFrame:
    """(qid, phrase, score) from (qid, doc_id, sid, sentence), (qid, focus, vector) and (qid, term).

    Questions are judged apart: a phrase is held against the words and counted in the sentences of its own question only. Each phrase's best sub-phrase must be near the focus; phrases that say the question again are dropped; the rest is weighted by how often it occurs and how rare its words are.
    """
    phrases = A.candidate_phrases(sentences.select("doc_id", "sid", "sentence")).join(sentences.select("qid", "doc_id", "sid"), ["doc_id", "sid"]).select("qid", "phrase").distinct()
    subs = phrases.select("qid", "phrase", F.explode(T.sub_phrases(F.split("phrase", " "))).alias("sub"))
    known = R.phrase_vectors(subs.select(F.col("sub").alias("phrase")), vectors).withColumnRenamed("phrase", "sub")
    near = R.best_sub_phrase(subs.join(known, "sub", "left"), focus).where(F.col("cos") > LEAST_NEARNESS)
    tokens = near.select(F.struct("qid", "phrase").alias("id"), "qid", F.posexplode(F.split(F.lower("phrase"), " ")).alias("pos", "term"))
    same = R.fuzzy_match(tokens, question_words.select("qid", "term"), vectors, LEAST_FUZZY, "qid").where("matched").select("id.qid", "id.phrase")
    kept = near.join(same, ["qid", "phrase"], "left_anti")
    weights = VOC.phrase_weights(kept.select("qid", F.lower("phrase").alias("phrase")), sentences.select("qid", "sentence"), vocabulary, "qid")
    scored = kept.withColumn("__low", F.lower("phrase")).join(weights.select("qid", F.col("phrase").alias("__low"), "factor"), ["qid", "__low"]).withColumn("score", F.col("cos") * F.col("factor"))
    return A.top_per_question(scored, most, tie=["phrase"]).select("qid", "phrase", "score", "rank")


def reranked_by_similarity(phrases: DataFrame, questions: DataFrame, vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Phrases (qid, phrase) by relaxed word mover's similarity to their question (qid, term)."""
    words = phrases.select("qid", F.col("phrase").alias("sid"), F.explode(VOC.lower_words(F.col("phrase"))).alias("term"))
    return R.rwmd(questions, words, vectors, vocabulary).withColumnRenamed("sid", "phrase")


def matched_to_gold(phrases: DataFrame, gold: DataFrame, vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, phrase, rank, score): the ranked phrase nearest to a gold answer (qid, answer), the best of all gold answers of a question."""
    asked = gold.select(F.concat_ws("\t", F.col("qid").cast("string"), "answer").alias("qid"), F.explode(VOC.lower_words(F.col("answer"))).alias("term"))
    keys = gold.select("qid", F.concat_ws("\t", F.col("qid").cast("string"), "answer").alias("key"))
    words = phrases.join(keys, "qid").select(F.col("key").alias("qid"), F.col("phrase").alias("sid"), F.explode(VOC.lower_words(F.col("phrase"))).alias("term"))
    scored = R.rwmd(asked, words, vectors, vocabulary).withColumnsRenamed({"qid": "key", "sid": "phrase"}).join(keys, "key").join(phrases.select("qid", "phrase", "rank"), ["qid", "phrase"])
    return A.best_by(scored, ["qid"], "score", "rank").select("qid", "phrase", "rank", "score")
