"""From a question to ranked answer sentences."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions import vectors as V
from quaero.operators import answers as A
from quaero.operators import entities as E
from quaero.operators import questions as Q
from quaero.operators import ranking as R
from quaero.operators import scorers as S
from quaero.operators import search
from quaero.operators.vocabulary import lower_words
from quaero.plans.batch import Keep, query_of, sentence_scores
from quaero.plans.query import Query
from quaero.sources.shared import ready_to_checkpoint
from quaero.sources.writers import AnswerCache


@dataclass
class Engine:
    """Tables of one collection: documents (doc_id, text), vocabulary (term, weight), vectors (term, embedding), dictionary (term, entity_type), and for
    retrieval by nearness the documents' centroids (doc_id, embedding)."""

    docs: DataFrame
    vocabulary: DataFrame
    vectors: DataFrame
    dictionary: DataFrame
    scorer: S.PairScorer | None = None
    centroids: DataFrame | None = None
    cache: AnswerCache = field(default_factory=AnswerCache)

    def weights(self, words: Iterable[str]) -> dict[str, float]:
        wanted = sorted({w.lower() for w in words})
        return {r.term: r.weight for r in self.vocabulary.where(F.col("term").isin(wanted)).select("term", "weight").collect()}

    def query(self, question: str, mode: str = "baseline") -> Query:
        """The query of a question for a retrieval mode, entities marked."""
        parsed = Q.parse(question)
        words = [w for w in parsed.words if any(c.isalnum() for c in w)]
        weights = self.weights(words)
        built = query_of(question, weights, mode, {})
        return query_of(question, weights, mode, self._types(t.text for p in built.parts for t in p.terms))

    def _types(self, terms: Iterable[str]) -> dict[str, tuple[str, ...]]:
        wanted = sorted({t.lower() for t in terms})
        rows = self.dictionary.where(F.lower("term").isin(wanted)).select(F.lower("term").alias("term"), "entity_type").distinct().collect()
        found: dict[str, list[str]] = {}
        for r in rows:
            found.setdefault(r.term, []).append(r.entity_type)
        known = {k: tuple(sorted(v, key=E.TYPE_ORDER.index)) for k, v in found.items()}
        return {t: types for t in wanted if (types := E.query_types(t, known))}

    def retrieve(self, question: str, mode: str = "baseline") -> DataFrame:
        """(doc_id, rank) of up to 2000 documents. ``ensemble`` unites baseline, rank and keyword; ``ensemble2`` the last two, ``hybrid`` keyword and baseline; ``aknn`` takes the nearest centroids."""
        if mode == "aknn":
            return self._nearest(question)
        if mode.startswith(("ensemble", "hybrid")):
            modes = {"ensemble2": ("rank", "keyword"), "hybrid": ("keyword", "baseline")}.get(mode, ("baseline", "rank", "keyword"))
            return search.ordered_union([self.retrieve(question, m) for m in modes])
        strategy = "baseline" if mode.startswith("baseline") else mode
        return search.ranked(search.retrieve(self.docs, self.query(question, mode), strategy))

    def _nearest(self, question: str, most: int = 100) -> DataFrame:
        """The ``most`` documents whose centroids are nearest to the question's, a top-k list; none if it has no known word."""
        if self.centroids is None:
            raise ValueError("retrieval by nearness needs the documents' centroids")
        spark = self.docs.sparkSession
        words = [w.lower() for w in Q.parse(question).words if w not in T.STOP_WORDS]
        asked = spark.createDataFrame([(0, w) for w in words], "qid long, term string")
        probe = R.question_centroid(asked, self.vectors, self.vocabulary).select(F.lit(None).cast("long").alias("probe"), F.col("vector").alias("pv"))
        scored = self.centroids.crossJoin(F.broadcast(probe)).select("doc_id", V.cosine(F.col("pv"), F.col("embedding")).alias("score"))
        return search.ranked(scored.orderBy(F.desc("score"), "doc_id").limit(most))

    def _sentences(self, found: DataFrame) -> DataFrame:
        return A.split_documents(self.docs.join(found.select("doc_id"), "doc_id", "left_semi"))

    def _similarity(self, question: str, sentences: DataFrame) -> DataFrame:
        spark = self.docs.sparkSession
        q = spark.createDataFrame([(0, w.lower()) for w in Q.parse(question).words], "qid long, term string")
        words = sentences.select(F.lit(0).cast("long").alias("qid"), F.struct("doc_id", "sid").alias("sid"), F.explode(F.array_distinct(lower_words(F.col("sentence")))).alias("term"))
        scored = R.rwmd(q, words, self.vectors, self.vocabulary).select("sid.doc_id", "sid.sid", "score")
        return sentences.join(scored, ["doc_id", "sid"], "left").withColumn("score", F.coalesce("score", F.lit(0.0).cast("float")))

    def ask_table(self, question: str, most: int = 10, mode: str = "baseline", rerank: bool = False) -> DataFrame:
        """(doc_id, sid, sentence, score, rank): definition questions by pattern, questions with a typed focus by entities, all others by similarity."""
        parsed = Q.parse(question)
        sentences = self._sentences(self.retrieve(question, mode))
        phrases = Q.definition_phrases(parsed)
        if phrases:
            defined = A.definition_answers(sentences, phrases[0]).limit(most)
            if not defined.isEmpty():
                return A.top_per_question(defined.withColumn("qid", F.lit(0)), most).drop("qid")
        scored = self._similarity(question, sentences)
        focus = Q.focus(parsed)
        types = list(self._types([focus.word]).get(focus.word.lower(), ())) if focus else []
        if focus and focus.word.lower() in E.FOCUS_NOUNS:
            types = list(dict.fromkeys([*types, E.FOCUS_NOUNS[focus.word.lower()]]))
        if types:
            known = {r.term: (r.entity_type,) for r in self.dictionary.where(F.lower("term").isin([w.lower() for w in parsed.words])).collect()}
            asked = list(E.tag_text(parsed.text, known))
            scored = A.combined(A.focus_scores(E.tagged(scored, self.dictionary), asked, types)).drop("entities", "focus_count", "focus_score")
        ranked = A.top_per_question(A.deduplicated(scored).withColumns({"qid": F.lit(0), "question": F.lit(question)}), max(most, S.MOST_RERANKED if rerank else most))
        ordered = S.reranked(ranked, self.scorer) if rerank else ranked
        return ordered.where(F.col("rank") <= most).drop("qid", "question")

    def ask(self, question: str, most: int = 10, mode: str = "baseline", rerank: bool = False) -> list[dict]:
        """The answers as a list, from the cache if the same was asked before."""
        found = self.cache.get(question, mode, rerank, most)
        if found is None:
            rows = self.ask_table(question, most, mode, rerank).orderBy("rank").collect()
            found = [{"s": r.sentence, "pmid": str(r.doc_id), "score": float(r.score)} for r in rows]
            self.cache.put(found, question, mode, rerank, most)
        return found


def ask_batch(docs: DataFrame, questions: DataFrame, vocabulary: DataFrame, vectors: DataFrame, most: int = 10, docs_per_question: int = 2000) -> DataFrame:
    """(qid, doc_id, sid, sentence, score, rank) for a whole table of questions (qid, question) in one plan.

    Each question asks for all its known words; documents are found by one equi-join of terms and ordered by the sum of the weights that they share; the sentences of the
    best ``docs_per_question``, as many as :class:`Engine` takes, are ranked by relaxed word mover's similarity and deduplicated. No loop over questions, no collected rows.
    """
    from pyspark.sql import Window

    from quaero.operators.vocabulary import terms

    asked = terms(questions, "qid", "question").select("qid", "term").distinct().join(vocabulary.select("term", "weight"), "term")
    hits = terms(docs).select("doc_id", "term").distinct().join(asked, "term")
    found = hits.groupBy("qid", "doc_id").agg(F.sum("weight").alias("s"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("s", 9)), "doc_id"))).where(F.col("n") <= docs_per_question).select("qid", "doc_id")
    ready_to_checkpoint(docs.sparkSession)
    scored = sentence_scores(docs, best.checkpoint(), asked.select("qid", "term"), vectors, vocabulary, Keep(most))
    return A.top_per_question(A.deduplicated(scored, key=["qid"]), most)
