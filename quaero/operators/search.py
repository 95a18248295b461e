"""Retrieval: Boolean search compiled to one scan, relaxation ladders counted in one pass, strategies and their unions."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaero.operators.vocabulary import terms as term_rows
from quaero.plans.query import Query

#: Fixed values of the retrieval strategies.
MOST_DOCS, ENOUGH_DOCS, TOO_MANY_DOCS, FEW_DOCS = 2000, 40, 1000, 10


def searchable(docs: DataFrame) -> DataFrame:
    """Documents with a text, and that text lower-cased."""
    return docs.where(F.length("text") > 0).withColumn("__lower", F.lower("text"))


def search(docs: DataFrame, query: Query, most: int = MOST_DOCS, connective: str = "AND") -> DataFrame:
    """Matching documents with ``score``, best first, ``most`` at most (a top-k without a full sort)."""
    hits = searchable(docs).where(query.predicate(F.col("__lower"), connective)).withColumn("score", query.score(F.col("__lower")))
    return hits.drop("__lower").orderBy(F.desc("score"), "doc_id").limit(most)


def count(docs: DataFrame, query: Query, connective: str = "AND") -> int:
    return searchable(docs).where(query.predicate(F.col("__lower"), connective)).count()


def by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Point look-ups as one join that keeps the look-up's other columns, such as its rank."""
    return docs.join(ids, key)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, pos): an index for selective terms, to be written bucketed by term."""
    return term_rows(docs)


def search_postings(index: DataFrame, words: Sequence[str]) -> DataFrame:
    """doc_ids that have all the words, from an index: equality on the term reaches the scan."""
    wanted = sorted({w.lower() for w in words})
    hits = index.where(F.col("term").isin(wanted)).select("doc_id", "term").distinct()
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def ladder_counts(docs: DataFrame, query: Query) -> list[tuple[Query, int]]:
    """All relaxations with their numbers of matches, counted in one scan."""
    rungs = list(query.ladder())
    if not rungs:
        return []
    row = searchable(docs).agg(*(F.count_if(q.predicate(F.col("__lower"))).alias(f"r{k}") for k, q in enumerate(rungs))).first()
    return [(q, row[k]) for k, q in enumerate(rungs)]


def chosen_rung(counts: Sequence[int], enough: int = ENOUGH_DOCS) -> int | None:
    """The rung of a ladder to run, from the matches of each: the first with ``enough``. Past 1000 matches the last smaller one is used instead if it has more than 10;
    None if the last that was looked at has no match."""
    remembered, rung, n = None, None, 0
    for rung, n in enumerate(counts):
        if n >= enough:
            break
        if n:
            remembered = rung
    if n > TOO_MANY_DOCS and remembered is not None and counts[remembered] > FEW_DOCS:
        return remembered
    return rung if n else None


def relax(docs: DataFrame, query: Query, enough: int = ENOUGH_DOCS, ensemble: bool = False) -> tuple[Query, str] | None:
    """The rung to run (:func:`chosen_rung`) and its connective; with no match it is the OR query, or None inside an ensemble."""
    counted = ladder_counts(docs, query)
    rung = chosen_rung([n for _, n in counted], enough)
    if rung is not None:
        return counted[rung][0], "AND"
    return None if ensemble or not query.groups else (query, "OR")


def retrieve(docs: DataFrame, query: Query, strategy: str = "baseline", most: int = MOST_DOCS) -> DataFrame:
    """``baseline``: the ladder. ``keyword`` and ``rank``: parts are popped from the end until something matches. Either falls back on OR."""
    if strategy == "baseline":
        found = relax(docs, query)
        return search(docs, *(found[:1] if found else (query,)), most, found[1] if found else "AND")
    rungs = []
    rung: Query | None = query
    while rung is not None:
        rungs.append(rung)
        rung = rung.without_last()
    row = searchable(docs).agg(*(F.count_if(q.predicate(F.col("__lower"))).alias(f"r{k}") for k, q in enumerate(rungs))).first()
    best = next((q for k, q in enumerate(rungs) if row[k]), None)
    return search(docs, query, most, "OR") if best is None else search(docs, best, most)


def ordered_union(lists: Sequence[DataFrame], key: str = "doc_id", most: int = MOST_DOCS) -> DataFrame:
    """Ranked lists one after another, each id where it comes first; every list needs a ``rank`` from 1."""
    together = None
    for k, one in enumerate(lists):
        tagged = one.select(key, F.lit(k).alias("src"), "rank")
        together = tagged if together is None else together.unionByName(tagged)
    first = together.groupBy(key).agg(F.min(F.struct("src", "rank")).alias("at"))
    return first.orderBy("at", key).limit(most).select(key, F.row_number().over(Window.orderBy("at", key)).alias("rank"))


def ranked(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """A top-k list with its rank from 1; k rows, never a table."""
    return results.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def append_new(found: DataFrame, more: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.unionByName(more.join(found, key, "left_anti"), allowMissingColumns=True)


def selection_chances(weights: Sequence[float], policy: str, step: int) -> list[float]:
    """How likely each term is the next one to go. ``roulette``: by 1 / weight; ``uniform``: equally; ``annealed``: by exp(share / temperature), where the share is that of the roulette and the
    temperature of step n (from 1) is 1 / ln(n + 1): early choices are nearly uniform, later ones take light terms."""
    if policy == "uniform":
        return [1.0] * len(weights)
    inverse = [1 / max(w, 1e-6) for w in weights]
    if policy == "roulette":
        return inverse
    if policy != "annealed":
        raise ValueError(f"no policy {policy!r}")
    total, heat = sum(inverse), math.log(step + 1)
    return [math.exp(x / total * heat) for x in inverse]


def removal_sequences(query: Query, n: int, seed: int, policy: str = "roulette") -> list[list[Query]]:
    """``n`` random orders of taking terms away, by :func:`selection_chances`; the seed decides them."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        q, sequence = query, [query]
        while q.n_terms > 1:
            pool = [t for p in q.parts for t in p.terms]
            gone = rng.choices(pool, selection_chances([t.weight for t in pool], policy, len(sequence)))[0]
            q = q.without_term(gone.text)
            if q.n_terms:
                sequence.append(q)
        out.append(sequence)
    return out


def best_sequences(docs: DataFrame, query: Query, gold: DataFrame, n: int = 30, stop_above: int = 5, seed: int = 1, policy: str = "roulette") -> tuple[list[Query], float]:
    """The removal sequence with the best 0.5 recall + 0.5 precision where it first has more than ``stop_above`` matches; all rungs are counted in one scan."""
    sequences = removal_sequences(query, n, seed, policy)
    rungs = {q.rendered(): q for s in sequences for q in s}
    names = list(rungs)
    marked = searchable(docs).join(gold.select("doc_id", F.lit(True).alias("gold")), "doc_id", "left")
    hits = {name: rungs[name].predicate(F.col("__lower")) for name in names}
    row = marked.agg(F.count_if("gold").alias("g"), *(x for k, name in enumerate(names) for x in (F.count_if(hits[name]).alias(f"n{k}"), F.count_if(hits[name] & F.col("gold")).alias(f"h{k}")))).first()
    n_of = {name: (row[f"n{k}"], row[f"h{k}"]) for k, name in enumerate(names)}

    def value(sequence: list[Query]) -> float:
        for q in sequence:
            found, right = n_of[q.rendered()]
            if found > stop_above:
                return 0.5 * right / max(row["g"], 1) + 0.5 * right / found
        return 0.0

    best = max(sequences, key=value, default=[])
    return best, value(best) if best else 0.0


class Session:
    """Interactive refinement of one query per question: build, retrieve, remove a term, measure coverage."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        self.queries: dict[str, Query] = {}

    def build(self, question: str, query: Query) -> str:
        self.queries[question] = query
        return query.rendered()

    def remove_term(self, question: str, term: str) -> str:
        self.queries[question] = self.queries[question].without_term(term)
        return self.queries[question].rendered()

    def retrieve(self, question: str, most: int = MOST_DOCS) -> DataFrame:
        return search(self.docs, self.queries[question], most)

    def coverage(self, question: str, gold: DataFrame) -> tuple[int, int]:
        """(gold documents found, gold documents)."""
        wanted = gold.select("doc_id").distinct()
        return self.retrieve(question).join(wanted, "doc_id", "left_semi").count(), wanted.count()
