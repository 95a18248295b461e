"""Scorers that may be trained models: keyword selection, keyword order, reranking. Each has a default without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the scorers' contracts.
KEYWORD_THRESHOLD, MOST_TOKENS, MOST_RERANKED = 0.5, 40, 100


class KeywordScorer(Protocol):
    def __call__(self, words: list[str], tags: list[str]) -> list[float]: ...


class PairScorer(Protocol):
    """Probabilities that each sentence answers its question, in the given order."""

    def __call__(self, questions: list[str], sentences: list[str]) -> list[float]: ...


def noun_or_adjective(words: list[str], tags: list[str]) -> list[float]:
    return [1.0 if t[:1] in ("N", "J") else 0.0 for t in tags]


def select_keywords(words: list[str], tags: list[str], scorer: KeywordScorer = noun_or_adjective) -> list[str]:
    """Words with a probability of one half or more, among the first 40."""
    n = MOST_TOKENS
    return [w for w, p in zip(words[:n], scorer(words[:n], tags[:n]), strict=True) if p >= KEYWORD_THRESHOLD]


def order_keywords(words: list[str], weights: dict[str, float], prefers: Callable[[str, str], float] | None = None) -> list[str]:
    """By falling weight, or merged from pairwise preferences above one half."""
    if prefers is None:
        return sorted(dict.fromkeys(words), key=lambda w: -weights.get(w.lower(), 1.0))
    from quaero.operators.ranking import merge_preferences

    pairs = [(a, b) for a in words for b in words if a != b and prefers(a, b) > 0.5]
    order = merge_preferences(pairs)
    return order + [w for w in dict.fromkeys(words) if w not in order]


def reranked(answers: DataFrame, scorer: PairScorer | None = None, key: str = "qid", most: int = MOST_RERANKED) -> DataFrame:
    """The first ``most`` answers of each question in the scorer's order, the rest behind them in theirs; scores stay. Without a scorer, or where it fails, the order stays.

    Needs (key, question, sentence, rank); the scorer sees Arrow batches of one partition.
    """
    if scorer is None:
        return answers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                p = scorer(b["question"].tolist(), b["sentence"].tolist())
            except Exception:  # noqa: BLE001  any failure of a model keeps the old order, by contract
                p = [None] * len(b)
            yield b[[key, "rank"]].assign(p=pd.Series(p, index=b.index, dtype="float64"))

    top = answers.where(F.col("rank") <= most).select(key, "rank", "question", "sentence")
    scored = top.mapInPandas(run, f"{key} {answers.schema[key].dataType.simpleString()}, rank {answers.schema['rank'].dataType.simpleString()}, p double")
    order = Window.partitionBy(key).orderBy(F.col("p").isNull(), F.desc("p"), "rank")
    return answers.join(scored, [key, "rank"], "left").withColumn("rank", F.row_number().over(order)).drop("p")


def fit_keyword_model(tokens: DataFrame, label: str = "label", columns: tuple[str, ...] = ("pos", "tag", "weight")):
    """A logistic regression on token rows with position, tag and idf weight; returns the fitted pipeline, which adds ``probability``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    place, tag, weight = columns
    stages = [
        StringIndexer(inputCol=tag, outputCol="__t", handleInvalid="keep"), OneHotEncoder(inputCols=["__t"], outputCols=["__o"]),
        VectorAssembler(inputCols=[place, "__o", weight], outputCol="__f"), LogisticRegression(featuresCol="__f", labelCol=label),
    ]
    return Pipeline(stages=stages).fit(tokens)
