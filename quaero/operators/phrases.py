"""Many phrases at once: an Aho-Corasick automaton over the words of a text, and its use on tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.operators.vocabulary import lower_words

#: Phrases that travel to the executors as one automaton; beyond it phrases are looked up by a join.
MOST_AT_ONCE = 200_000
#: Occurrences that a task holds before it passes them on.
FOUND_AT_ONCE = 1 << 15

_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def words_of(text: str) -> list[str]:
    """Search words of a text, as :func:`quaero.operators.vocabulary.lower_words` gives them."""
    return _WORD.findall(text.lower())


class Automaton:
    """Finds every phrase of a list in a list of words in one pass, whatever the length of the phrases and however they overlap."""

    def __init__(self, phrases: Iterable[Sequence[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        self.size: list[int] = []
        for k, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                if word not in self.next[state]:
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                state = self.next[state][word]
            if phrase:
                self.ends[state] += (k,)
            self.size.append(len(phrase))
        self.back = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:  # states by depth, so that the shorter ends of a state are complete
            state = queue.popleft()
            for word, then in self.next[state].items():
                at = self.back[state]
                while at and word not in self.next[at]:
                    at = self.back[at]
                self.back[then] = self.next[at].get(word, 0)
                self.ends[then] += self.ends[self.back[then]]
                queue.append(then)

    def find(self, words: Iterable[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, word behind the last, number of the phrase), by end."""
        state = 0
        for i, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.back[state]
            state = self.next[state].get(word, 0)
            for k in self.ends[state]:
                yield i - self.size[k], i, k

    def found(self, words: Iterable[str]) -> set[int]:
        """Numbers of the phrases that occur."""
        state, found, next_, back, ends = 0, set(), self.next, self.back, self.ends
        for word in words:
            while state and word not in next_[state]:
                state = back[state]
            state = next_[state].get(word, 0)
            if ends[state]:
                found.update(ends[state])
        return found


def phrase_sets(docs: DataFrame, phrases: list[tuple[str, ...]], key: str = "doc_id") -> DataFrame:
    """(key, found): for each document with one, the numbers of the phrases in its text as ascending 32-bit integers. ``phrases`` is what a caller has checked to be few."""
    if len(phrases) > MOST_AT_ONCE:
        raise ValueError(f"{len(phrases)} phrases are too many for one automaton; deal them into blocks")
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            sets = [automaton.found(words_of(t.as_py())) for t in b["text"]]
            kept = [i for i, s in enumerate(sets) if s]
            packed = pa.array([np.array(sorted(sets[i]), np.int32).tobytes() for i in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([b[key].take(pa.array(kept, pa.int64())), packed], [key, "found"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.length("text") > 0).select(key, "text").mapInArrow(run, f"{key} {kind}, found binary")


def occurrences(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", column: str = "text", most: int = MOST_AT_ONCE) -> DataFrame:
    """(key, start, size, phrase): every occurrence of every phrase of (phrase) in a text, counted in words; phrases without a word have none.

    Up to ``most`` phrases are one automaton on every executor. More are looked up by a join: each text's words meet the phrases that begin with them, and the
    words that follow are compared in place.
    """
    listed = phrases.select("phrase", lower_words(F.col("phrase")).alias("words")).where(F.size("words") > 0).distinct()
    rows = listed.limit(most + 1).collect()
    if len(rows) > most:
        words = docs.select(key, lower_words(F.col(column)).alias("w"))
        at = words.select(key, "w", F.posexplode("w").alias("start", "first"))
        met = at.join(listed.withColumn("first", F.col("words")[0]), "first").where(F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words"))
        return met.select(key, "start", F.size("words").alias("size"), "phrase")
    names = [r.phrase for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast((Automaton([r.words for r in rows]), names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value[0]
        for b in batches:
            found: list[tuple[int, int, int, int]] = []
            for i, t in enumerate(b["text"]):
                for a, z, k in automaton.find(words_of(t.as_py() or "")):
                    found.append((i, a, z - a, k))
                    if len(found) >= FOUND_AT_ONCE:
                        yield batch(b, found)
                        found = []
            if found:
                yield batch(b, found)

    def batch(b: pa.RecordBatch, found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        rows, start, size, number = np.array(found).T
        return pa.RecordBatch.from_arrays([b["key"].take(pa.array(rows)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array([shared.value[1][k] for k in number.tolist()], pa.string())], [key, "start", "size", "phrase"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInArrow(run, f"{key} {kind}, start int, size int, phrase string")
