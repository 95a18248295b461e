"""The stored index and the inverted lists against plain loops."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaero.operators import index as IX
from quaero.operators import neighbours as N
from quaero.operators import preparation as P
from quaero.operators import search as S
from quaero.plans.query import Part, Query, Term

RNG = random.Random(8)
WORDS = ["a", "b", "c", "Dé", "e", "rare"]
TEXTS = [(d, " ".join(RNG.choices(WORDS, [9, 7, 5, 3, 2, 0.2], k=RNG.randint(0, 40))) + ".") for d in range(-20, 180)]
TEXTS += [(5, "a b c"), (5, "c b a"), (5, "a b c"), (None, "a b"), (400, None), (401, ""), (402, "...")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    IX_BLOCK, IX_SEGMENT = IX.BLOCK_DOCS, IX.SEGMENT_POSTINGS
    IX.BLOCK_DOCS, IX.SEGMENT_POSTINGS = 7, 300
    path = str(tmp_path_factory.mktemp("index") / "table")
    IX.write_index(spark.createDataFrame([(d, t, "x", 1) for d, t in TEXTS], "doc_id long, text string, term string, row int").repartition(4), path)
    IX.BLOCK_DOCS, IX.SEGMENT_POSTINGS = IX_BLOCK, IX_SEGMENT
    return path


def _words(text):
    return (text or "").lower().rstrip(".").split()


def test_blocks_keep_every_place(spark, stored):
    read = IX.postings(spark.read.schema(f"{IX._SCHEMA}, bucket int").parquet(stored))
    got = sorted((r.term, r.doc_id, tuple(r.places)) for r in read.collect())
    want = sorted((w, d, tuple(i for i, x in enumerate(_words(t)) if x == w)) for d, t in TEXTS if d is not None for w in set(_words(t)))
    assert got == want


def test_only_the_buckets_of_the_words_are_read(spark, stored):
    plan = IX.blocks_of(spark, stored, ["a", "rare"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    assert {r.term for r in IX.blocks_of(spark, stored, ["a", "rare"]).collect()} == {"a", "rare"}
    assert IX.blocks_of(spark, stored, []).collect() == []


@pytest.mark.parametrize(("phrase", "within"), [("a b", 0), ("A b, c", 0), ("a a a", 0), ("b rare", 0), ("a rare e", 3), ("dé", 0), ("none", 0), ("..", 0)])
def test_phrases(spark, stored, phrase, within):
    asked = _words(phrase.replace(",", ""))
    want = {}
    for d, t in TEXTS:
        words, n = _words(t), 0
        for i in range(len(words)):
            ends = {i} if asked and words[i] == asked[0] else set()
            for w in asked[1:]:
                ends = {j for e in ends for j in range(e + 1, min(e + 2 + within, len(words))) if words[j] == w}
            n += bool(ends)
        if n and d is not None and asked != [""]:
            want[d] = want.get(d, 0) + n
    assert {r.doc_id: r.n for r in IX.documents_with_phrase(spark, stored, phrase, within).collect()} == want


def test_all_words_and_the_best(spark, stored):
    for asked in (["a", "rare"], ["A", "b", "c"], ["none", "a"]):
        want = {d for d, t in TEXTS if d is not None and {w.lower() for w in asked} <= set(_words(t))}
        assert {r.doc_id for r in IX.documents_with_all(spark, stored, asked).collect()} == want
    weights = {"a": 0.3, "rare": 2.0, "dé": 0.7, "none": 5.0}
    scores = {}
    for d, t in TEXTS:
        counts = {w: _words(t).count(w) for w in weights}
        if d is not None and any(counts.values()):
            scores[d] = max(scores.get(d, 0), round(sum(x * counts[w] / (counts[w] + 1.2) for w, x in weights.items()), 9))
    order = sorted(scores, key=lambda d: (-scores[d], d))
    for k in (1, 10, 500):
        got = sorted(IX.top_documents(spark, stored, weights, k).collect(), key=lambda r: r["rank"])
        assert [r.doc_id for r in got] == order[:k]
        assert [r.score for r in got] == pytest.approx([scores[d] for d in order[:k]])
    assert IX.top_documents(spark, stored, {"none": 1.0}, 3).collect() == []


def _vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dims))
    rows = centres[rng.integers(0, 25, n)] + 0.4 * rng.normal(size=(n, dims))
    rows[: n // 3] = rows[0]  # a third of all rows is one vector
    return [(i, r.tolist()) for i, r in enumerate(rows)]


def test_inverted_lists_find_nine_tenths(spark):
    from quaero.operators import ranking as R

    rows = _vectors(2400, 16, 3)
    frame = spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 16), (9002, [1.0])], "vec_id long, embedding array<double>").repartition(6)
    probes = frame.where("vec_id % 100 = 3 and vec_id < 9000")
    q = N.fit(frame, most_rows=1500)
    indexed = N.index(frame.where("vec_id <> 9002"), q).checkpoint()
    assert indexed.count() == 2400 and indexed.where(F.length("code") != q.tables.shape[0]).isEmpty()
    found = N.search(indexed, frame, probes, q, lists=6).checkpoint()
    exact = R.top_similar(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes)
    assert N.recall(found, exact) >= 0.9
    assert 0 < N.scored_share(indexed, probes, q, 6) < 0.9
    for r in found.collect():
        a, b = np.array(rows[r.probe][1]), np.array(rows[r.vec_id][1])
        assert r.probe != r.vec_id and r.cos == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-6)
    again = N.search(indexed, frame, probes, N.fit(frame, most_rows=1500), lists=6)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))
    lists, again_ = N.tuned(indexed, frame.where("vec_id < 9000"), q)
    assert N.recall(N.search(indexed, frame, probes, q, lists=lists, again=again_), exact) >= 0.9
    everything = N.search(indexed, frame, probes, q, lists=1000, again=240)
    assert N.recall(everything, exact) == 1.0


def test_inverted_lists_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    q = N.fit(none)
    assert N.search(N.index(none, q), none, none, q).collect() == []


def test_prefix_join_without_a_theta_join(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 7))) for _ in range(120)]
    keys = ["".join(rng.choice("AB ") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    squeezed = lambda t: "".join(t.split()).lower()
    want = set()
    for k in keys:
        same = {i for i, t in enumerate(texts) if squeezed(t) == squeezed(k)}
        begun = [i for i, t in enumerate(texts) if squeezed(t).startswith(squeezed(k))]
        want |= {(k, i) for i in same} if same else {(k, min(begun))} if begun else set()
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = P.join_or_prefix(frame([(k,) for k in keys], "key string"), frame(list(enumerate(texts)), "id long, question string"))
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_drawn_negatives(spark):
    rows = [(q, i, int(i % 5 == 0)) for q in range(4) for i in range(q, 400, 4)]
    want = {r for r in rows if r[2]}
    for q in range(4):
        drawn = [r for r in rows if r[0] == q and not r[2] and (r[1] * 48271 + 3 * 69621) % 2147483647 % 10 == 0]
        want |= set(drawn[:4])
    got = P.drawn_negatives(spark.createDataFrame(rows, "q int, i long, label int"), "q", "i", "label", 3, 3)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("policy", ["roulette", "uniform", "annealed"])
def test_removal_policies(spark, policy):
    weights = {"a": 1.0, "b": 2.0, "c": 4.0, "rare": 8.0}
    query = Query.of(Part((Term(w, weight=x),)) for w, x in weights.items())
    rng, want = random.Random(5), []
    for _ in range(6):
        left, sequence = list(weights), []
        while len(left) > 1:
            shares = [1 / weights[w] for w in left]
            chances = {"roulette": shares, "uniform": [1] * len(left), "annealed": [math.exp(s / sum(shares) * math.log(5 - len(left) + 1)) for s in shares]}[policy]
            gone = rng.choices(left, chances)[0]
            left.remove(gone)
            sequence.append(list(left))
        want.append([list(weights), *sequence])
    got = S.removal_sequences(query, 6, 5, policy)
    assert [[[t.text for p in q.parts for t in p.terms] for q in s] for s in got] == want == [[[t.text for p in q.parts for t in p.terms] for q in s] for s in S.removal_sequences(query, 6, 5, policy)]
    docs = spark.createDataFrame([(d, t) for d, t in TEXTS if d is not None and d != 5], "doc_id long, text string")
    gold = {d for d, t in TEXTS if d is not None and d != 5 and "c" in _words(t) and d % 2}
    values = []
    for s in want:
        value = 0.0
        for terms in s:
            hits = {d for d, t in TEXTS if d is not None and d != 5 and set(terms) <= set(_words(t))}
            if len(hits) > 5:
                value = 0.5 * len(hits & gold) / len(gold) + 0.5 * len(hits & gold) / len(hits)
                break
        values.append(value)
    best, value = S.best_sequences(docs, query, spark.createDataFrame([(d,) for d in gold], "doc_id long"), 6, 5, 5, policy)
    assert value == pytest.approx(max(values))
    assert [[t.text for p in q.parts for t in p.terms] for q in best] == want[values.index(max(values))]


def test_a_full_segment_takes_less_than_half_a_gigabyte(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(IX, "TaskContext", Task)
    texts = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(500)) for i in range(400)]
    batches = [pa.record_batch({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t])}) for i, t in enumerate(texts)]
    tracemalloc.start()
    try:
        blocks = sum(len(b) for b in IX._segments(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert blocks == len({w for t in texts for w in t.split()})
    assert peak / (400 * 500) * IX.SEGMENT_POSTINGS < 1 << 29
