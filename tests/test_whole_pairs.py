"""Queries that compare all with all, against brute force: whole results from bounded pieces."""

import math
import random

import numpy as np
import pytest

from quaero import queries as Q
from quaero.functions import vectors as V
from quaero.operators import ranking as R
from quaero.plans import batch as B


def test_sets_travel_as_bits_to_few_blocks(spark, tmp_path, monkeypatch):
    """Vectors do not travel once for every few others; pairs leave a task tile by tile."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.uniform(-1, 1, 3).tolist(), 0) for i in range(230)] + [(300, [0.5, None, 2.0], 0), (301, [0.1], 0), (302, [], 0), (303, None, 0), (301, [0.2, 0.3], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    low, high = ([f(r[1][d] for r in rows if r[1] and len(r[1]) > d and r[1][d] is not None) for d in range(3)] for f in (min, max))
    bits: dict = {}
    for i, v, _ in rows:
        for d, x in enumerate(v or []):
            at = 0 if x is None else max(0, int(np.ceil((x - low[d]) / ((high[d] - low[d]) / 8))) - 1)
            if at < 8:
                bits.setdefault(i, []).append(8 * d + at)
    got = {r.vec_id: r.bits for r in V.bit_sets(Q.table(spark, str(tmp_path), "embeddings"), "vec_id", 8).collect()}
    assert {i: b for i, b in got.items() if i != 300} == {i: sorted(b) for i, b in bits.items() if i != 300}
    asked, pairs = [], V.jaccard_pairs
    monkeypatch.setattr(V, "jaccard_pairs", lambda sets, key, blocks: asked.append(blocks) or pairs(sets, key, blocks))
    monkeypatch.setattr(Q, "BLOCK_ROWS", 10)
    monkeypatch.setattr(V, "TILE", 7, raising=False)
    found = Q.jaccard_bits(spark, str(tmp_path))
    want = {(a, b): len({*x} & {*y}) / len({*x} | {*y}) for a, x in got.items() for b, y in got.items() if a < b and {*x} & {*y}}
    rows = found.collect()
    assert len(rows) == len(want) and {(r.a, r.b): r.jaccard for r in rows} == pytest.approx(want, abs=6e-7)
    assert asked == [8]


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    product = sum(x * y for x, y in zip(a, b, strict=True))
    return 0.0 if product == 0 else round(product / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)


def nearest(rows, probe, k):
    vector = next(v for i, v, _ in rows if i == probe)
    each = sorted(((cosine(vector, v), i, label) for i, v, label in rows if i is not None and i != probe), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    return each[:k]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_every_vector_is_a_probe(spark, tmp_path, monkeypatch, kind):
    """Not only ids divisible by 100; whether probes or pieces of the vectors are sent to the tasks, copies and vectors without a cosine included."""
    rng = np.random.default_rng(9)
    rows = [(i, np.float32(rng.normal(size=5)).tolist(), i % 4) for i in range(130)] + [(i, [1.0, 0.5, -2.0, 0.25, 0.0], i % 3) for i in range(130, 160)]
    rows += [(160, [0.0] * 5, 1), (161, None, 2), (162, [1.0, 2.0], 3), (163, [2.0, 2.0], 0), (164, [1.0, None, 0.0, 0.0, 1.0], 1), (165, [], 2)]
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for i, _, own in rows:
        votes = [label for _, _, label in nearest(rows, i, 5)]
        want[i] = (own, *min((-votes.count(x), x) for x in votes))
    assert {r.probe: (r.own, -r.n, r.voted) for r in Q.knn_label(spark, str(tmp_path)).collect()} == want
    for name, value in (("PROBES_AT_ONCE", 50), ("PROBES_OF_TASK", 40), ("NUMBERS_AT_ONCE", 200), ("PROBES_TOGETHER", 7), ("VECTORS_TOGETHER", 9)):
        monkeypatch.setattr(R, name, value)
    assert {r.probe: (r.own, -r.n, r.voted) for r in Q.knn_label(spark, str(tmp_path)).collect()} == want
    table = Q.table(spark, str(tmp_path), "embeddings")
    for k in (3, 300):
        got = sorted(((r.probe, r["rank"], r.vec_id, r.cos) for r in R.top_similar(table, table, k).collect()))
        assert got == [(i, n, j, c) for i, _, _ in sorted(rows, key=lambda r: r[0]) for n, (c, j, _) in enumerate(nearest(rows, i, k), 1)]


def test_best_sentences_of_every_question(spark, tmp_path, monkeypatch):
    """Not only ids divisible by 100; in runs of words, blocks of questions and with sentences that leave their task, as the scores of all sentences say."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([4, 40])]).upper() + rng.choice([" ", " ", "! ", ". "]) for _ in range(rng.randint(1, 30)))
    docs = [(i, text()) for i in range(120)] + [(120, None), (121, " ... ?"), (122, "\xa0. w3"), (123, "unseen")] + [(i, "w1 w2. w39") for i in range(200, 230)]
    items = [(0, "w1 w7 w30 none"), (1, "w2 W2 w39"), (57, "w3. w3 w14 w15 w9 w26"), (100, "nothing known"), (101, ""), (102, None), (103, " ".join(words))]
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    put(docs, "doc_id long, text string", "documents")
    put(items, "item_id long, text string", "benchmark")
    put([(i, [rng.uniform(-1, 1) for _ in range(6)], 0) for i in range(25)], "vec_id long, embedding array<double>, label int", "embeddings")
    monkeypatch.setattr(Q, "EVERY", 1)
    scores = {}
    for r in Q.rwmd_score(spark, str(tmp_path)).collect():
        scores.setdefault(r.qid, []).append((-r.score, r.doc_id, r.sid))
    monkeypatch.setattr(Q, "EVERY", 100)
    want = {(q, d, s, n) for q, rows in scores.items() for n, (_, d, s) in enumerate(sorted(rows)[:10], 1)}
    assert {q for q, *_ in want} == {0, 1, 57, 100, 103} and len(want) == 50
    for settings in ({}, {"FREQUENT": 5, "TOGETHER": 3, "BYTES_AT_ONCE": 40, "WORDS_TOGETHER": 7, "NUMBERS": 1000}, {"FREQUENT": 0, "TOGETHER": 1, "BYTES_AT_ONCE": 1, "QUESTIONS_AT_ONCE": 2}):
        for name, value in settings.items():
            monkeypatch.setattr(B, name, value, raising=False)
        rows = [tuple(r) for r in Q.rwmd_rank(spark, str(tmp_path)).collect()]
        assert len(rows) == len(want) and set(rows) == want
