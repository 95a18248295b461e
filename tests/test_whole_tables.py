"""The whole-table queries against brute force."""

import math
import random
import re

import pytest

from quaero import queries as Q

RNG = random.Random(11)
VECTORS = [(i, [RNG.uniform(-1, 1) for _ in range(3)], i % 4) for i in range(230)]
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
SENTENCES = {d: [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 6))) + "." for _ in range(RNG.randint(1, 3))] for d in (3, 59, 60, 200, 900)}
ITEMS = {0: "alpha beta unknown", 1: "gamma", 100: "theta iota kappa"}
TURNS = [(c, t, "x" * RNG.randint(1, 4)) for c in (1, 49, 50, 77) for t in range(4)]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def nearest(probe, k):
    found = sorted((-round(cosine(VECTORS[probe][1], v), 6), i) for i, v, _ in VECTORS if i != probe)
    return [i for _, i in found[:k]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    put(VECTORS, "vec_id long, embedding array<double>, label int", "embeddings")
    put([(d, " ".join(s)) for d, s in SENTENCES.items()], "doc_id long, text string", "documents")
    put(list(ITEMS.items()), "item_id long, text string", "benchmark")
    put(TURNS, "conv_id long, turn int, text string", "conversations")
    return at


def test_vector_searches(spark, folder):
    got = Q.cosine_topk_all(spark, folder).orderBy("probe", "rank").collect()
    assert [(r.probe, r.vec_id) for r in got] == [(p, i) for p in (0, 100, 200) for i in nearest(p, 10)]
    want = {}
    for p in (0, 100, 200):
        votes = [VECTORS[i][2] for i in nearest(p, 5)]
        want[p] = min((-votes.count(v), v) for v in votes)
    assert {r.probe: (-r.n, r.voted) for r in Q.knn_label_all(spark, folder).collect()} == want


def test_jaccard_join(spark, folder, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_ROWS", 60)
    bits = {r.vec_id: set(r.bits) for r in Q.V.bit_sets(Q.table(spark, folder, "embeddings"), "vec_id", 8).collect()}
    want = {(a, b): len(bits[a] & bits[b]) / len(bits[a] | bits[b]) for a in bits for b in bits if a < b and bits[a] & bits[b]}
    rows = Q.jaccard_bits_all(spark, folder).collect()
    assert len(rows) == len(want) and {(r.a, r.b): r.jaccard for r in rows} == pytest.approx(want, abs=1e-6)


def test_pairs_of_turns(spark, folder):
    want = {(c, t, u, int(len(x) > len(y))) for c, t, x in TURNS for d, u, y in TURNS if c == d and t != u and len(x) != len(y)}
    rows = [tuple(r) for r in Q.ordered_pairs_all(spark, folder).collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_sentences_of_all_documents(spark, folder):
    texts = {d: " ".join(s).lower() for d, s in SENTENCES.items()}
    df = {w: sum(w in re.findall(r"\w+", t) for t in texts.values()) for w in WORDS}
    top = max(-math.log(n / len(texts)) for n in df.values() if n)
    known = sorted((w for w in WORDS if df[w]), key=lambda w: (-df[w], w))
    weight = {w: -math.log(df[w] / len(texts)) / top for w in known}
    vector = {w: VECTORS[k % len(VECTORS)][1] for k, w in enumerate(known)}
    want = {}
    for q in (0, 100):
        terms = [w for w in ITEMS[q].split() if w in weight]
        for d, sentences in SENTENCES.items():
            for n, sentence in enumerate(sentences):
                words = [w for w in re.findall(r"\w+", sentence) if w in weight]
                above = sum(weight[t] * max([-1.0, *(cosine(vector[t], vector[w]) for w in words)]) for t in terms) if words else 0
                below = sum(weight[t] for t in terms)
                want[q, d, n] = above / below if above > 0 and below > 0 else 0.0
    got = {(r.qid, r.doc_id, r.sid): r.score for r in Q.rwmd_score_all(spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-4)
    ranked = {(r.qid, r.doc_id, r.sid) for r in Q.rwmd_rank_all(spark, folder).collect()}
    order = lambda q: sorted((k for k in got if k[0] == q), key=lambda k: (-got[k], k))[:10]
    assert ranked == {*order(0), *order(100)} and any(d >= 60 for _, d, _ in ranked)
