"""Operators that SQL cannot express against plain loops: the ring, the ordinal likelihood, the pipeline on odd and empty tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.llm import ordinal_grades as O
from quaero.llm import ring_shards as S


def _walk(slot, n_shards, nodes, slots):
    """Shards met clockwise from a slot, a node at a time."""
    at = {}
    for shard in range(n_shards):
        for v in range(nodes):
            place = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % slots
            at.setdefault(place, shard)
    met = []
    for k in range(slots):
        shard = at.get((slot + k) % slots)
        if shard is not None and shard not in met:
            met.append(shard)
        if len(met) == n_shards:
            return met
    return met


@pytest.mark.parametrize("n_shards", [3, 8])
def test_ring_row_at_a_time(spark, docs, n_shards):
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).collect()
    slots = 1 << S.SLOT_BITS
    waiting = []
    for r in rows:
        text = (r.text or "").encode()
        position = r.h
        waiting.append(((position % 2**64) >> (64 - S.SLOT_BITS), position, r.doc_id, zlib.crc32(text) if r.text is not None else 0, len(text) + 1))
    waiting.sort(key=lambda w: w)
    room = [len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)]
    walks = {w[0]: _walk(w[0], n_shards, S.VIRTUAL_NODES, slots) for w in waiting}
    placed, used = {}, [0] * n_shards
    for k in range(n_shards):
        left = []
        for w in waiting:
            shard = walks[w[0]][k]
            if used[shard] < room[shard]:
                placed[w[2], w[3]] = shard, used[shard]
                used[shard] += 1
            else:
                left.append(w)
        waiting = left
    got = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in S.shard_documents(docs, n_shards).collect()}
    assert not waiting and got == placed


def _loss(weights, thresholds, rows, grades, penalty):
    """Mean negative log-likelihood of a cumulative-link model, row by row, with the penalty."""
    total = 0.0
    for features, grade in zip(rows, grades, strict=True):
        s = sum(weights[f] for f in features)
        below = [0.0, *(1 / (1 + math.exp(s - t)) for t in thresholds), 1.0]
        total -= math.log(below[grade + 1] - below[grade])
    return total / len(rows) + penalty / 2 * sum(w * w for w in weights.values())


def test_ordinal_weights_are_a_minimum_of_the_likelihood():
    rng = random.Random(3)
    rows, grades = [], []
    for _ in range(240):
        features = sorted(rng.sample(range(10), 4))
        worth = sum((f - 4.5) / 3 for f in features) + rng.gauss(0, 1)
        rows.append(np.array(features))
        grades.append(0 if worth < -0.7 else 1 if worth < 0.7 else 2)
    penalty = 1e-2
    model = O.train(rows, np.array(grades), least=1, evidence=0.0, steps=3000, rate=0.02, penalty=penalty)
    weights, thresholds = {f: float(model.weights[f]) for f in range(10)}, list(map(float, model.thresholds))
    assert thresholds == sorted(thresholds) and not model.weights[10:].any()
    best = _loss(weights, thresholds, rows, grades, penalty)
    for f in range(10):
        slope = (_loss(weights | {f: weights[f] + 1e-4}, thresholds, rows, grades, penalty) - _loss(weights | {f: weights[f] - 1e-4}, thresholds, rows, grades, penalty)) / 2e-4
        assert abs(slope) < 2e-3
    for k in range(2):
        up, down = thresholds.copy(), thresholds.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        assert abs(_loss(weights, up, rows, grades, penalty) - _loss(weights, down, rows, grades, penalty)) / 2e-4 < 2e-3
    for _ in range(50):
        moved = {f: w + rng.gauss(0, 0.1) for f, w in weights.items()}
        assert _loss(moved, [t + rng.gauss(0, 0.1) for t in thresholds[:1]] + [thresholds[1] + 0.5], rows, grades, penalty) > best - 1e-6
    scores = np.array([sum(weights[int(f)] for f in r) for r in rows])
    p = model.probabilities(scores)
    for s, row in zip(scores, p, strict=True):
        assert row[2] == pytest.approx(1 - 1 / (1 + math.exp(s - thresholds[1])), abs=1e-6) and row.sum() == pytest.approx(1)


@pytest.fixture(scope="module")
def odd_folder(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    odd.drop("label").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "one two"), (2, None), (None, ""), (2, "alpha")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_pipeline_on_odd_and_empty_tables(spark, odd_folder, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, docs, odd_folder).checkpoint()
        assert kept.columns == columns, name
        if name != C.STAGES[3][0]:  # mixing repeats rows; the others take from their input
            assert kept.exceptAll(docs).isEmpty(), name
        docs = kept
    placed = C.STAGES[-1][1](spark, docs, odd_folder)
    counts = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert placed.count() == docs.count() and (not counts or max(counts) - min(counts) <= 1)
    at = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_folder}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    assert C.run(spark, at).collect() == []


def test_a_conversation_with_the_probe_s_number_stays_apart(spark, tmp_path):
    from quaero.llm.queries import op6_chat_template

    spark.createDataFrame([(-1, 0, "user", "hello"), (5, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.n_turns, r.turns_sha256) for r in op6_chat_template(spark, str(tmp_path)).collect())
    digest = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert got == sorted([(-1, 1, digest(("user", "hello"))), (-1, 2, digest(("user", said), ("assistant", said))), (5, 1, digest(("assistant", "")))])
