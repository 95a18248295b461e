import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.functions import vectors as V
from quaero.operators import pairwise as PW
from quaero.operators.spans import inside
from quaero.operators.timings import Timings


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    tower = PW.Tower.fresh(4, 3)
    a, z, label = rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    loss, gradient = tower.loss_and_gradient(a, z, label)
    plain = sum(np.log1p(np.exp(-(1 if y else -1) * float(tower.scores(p[None])[0] - tower.scores(q[None])[0]))) for p, q, y in zip(a, z, label, strict=True))
    assert loss == pytest.approx(plain)
    flat = tower.flat()
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (PW.Tower.packed(up, 4).loss_and_gradient(a, z, label)[0] - PW.Tower.packed(down, 4).loss_and_gradient(a, z, label)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, abs=1e-5)


def test_held_out_pairs_are_ordered(spark):
    rng = np.random.default_rng(4)
    worth = lambda v: v[0] * 2 - v[1] + np.sin(2 * v[2])
    items = {(q, i): rng.normal(size=3) for q in range(40) for i in range(5)}
    rows = [(q, f"w{i}", f"w{j}", items[q, i].tolist(), items[q, j].tolist(), int(worth(items[q, i]) > worth(items[q, j]))) for q in range(40) for i in range(5) for j in range(5) if i != j]
    pairs = spark.createDataFrame([*rows, (0, "a", "b", None, [1.0], 1), (0, "a", "b", [1.0], [2.0], None)], "qid long, a string, z string, va array<double>, vz array<double>, label int").repartition(4)
    tower = PW.fit(pairs.where("qid < 30"), 3, rounds=30)
    again = PW.fit(pairs.where("qid < 30"), 3, rounds=2)
    assert np.allclose(again.flat(), PW.fit(pairs.where("qid < 30"), 3, rounds=2).flat())
    frame = spark.createDataFrame([(q, f"w{i}", v.tolist()) for (q, i), v in items.items() if q >= 30], "qid long, item string, vector array<double>")
    for r in frame.withColumn("score", PW.score(F.col("vector"), tower)).collect():
        assert r.score == pytest.approx(float(tower.scores(np.array([r.vector]))[0]))
    held = pairs.where("qid >= 30").withColumn("p", F.when(PW.score(F.col("va"), tower) > PW.score(F.col("vz"), tower), 1.0).otherwise(0.0))
    right = held.agg(F.avg((F.col("p") == F.col("label")).cast("double"))).first()[0]
    assert right >= 0.9
    ranks = {(r.qid, r.item): r["rank"] for r in PW.ranked(frame, tower).collect()}
    for q in range(30, 40):
        order = sorted(range(5), key=lambda i: -float(tower.scores(items[q, i][None])[0]))
        assert [ranks[q, f"w{i}"] for i in order] == [1, 2, 3, 4, 5]
    assert np.array_equal(PW.fit(pairs.limit(0), 3).flat(), PW.Tower.fresh(3).flat())


def test_jaccard_of_all_pairs_by_matrices(spark):
    """Blocks of sets meet as matrices, not pair by pair; a half of the last digit is rounded up, bits that occur twice count once."""
    rng = np.random.default_rng(5)
    sets = {i: sorted(set(rng.integers(0, 40, rng.integers(0, 9)).tolist())) for i in range(-30, 120)} | {500: list(range(1000, 1065)), 501: list(range(1064, 1128)), 502: [1064, 1064]}
    frame = spark.createDataFrame([*sets.items(), (None, [1])], "vec_id long, bits array<int>").repartition(3)
    for blocks in (1, 3):
        pairs = V.jaccard_pairs(frame, "vec_id", blocks)
        plan = pairs._jdf.queryExecution().toString()
        assert "CoGroupsInArrow" in plan and "Join" not in plan
        got = {(r.a, r.b): r.jaccard for r in pairs.collect()}
        want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets.items() for b, y in sets.items() if a < b and set(x) & set(y)}
        assert got.keys() == want.keys() and got == pytest.approx(want, abs=6e-7)
        assert got[500, 501] == 0.007813
    assert V.jaccard_pairs(frame.limit(0), "vec_id", 2).collect() == []


def test_timings_of_steps_and_batches(spark):
    timings = Timings(spark)
    frame = spark.range(0, 1000, 1, 4)

    def run(batches):
        for b in batches:
            time.sleep(0.01)
            yield b

    passed = timings.observed(frame.mapInArrow(timings.batches("work", run), "id long"), "count")
    for _ in range(2):
        with timings.step("count"):
            n = passed.count() if not timings.found.value.get("count") else frame.count()
    assert n == 1000
    rows = {r.label: r for r in timings.table().collect()}
    assert rows["count"]["count"] == 2 and rows["work"]["count"] >= 4 and rows["count"].rows == 1000 and rows["work"].rows is None
    for r in rows.values():
        assert 0 < r.least <= r["mean"] <= r.most
    assert rows["work"].least >= 0.01
    assert Timings(spark).table().collect() == []


def test_spans_inside_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    spans = lambda n: [(int(k), int(a), int(a + w)) for k, a, w in zip(rng.integers(0, 6, n), rng.integers(0, 20, n), rng.integers(0, 9, n), strict=True)]
    inner, outer = spans(150) + [(7, 1, 2), (None, 1, 2), (1, None, 2)], spans(90) + [(None, 0, 9), (2, 0, 30), (2, 0, 30)]
    want = set()
    for k, a, z in set(inner):
        around = [(y - x, x, y) for q, x, y in outer if q == k and k is not None and a is not None and x <= a and z <= y]
        if around:
            want.add((k, a, z, *max(around)[1:]))
    frame = lambda rows: spark.createDataFrame(rows, "k int, start int, end int").repartition(3)
    got = inside(frame(inner), frame(outer), "k")
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["k", "start", "end", "outer_start", "outer_end"]
    assert inside(frame(inner).limit(0), frame(outer), "k").collect() == []
    assert "spans_inside" in [f.name for f in spark.catalog.listFunctions()]
