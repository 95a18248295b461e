"""The exact nearest vectors, by matrices in the tasks, against a plain loop."""

import math

import numpy as np
import pytest

from quaero.operators import ranking as R
from quaero.operators.best import Best


def _cos(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return 0.0 if dot == 0 else round(dot / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)


@pytest.mark.parametrize("together", [2, 16_384])
def test_top_similar_equals_all_pairs(spark, monkeypatch, together):
    monkeypatch.setattr(R, "PROBES_AT_ONCE", together)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(60, 90)] + [(90, [0.0] * 5), (91, None), (92, [1.0, 2.0]), (93, [1.0, None, 0.0, 0.0, 1.0]), (None, rows[0][1]), (5, rows[3][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    probes = [r for r in rows if r[0] in (0, 3, 60, 90, 91, 92)]
    for k in (3, 200):
        found = R.top_similar(frame, spark.createDataFrame(probes, frame.schema), k)
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "NestedLoop" not in plan
        want = []
        for p, v in probes:
            each = sorted(((_cos(v, w), i) for i, w in rows if i is not None and i != p), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
            want += [(p, i, c, n) for n, (c, i) in enumerate(each[:k], 1)]
        assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[3])) == sorted(want, key=lambda r: (r[0], r[3]))


def test_best_holds_few():
    best = Best(2, 3)
    for _ in range(200):
        best.offer(np.array([0, 1] * 1000), np.arange(2000), np.zeros(2000))
        assert sum(len(x[0]) for x in best.held) <= best.most_waiting + 2000
    probes, keys, values = best.found()
    assert probes.tolist() == [0, 0, 0, 1, 1, 1] and keys.tolist() == [0, 0, 0, 1, 1, 1] and not values.any()
