import random

import pytest

from quaero.llm import common as C


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_components(spark, monkeypatch, at_once):
    """A path, a star with a centre of many edges, a cycle, repeated and reversed edges, a loop, extreme ids."""
    monkeypatch.setattr(C, "EDGES_AT_ONCE", at_once)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1001 + k) for k in range(60)] + [(200, 201), (201, 202), (202, 200), (200, 201), (201, 200), (300, 300), (-(1 << 63), 1 << 62)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(60):
        for a, z in edges:
            if a != z:
                root[a] = root[z] = min(root[a], root[z])
    got = [tuple(r) for r in C.components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dict(got) == root and len(got) == len(root)


def test_likely_among(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    keys = rows.where("k % 50 = 7")
    got = {r.k for r in C.likely_among(rows, rows["k"], keys).collect()}
    assert got >= {k for k in range(5000) if k % 50 == 7} and len(got) < 400
    assert C.likely_among(rows, rows["k"], keys.limit(0)).count() == 0
