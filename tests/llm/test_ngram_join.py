import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaero.llm import ngram_join as J

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text, width):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    root = {i: i for i in [*ids, None]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                if x != y:
                    low, high = (x, y) if y is None or (x is not None and x < y) else (y, x)
                    root[high] = low
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=key)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_equals_brute_force(docs, rows, width, percent):
    assert result(J.near_duplicates(docs, width, percent)) == brute(rows, width, percent)


def test_odd_rows(odd):
    assert result(J.near_duplicates(odd, 4, 85)) == brute([(r.doc_id, r.text) for r in odd.collect()], 4, 85)


def test_empty(empty):
    assert J.near_duplicates(empty).collect() == []


def test_one_of_each(docs, rows):
    stay = {r.doc_id for r in J.one_of_each(docs).collect()}
    assert stay == {i for i, _, root in brute(rows, 5, 80) if i == root}
    assert J.one_of_each(docs).columns == docs.columns


def test_rows_that_share_an_id(spark):
    """Null ids and one id with several texts: clean texts stay, and a copy under an id does not hide the id's other rows."""
    clean = [" ".join(f"{name}{k}" for k in range(40)) for name in "abcdefgh"]
    near = lambda text: text + " end"
    rows = [(1, clean[0]), (5, clean[0]), (5, clean[1]), (9, near(clean[1])), (None, clean[2]), (None, clean[3]), (None, near(clean[3])), (None, clean[0]), (None, clean[4]), (7, near(clean[4]))]
    rows += [(8, clean[5]), (8, clean[6]), (8, clean[6]), (None, None), (2, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.near_duplicates(df, 5, 80)) == brute(rows, 5, 80)
    got = [(r.doc_id, r.text) for r in J.one_of_each(df).collect()]
    assert len(got) == len(set(got)) == 10
    assert set(got) - {(None, clean[3]), (None, near(clean[3]))} == {(1, clean[0]), (5, clean[1]), (None, clean[2]), (7, near(clean[4])), (8, clean[5]), (8, clean[6]), (None, None), (2, ""), (3, "")}


def test_one_of_each_of_odd_rows(odd):
    rows = list(dict.fromkeys((r.doc_id, r.text) for r in odd.collect()))
    groups = brute([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    want = sorted(min((rows[k][0] is None, rows[k][0] or 0) for k, _, root in groups if root == top) for top in {root for *_, root in groups})
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in J.one_of_each(odd).collect()) == want


@pytest.mark.parametrize("block", [4000, 12000])
def test_large_groups_in_blocks(spark, monkeypatch, block):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 5, 6])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words[60:] + words[:60] if i % 3 == 0 else words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "BLOCK_BYTES", block)
    assert result(J.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 400), st.integers(60, 95))
def test_similar_sets_share_a_signature(seed, n, percent):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 2**63, n).astype(np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(0, n // 8 + 2)).astype(np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(0, n // 8 + 2)).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    if 100 * both < percent * (len(a) + len(b) - both):
        return
    every = np.union1d(a, b)
    ranks = dict(zip(every.tolist(), rng.integers(1, 4, len(every)).tolist(), strict=True))
    rank = lambda s: np.array([ranks[x] if x in common else 0 if rng.random() < 0.5 and x not in np.intersect1d(a, b) else ranks[x] for x in s.tolist()], np.uint8)
    assert len(np.intersect1d(J.signatures(a, rank(a), percent), J.signatures(b, rank(b), percent)))


def test_word_hashes(monkeypatch):
    text = ("alpha  Beta\tg\n" * 50 + "z" * 300 + " end").encode()
    whole = J.word_hashes(text)
    monkeypatch.setattr(J, "PIECE", 64)
    assert J.word_hashes(text).tolist() == whole.tolist()
    assert len(whole) == 152 and J.hash_long(b"end") == whole[-1] and len(J.word_hashes(b" \t ")) == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_fold(percent):
    """Lists of signatures connect the same documents whether or not buckets fold theirs first."""
    rng = np.random.default_rng(percent)
    n = 400
    size = rng.integers(1, 400, n)
    rows = np.unique(np.array([(s, i, size[i]) for i in range(n) for s in rng.integers(0, 60, 3)], J._SIGN))

    def connected(rows, links):
        pairs = [links]
        for s in np.unique(rows["s"]):
            mine = np.sort(rows[rows["s"] == s], order=["n", "id"])
            fits = 100 * mine["n"][:-1].astype(np.int64) >= percent * mine["n"][1:].astype(np.int64)
            pairs.append(np.stack([mine["id"][1:], mine["id"][:-1]], 1)[fits])
        return {tuple(p) for p in J.spanning(np.concatenate(pairs)).tolist()}

    parts = [J._fold(rows[rows["id"] % 3 == b], J._size_ranges(percent)) for b in range(3)]
    folded, links = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    assert len(folded) < len(rows) and len(links)
    assert connected(folded, links) == connected(rows, np.zeros((0, 2), np.int64))
