"""Collocations against counts over all phrases in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quaero.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, a string, id string, phrase int, block int"


def _pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def _expected(docs, longest, least, percent, most):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for p in _pieces(text or ""):
            n[lang] += len(p)
            f.update((lang, tuple(p[i : i + k])) for k in range(1, longest + 1) for i in range(len(p) - k + 1))
    often = {g: c for g, c in f.items() if c >= least and len(g[1]) > 1}
    rows = []
    for (lang, w), a in often.items():
        inside = lambda z: any(z[i : i + len(w)] == w for i in range(len(z) - len(w) + 1))  # noqa: B023, E731
        if any(x == lang and len(z) > len(w) and 100 * c >= percent * a and inside(z) for (x, z), c in often.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        rows.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        out += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(out)


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Été", "δ", "x", "new", "york", "stock", "exchange", "a" * 300, "\U0001f600", "ﬀ"]
    phrases = ["New York Stock Exchange", "alpha beta", "x x x x x x", "beta gamma\tδ", "alpha  beta gamma δ x"]
    docs = [(None, None), ("", "en"), (" \t. ,\n", None), ("İ K ſ", "en"), ("one", "en")]
    for _ in range(n):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(1, 30))]
        docs.append(("".join(p + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for p in parts), rng.choice(["en", "en", "en", "de", None, ""])))
    return docs + docs[5:25] * 2


@pytest.mark.parametrize(("longest", "least", "percent", "most", "block"), [(5, 20, 100, 2000, 1 << 21), (5, 8, 100, 7, 50), (3, 5, 60, 2000, 200)])
def test_equal_to_plain_counts(spark, monkeypatch, longest, least, percent, most, block):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    docs = _texts(longest + least, 150)
    frame = spark.createDataFrame([(i, t, lang, 1, "a", "i", 2, 3) for i, (t, lang) in enumerate(docs)], SCHEMA).repartition(6)
    got = collocations.collocations(frame, longest, least, percent, most)
    assert sorted(map(tuple, got.collect())) == _expected(docs, longest, least, percent, most)


def test_parents_are_the_parts(spark):
    frame = spark.createDataFrame([(1, "a b c d. " * 30, "en", 1, "a", "i", 2, 3)], SCHEMA)
    _, found = collocations.phrases(frame, 4, 10)
    rows = {r.id: r for r in found.collect()}
    assert sorted(r.phrase for r in rows.values()) == ["a", "a b", "a b c", "a b c d", "b", "b c", "b c d", "c", "c d", "d"]
    for r in rows.values():
        words = r.phrase.split(" ")
        assert (r.left, r.right) == (None, None) if r.k == 1 else (rows[r.left].phrase.split(" "), rows[r.right].phrase.split(" ")) == (words[:-1], words[1:])


def test_products_beyond_64_bits(spark):
    big = 9 * 10**14
    one = spark.createDataFrame([(big, big, [big - 1, 7], [3, big - 2])], "a long, n long, heads array<long>, tails array<long>")
    cuts = one.select(collocations.cut_scores(one.a, one.n, one.heads, one.tails).alias("c")).first().c
    assert [(c.score, c.l, c.r) for c in cuts[:1]] == [(1000 * big * big // ((big - 1) * (big - 2)), big - 1, big - 2)]


def test_nothing_to_count(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "a", "i", 2, 3)] * 3, SCHEMA)).collect() == []


def test_a_block_sends_few_bytes_for_a_pair():
    ids = (np.random.default_rng(5).zipf(1.3, 200_000) % 20_000).astype(np.int64) * 35 + 3
    block = pa.record_batch({"block": pa.array([1]), "ids": pa.array([collocations._packed(ids)], pa.binary())})
    pairs = len(np.unique(np.stack([ids[:-1], ids[1:]]), axis=1).T)
    sent = list(collocations._pairs_of(7)(iter([block])))
    assert sum(b.nbytes for b in sent) < 6 * pairs
    counted = [collocations._unpacked(r).reshape(3, -1)[-1].sum() for b in sent for r in b["rows"].to_pylist()]
    assert sum(counted) == len(ids) - 1
