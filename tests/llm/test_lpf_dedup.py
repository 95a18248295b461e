import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quaero.llm import lpf_dedup as L


def brute(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                mark[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(data, mark, strict=True) if not m)
        out.append((doc_id, len(data), [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(mark))], hashlib.sha256(kept).hexdigest(), kept))
    return out


def result(df):
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256, bytes(r.kept)) for r in df.collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[3], r[2])


def test_equals_brute_force(docs, rows):
    assert sorted(result(L.remove_repeats(docs, 100)), key=key) == sorted(brute(rows, 100), key=key)


def test_other_lengths(docs, rows):
    assert sorted(result(L.remove_repeats(docs, 40)), key=key) == sorted(brute(rows, 40), key=key)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(result(L.remove_repeats(odd, 60)), key=key) == sorted(brute(rows, 60), key=key)


def test_empty(empty):
    assert L.remove_repeats(empty).collect() == []


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 512)
    text = ("abcdefghij" * 37 + "klm") * 9
    data = np.frombuffer(text.encode(), np.uint8)
    texts = L.Texts.__new__(L.Texts)
    texts.ids, texts.data, texts.copy = [1], [text.encode()], [False]
    covered = np.zeros(len(data), int)
    for piece, _, begins, at in texts.pieces(100):
        first, n, _ = L.chunks(piece, at[:-1], np.diff(at), 100)
        for f, k in zip(first, n, strict=True):
            part = np.searchsorted(at, f, "right") - 1
            covered[begins[part] + f - at[part] :][:k] += 1
    assert (covered[: len(data) - 99] == 1).all() and not covered[len(data) - 99 :].any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=220), min_size=1, max_size=6), st.integers(33, 90))
def test_chunks_partition_windows(parts, length):
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    first, n, keys = L.chunks(data, np.cumsum(sizes) - sizes, sizes, length)
    covered = sorted(w for f, k in zip(first, n, strict=True) for w in range(f, f + k))
    starts = np.cumsum(sizes) - sizes
    assert covered == [s + i for s, size in zip(starts, sizes, strict=True) for i in range(size - length + 1)]
    assert (n <= length - L.GRAM + 1).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(c % 3 + 97 for c in b)))
def test_lpf_array(data):
    wanted = [max((k for j in range(i) for k in range(len(data) - i, 0, -1) if data[j : j + k] == data[i : i + k]), default=0) for i in range(len(data))]
    assert L.longest_previous_factor(data) == wanted


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=30).map(lambda b: bytes(c % 2 + 97 for c in b)), min_size=1, max_size=5))
def test_later_windows(contents):
    counts = [len(c) - 11 for c in contents]
    seen, wanted = set(), []
    for c, n in zip(contents, counts, strict=True):
        for i in range(n):
            wanted.append(c[i : i + 12] in seen)
            seen.add(c[i : i + 12])
    assert L.later_windows(contents, counts, 12).tolist() == wanted
