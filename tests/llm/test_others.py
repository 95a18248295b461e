import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaero.llm import chat_template as C
from quaero.llm import common
from quaero.llm import merkle_audit as W
from quaero.llm import ordinal_grades as O

# Chat templates

PIECE = st.sampled_from(["a", "\\", "[", "INST]", "[INST]", "[/INST]", "<s>", "</s>", " ", "\n", "é", "[ROLE]", "[/ROLE]", "[\\INST]", ""])
TEXT = st.lists(PIECE, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escape_is_reversible(text):
    out = C.escape(text)
    assert C.unescape(out) == text and not any(c in out for c in C.CONTROLS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[INST]"]), TEXT), max_size=6))
def test_conversations_read_back(turns):
    out, mask = C.Template().render([{"role": r, "text": t} for r, t in turns])
    assert C.read_back(out) == turns
    assert "".join(C.unescape(out[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")


def test_language():
    t = C.Template("{% set x = 'a' + 'b' %}{% for m in messages %}{% if not loop.first and m.n > 1 %}-{% elif false %}never{% else %}{{ x | upper }}{% endif %}{{ m['n'] }}{% if loop.last %}.{% endif %}{% endfor %}")
    assert t.render([{"n": 1}, {"n": 1}, {"n": 2}])[0] == "AB1AB1-2."
    assert C.fold(C.parse("{{ 'a' + 'b' }}c{% if 1 == 2 %}x{% endif %}{{ 2 | length }}")) == (C.Text("abc0"),)
    assert C.Template("{% generation %}a{{ y }}{% endgeneration %}b{% generation %}c{% endgeneration %}").render([], y="z") == ("azbc", [[0, 2], [3, 4]])


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ _x }}", "{% import os %}", "{{ f() }}", "{% for x in y %}", "{{ x | eval }}", "{{ 'a }}", "{% endfor %}", "{{ 1 2 }}"])
def test_sandbox(source):
    with pytest.raises(C.TemplateError):
        C.Template(source)


def test_no_python_objects_are_reached():
    assert C.Template("{{ x.keys }}|{{ x.real }}|{{ y.upper }}").render([], x={"a": 1}, y="s")[0] == "||"


def test_whole_tables(spark):
    rows = [(1, 1, "assistant", "</s>b"), (1, 0, "user", None), (1, 0, None, "n"), (2, None, "user", ""), (None, 0, "system", "s"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "assistant", "long " * 50000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in C.digests(C.format_conversations(df)).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert C.digests(C.format_conversations(df.limit(0))).collect() == []


# Fixity


def audit(spark, mine, theirs):
    schema = "page_id long, url string, html string, seq string"
    frames = [spark.createDataFrame([(*r, "x") for r in rows], schema) for rows in (mine, theirs)]
    return {(r.page_id, r.status) for r in W.audit(*frames).collect()}


def test_audit(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(700)] + [(700, None, None), (None, "u", "h")]
    assert {s for _, s in audit(spark, pages, pages[::-1])} == {"ok"}
    other = [(p, u, h + "!" if p in (3, 259) else h) for p, u, h in pages if p not in (64, 650)] + [(5000, "new", "x")]
    got = audit(spark, pages, other)
    assert {x for x in got if x[1] != "ok"} == {(3, "corrupt"), (259, "corrupt"), (64, "missing"), (650, "missing"), (5000, "extra")} and len(got) == 703
    assert audit(spark, [], []) == set()
    assert audit(spark, pages[:3], []) == {(0, "missing"), (1, "missing"), (2, "missing")}
    twice = [(1, "a", "x"), (1, "a", "x"), (1, "b", "y")]
    assert audit(spark, twice, twice) == {(1, "ok")}


def test_manifest(spark):
    df = spark.createDataFrame([(2, "u", "bé"), (1, None, None)], "page_id long, url string, html string")
    rows = W.manifest(df).orderBy("seq").collect()
    assert rows[1].offset == rows[0].length and rows[0].page_id == 1
    record = df.where("page_id = 2").select(W.record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).first().r.encode()
    assert rows[1].digest == hashlib.sha256(record).hexdigest() and rows[1].length == len(record) and b"Content-Length: 3\r\n" in record


# Grades


def test_grades(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = [words[k] for k in rng.integers(0, 400, 60)]
        kind = i % 5
        if kind == 0:
            text = [w + "###" for w in text]
        elif kind == 1:
            text[7], text[20] = "vile", "foul"
        rows.append((i, " ".join(text)))
        labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    rows += [(10001, None), (10002, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = O.fit(docs.where("doc_id < 600"), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in O.grade(docs, model).collect()}
    assert len(got) == 903 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    held = range(600, 900)
    assert sum(got[i].selected == (i % 5 > 1) for i in held) >= 0.95 * len(held)
    mean = [np.mean([got[i].expected_grade for i in held if want(i % 5)]) for want in (lambda k: k == 0, lambda k: k == 1, lambda k: k > 1)]
    assert mean[0] < mean[1] < mean[2] and model.thresholds[0] < model.thresholds[1]


def test_grades_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert O.grade(docs, O.fit(docs, none)).count() == docs.count() and O.grade(empty, O.fit(empty, none)).collect() == []
    one = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.selected for r in O.grade(docs, O.fit(docs, one)).collect())


def test_feature_pieces(monkeypatch):
    text = ("Alpha beta, gamma!\n" * 40 + "x" * 500 + " ÉTÉ").encode()
    whole = O.features(text).tolist()
    monkeypatch.setattr(O, "_PIECE", 1000)
    assert O.features(text).tolist() == whole and len(O.features(b"")) == 4


# Components


@settings(max_examples=8, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, edges):
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in common.components(df, "a", "b").collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


# Pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    text = lambda i: " ".join(f"w{(i * 7919 + k * k * (i + 3)) % 5003}" for k in range(120))
    item = " ".join(f"exam{k}" for k in range(20))
    rows = [(i, text(i), f"s{i % 3}") for i in range(30)]
    rows += [(100, text(1), "s0"), (101, text(2).replace(text(2).split()[60], "changed", 1), "s1"), (102, text(50)[:200] + " " + item, "s2"), (103, "too short", "s0"), (104, None, "s1")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(P.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or now.columns == docs.columns
        seen.append({r.doc_id for r in now.collect()})
    assert seen[0] == {*range(30), 100, 101, 102} and seen[1] == {*range(30), 102} and seen[2] == set(range(30))
    sizes = [r["count"] for r in now.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    whole = P.run(spark, str(tmp_path))
    assert sorted(tuple(r) for r in whole.select("doc_id", "shard", "slot").collect()) == sorted(tuple(r) for r in now.select("doc_id", "shard", "slot").collect())


@pytest.mark.parametrize("text", [b"x" * 100, b"ab " + b"y" * 90 + b" cd", b"z" * 50 + b"\n" + b"w" * 7 + b" ", b"a b c " * 30])
def test_features_of_words_longer_than_a_piece(text, monkeypatch):
    whole = O.features(text)
    monkeypatch.setattr(O, "_PIECE", 16)
    assert O.features(text).tolist() == whole.tolist()
