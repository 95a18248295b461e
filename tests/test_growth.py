"""Steps that were rewritten to grow no faster than their input."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quaero.functions.text import STOP_WORDS
from quaero.operators import entities as E
from quaero.operators import phrases as PH
from quaero.operators import preparation as P
from quaero.operators import vocabulary as VOC
from quaero.plans import batch as B


def test_texts_without_a_first_word_have_no_entity():
    known = {"und": ("disease",), "p53-x": ("gene",), "of the": ("disease",), "the": ("gene",), "ας": ("drug",), "protein": ("protein",), "'s": ("drug",), "--": ("drug",)}
    firsts, rng = E.first_runs(known), random.Random(3)
    assert firsts == {"und", "p53", "ασ", "protein", "s"}
    pieces = ["und", "UND.", "p53-X,", "P53", "of", "the", "ΑΣ", "ΑΣ.b", "(und)", "dog's", "x", "'s", "--", "bund", "protein", "protein und", "und/x", "\n"]
    texts = ["", None, *(" ".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(4000)), *("".join(rng.choices(pieces, k=3)) for _ in range(4000))]
    left = [t for t in texts if not E.may_have_entity(t, firsts)]
    assert len(left) > 300 and not any(E.tag_text(t or "", known) for t in left)


def test_spans_are_swept_in_arrow_batches(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 2, 3)], "k int, start int, end int")
    found = P.inside(rows, rows, "k")
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 0, 5, 0, 5), (1, 2, 3, 0, 5)]


def test_prefix_join_moves_heads_only(spark):
    texts = [(3, "Ab c" + "x" * 5000), (2, "ABC" + "y" * 5000), (1, "a b"), (4, None), (5, "zz")]
    keys = spark.createDataFrame([("ab",), ("abc",), ("zzz",), ("ABc",), (None,)], "key string")
    found = P.join_or_prefix(keys, spark.createDataFrame(texts, "id long, question string"))
    assert sorted(map(tuple, found.collect())) == [("ABc", 2), ("ab", 1), ("abc", 2)]
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_many_occurrences_of_one_text(spark):
    n = PH.FOUND_AT_ONCE + 10
    docs = spark.createDataFrame([(1, "a b " * n), (2, None)], "doc_id long, text string")
    found = PH.occurrences(docs, spark.createDataFrame([("a b",), ("b a",)], "phrase string"))
    assert {r.phrase: (r.n, r.last) for r in found.groupBy("phrase").agg(F.count("*").alias("n"), F.max("start").alias("last")).collect()} == {"a b": (n, 2 * n - 2), "b a": (n - 1, 2 * n - 3)}


def test_sentences_are_scored_where_they_are_read(spark, monkeypatch):
    """Only sentences with a rarer word leave their task; the scores are those of the block-wise way, rows that share an id included."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([4, 40])]).upper() + rng.choice([" ", " ", "! ", ". "]) for _ in range(rng.randint(1, 30)))
    docs = spark.createDataFrame([(i // 2, text()) for i in range(120)] + [(7, None), (None, "w1 w2. w39"), (8, " ... ?"), (9, "\xa0. w3"), (9, "unseen")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, w) for q in range(3) for w in rng.sample(words, 5)] + [(9, "none"), (None, "w1")], "qid long, term string")
    names = spark.createDataFrame([(w, i % 25, i) for i, w in enumerate(words)], "term string, vec_id long, place long")
    vectors = B.SharedVectors(names, spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(25)] + [(99, None)], "vec_id long, embedding array<double>"))
    vocabulary = spark.createDataFrame([(w, 0.1 + i / 50) for i, w in enumerate(words)], "term string, weight double")
    rows = lambda frame: sorted(((r.qid, -1 if r.doc_id is None else r.doc_id, r.sid, round(r.score, 5)) for r in frame.collect()))
    monkeypatch.setattr(B, "WORDS_AT_ONCE", 0)
    want = rows(B.all_sentence_scores(docs, asked, vectors, vocabulary))
    monkeypatch.setattr(B, "WORDS_AT_ONCE", 256)
    assert len({r[0] for r in want}) == 4 and len(want) > 400
    for frequent, together, at_once in ((1 << 18, 1 << 13, 1 << 23), (5, 3, 40), (0, 1, 1)):
        monkeypatch.setattr(B, "FREQUENT", frequent)
        monkeypatch.setattr(B, "TOGETHER", together)
        monkeypatch.setattr(B, "BYTES_AT_ONCE", at_once)
        found = B.all_sentence_scores(docs, asked, vectors, vocabulary)
        assert rows(found) == want
        assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()


def test_ngrams_are_counted_in_parts_of_bounded_text(spark, monkeypatch):
    """The text that one task counts is bounded, whatever partitions the documents come in, copies of one text too."""
    rng = random.Random(6)
    words = ["the", "of", "Été", "p53", "a_b", "gene", "x", "ΑΣ", "not"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(150)] + [None, "", " .", "gene", "gene x"] + ["gene p53 x"] * 300
    docs = spark.createDataFrame([(i, t, {"k": "v"}) for i, t in enumerate(texts)], "doc_id long, text string, more map<string,string>").coalesce(1)
    assert max(len((t or "").encode()) for t in texts) < 1000
    monkeypatch.setattr(VOC, "PART", 1000, raising=False)
    for n in (1, 2, 3):
        want: Counter = Counter()
        for t in texts:
            w = re.findall(r"[^\W_]+", (t or "").lower().replace("ς", "σ"))
            want.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1) if not set(w[i : i + n]) & set(STOP_WORDS))
        found = VOC.ngram_counts(docs, n, 3)
        assert {r.ngram.replace("ς", "σ"): r.freq for r in found.collect()} == {k: v for k, v in want.items() if v >= 3}
        plan = found._jdf.queryExecution().executedPlan().toString()
        size = sum(len((t or "").encode()) for t in texts)
        assert f", {size // 1000 + 1}), REPARTITION_BY_NUM" in plan and "arrays_overlap" not in plan
    parts = VOC.in_parts(docs, "text", 1000).groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert max(r.n for r in parts if r.n) < 5000
    assert VOC.ngram_counts(docs.where("false"), 2, 3).collect() == []
