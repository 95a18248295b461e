import json
import struct

import pytest
from pyspark.sql import functions as F

from quaero.sources import readers as R
from quaero.sources import writers as W


def test_json_sources(spark, tmp_path):
    hit = {"_score": 2.5, "_source": {"dc": {"identifier": "pmid:17", "title": "T", "description": "An abstract.", "publicationYear": "2001", "publishers": [{"name": "J"}]}}}
    (tmp_path / "hits.json").write_text(json.dumps({"hits": {"total": 2, "hits": [hit, {"_score": 1.0, "_source": {"dc": {"identifier": "pmid:18", "title": "U"}}}]}}))
    rows = R.search_hits(spark, str(tmp_path / "hits.json")).collect()
    assert [(r.doc_id, r.journal, r.score) for r in rows] == [("17", "J", 2.5)]
    assert R.search_totals(spark, str(tmp_path / "hits.json")).first().total == 2
    legacy = {"result": {"documents": [{"pmid": "3", "title": "t", "documentAbstract": "a", "meshHeading": ["X"], "meshAnnotations": [{"termLabel": "X", "uri": "http://m/D1", "namespace": "m"}]}]}}
    (tmp_path / "old.json").write_text(json.dumps(legacy))
    assert R.legacy_results(spark, str(tmp_path / "old.json")).first().mesh[0].id == "D1"
    qs = [{"id": f"q{i}", "body": "b", "type": "list", "documents": ["http://x/5"], "exact_answer": a} for i, a in enumerate(["x", ["x", "y"], [["x"], ["y", "z"]], None])]
    (tmp_path / "q.json").write_text(json.dumps({"questions": qs}))
    got = {r.id: r.exact for r in R.questions(spark, str(tmp_path / "q.json")).collect()}
    assert got == {"q0": [["x"]], "q1": [["x"], ["y"]], "q2": [["x"], ["y", "z"]], "q3": []}
    (tmp_path / "onto.json").write_text(json.dumps({"D:1": [["heart"], ["cor"], ["D:0"]]}))
    labels, edges = R.ontology(spark, str(tmp_path / "onto.json"))
    assert {r.label for r in labels.collect()} == {"heart", "cor"} and edges.first().parent == "D:0"


def test_text_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a 1 2\nb_c 3 4\n")
    assert [r.term for r in R.vectors_text(spark, str(tmp_path / "v.txt"), 2, skip_phrases=True).collect()] == ["a"]
    (tmp_path / "two.txt").write_text("What is x\n0 0 1\n<skip\nA b\n1\n")
    rows = R.two_line_records(spark, str(tmp_path / "two.txt")).collect()
    assert [(r.tokens, r.labels) for r in rows] == [(["What", "is", "x"], [0, 0, 1])]
    (tmp_path / "log.txt").write_text("Question:What?\nAnswer:x\nrank:2 MRR:0.5 method:ensemble\n1) first\n sentence [0.5] PMID:7\n2) second [0.4] PMID:8\n=====\n")
    block = R.answer_logs(spark, str(tmp_path / "log.txt")).first()
    assert (block.question, block.rank, block.method) == ("What?", 2, "ensemble")
    assert [(c.no, c.sentence, c.score, c.doc_id) for c in block.candidates] == [(1, "first sentence", 0.5, "7"), (2, "second", 0.4, "8")]
    (tmp_path / "p.txt").write_text("1 2\nq1 1 0 3 0.5 0.5 1 2\n")
    pair = R.pair_file(spark, str(tmp_path / "p.txt")).first()
    assert (pair.j, list(pair.left), list(pair.right)) == (3, [0.5, 0.5], [1.0, 2.0])
    (tmp_path / "s.txt").write_text("# c\nin vitro\t5\n\n")
    assert [r.phrase for r in R.counted_phrases(spark, str(tmp_path / "s.txt")).collect()] == ["in vitro"]
    (tmp_path / "t.csv").write_text('question_id,rank \n"a, ""b""",N/A\n')
    assert tuple(R.csv(spark, str(tmp_path / "t.csv")).select("question_id", "rank").first()) == ('a, "b"', "N/A")
    (tmp_path / "verbs.tsv").write_text("bind\tbound\tbound\nget\tgot\tgot/gotten\n")
    assert R.irregular_verbs(spark, str(tmp_path / "verbs.tsv")).count() == 2
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.nxml").write_text("<a/>")
    assert R.files_below(spark, str(tmp_path)).count() == 1


def test_xml_and_blobs(spark, tmp_path):
    article = "<PubmedArticle><MedlineCitation><PMID>9</PMID><Article><ArticleTitle>t</ArticleTitle><Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text(f"<Set>{article}</Set>")
    assert R.article_xml(spark, str(tmp_path / "a.xml")).first().text == "one two"
    blobs = spark.createDataFrame([(1, bytearray(struct.pack(">hff", 2, 1.0, 2.0))), (2, None)], "doc_id long, centroid binary")
    assert [list(r.embedding) for r in R.centroids_of_blobs(blobs).collect()] == [[1.0, 2.0]]
    vec = spark.createDataFrame([("a", bytearray(struct.pack("<ff", 3.0, 4.0)))], "term string, vector binary")
    assert list(R.vectors_of_blobs(vec).first().embedding) == [3.0, 4.0]
    packed = spark.createDataFrame([("bound", "bind\tVBD bound#bound\tJJ bound")], "key_term string, content string")
    morph = R.morphology(packed)
    assert [r.base for r in R.infinitives(morph).collect()] == ["bind"]
    noms = R.nominalizations(spark.createDataFrame([("Inhibit",)], "term string"), spark.createDataFrame([("inhibit", "inhibition")], "verb string, nom string"), "verb", "nom")
    assert noms.first().nouns == ["inhibition"]
    marked = spark.createDataFrame([('x <span class="s" data-info="D:1|D:2">heart</span>',)], "html string")
    assert R.annotations(marked).first().spans[0].concepts == ["D:1", "D:2"]


def test_writers(spark, tmp_path):
    f = spark.createDataFrame([("b", 2), ("a", 1)], "term string, freq long")
    W.frequencies(f, str(tmp_path / "f"))
    assert [tuple(r) for r in R.tsv(spark, str(tmp_path / "f"), ["t", "n"]).orderBy("t").collect()] == [("a", "1"), ("b", "2")]
    rows = spark.createDataFrame([(["a", "b"], [0, 1])], "tokens array<string>, labels array<int>")
    W.two_lines(rows, str(tmp_path / "two"))
    assert R.two_line_records(spark, str(tmp_path / "two")).first().labels == [0, 1]
    cache = W.TableCache(spark, str(tmp_path / "cache"))
    assert cache.get("q") is None
    cache.put("q", f)
    assert cache.get("q").count() == 2
    W.table_xml(f, str(tmp_path / "xml"))
    assert spark.read.format("xml").option("rowTag", "dr").load(str(tmp_path / "xml")).count() == 2
    W.answer_log(spark.createDataFrame([("q?", 1, "s", 0.5, 3)], "question string, rank int, sentence string, score double, doc_id long"), str(tmp_path / "log"))
    assert "1) s [0.5000] PMID:3" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "log")).collect())


def test_answer_cache():
    cache = W.AnswerCache(most=2)
    for k in ("a", "b", "c"):
        cache.put([k], k, "rank")
    assert cache.get("a", "rank") is None and cache.get("C", "rank") == ["c"] and cache.get("c", "keyword") is None


def test_batch_equals_single_questions(spark):
    from quaero.plans.engine import Engine, ask_batch

    text = "The liver protein binds iron in the blood of mice every day. The heart gene regulates calcium in cells of the human heart."
    docs = spark.createDataFrame([(1, text), (2, "Nothing of note is said in this rather long sentence about stones.")], "doc_id long, text string")
    words = sorted({w.strip(".").lower() for w in text.split()})
    vectors = spark.createDataFrame([(w, [float(i == k) for k in range(len(words))]) for i, w in enumerate(words)], "term string, embedding array<float>")
    vocabulary = spark.createDataFrame([(w, 1.0) for w in words], "term string, weight double")
    known = spark.createDataFrame([("iron", "molecular entity")], "term string, entity_type string")
    got = Engine(docs, vocabulary, vectors, known).ask("When does the heart regulate calcium?", 1)
    assert got[0]["s"].startswith("The heart gene") and got[0]["pmid"] == "1"
    near = Engine(docs, vocabulary, vectors, known, centroids=spark.createDataFrame([(1, [float("iron" == w) for w in words]), (2, [float("heart" == w) for w in words])], "doc_id long, embedding array<float>"))
    assert [r.doc_id for r in near.retrieve("Which protein binds iron?", "aknn").orderBy("rank").collect()] == [1, 2]
    assert [r.doc_id for r in near.retrieve("Which liver protein binds iron?", "hybrid").collect()] == [1]
    batch = ask_batch(docs, spark.createDataFrame([(1, "heart calcium")], "qid long, question string"), vocabulary, vectors, 1).first()
    assert batch.sentence == got[0]["s"] and batch.score == pytest.approx(1.0)


def test_batch_equals_brute_force(spark):
    """A question's answer may stand behind fifty documents with rarer words, or share only its fifth word, or a word of one document."""
    import math
    import re

    from quaero.plans.engine import ask_batch

    rows = [(i, "Alpha beta gamma delta are said in this rather long sentence here.") for i in range(70)]
    rows += [(100, "Nothing but omega stands within this rather long sentence here."), (101, "Alpha beta gamma delta omega are said in this rather long sentence.")]
    rows += [(200, "Solitary unheard things stand within this rather long sentence.")]
    weights = {"alpha": 0.9, "beta": 0.8, "gamma": 0.7, "delta": 0.6, "omega": 0.5, "solitary": 1.0}
    units = {w: [float(i == k) for k in range(6)] for i, w in enumerate(weights)}
    units["omega"] = [1.0, 1.0, 1.0, 1.0, 1.0, 0.0]
    asked = {1: "alpha beta gamma delta omega", 2: "solitary", 3: "unknown"}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = []
    for q, question in asked.items():
        terms = [w for w in question.split() if w in weights]
        best: dict = {}
        for d, text in rows:
            words = [w for w in re.findall(r"\w+", text.lower()) if w in weights]
            if set(words) & set(terms):
                above = sum(weights[t] * max([-1.0, *(cosine(units[t], units[w]) for w in words)]) for t in terms)
                best.setdefault(text, (-max(0.0, above / sum(weights[t] for t in terms)), d))
        found = sorted(best.values())
        want += [(q, d, n, -score) for n, (score, d) in enumerate(found, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    questions = spark.createDataFrame(list(asked.items()), "qid long, question string")
    got = ask_batch(docs, questions, spark.createDataFrame(list(weights.items()), "term string, weight double"), spark.createDataFrame(list(units.items()), "term string, embedding array<float>"))
    got = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in got.collect())
    assert {d for _, d, *_ in want} >= {100, 101, 200}
    assert [(q, d, n) for q, n, d, _ in got] == [(q, d, n) for q, d, n, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want], abs=1e-5)


def test_words_of_one_document_are_known(spark, tmp_path):
    from quaero.queries import term_tables

    spark.createDataFrame([(1, "common single"), (2, "common")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    vocabulary, vectors = term_tables(spark, str(tmp_path))
    assert [{r.term for r in t.collect()} for t in (vocabulary, vectors.names)] == [{"common", "single"}] * 2


def test_entry_without_the_training_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith(("quaero.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith(("quaero.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    again = importlib.reload(entry)
    assert "idf_vocab" in again.queries() and "pipeline" not in again.queries() and set(again.oracle_sql()) <= set(again.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_oracle_equals_queries(spark):
    """A few registered queries against their SQL on the smallest tables."""
    import duckdb

    from quaero import queries as Q

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("region", "nation", "events", "documents", "embeddings", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("idf_vocab", "dedup_sentences", "relax_ladder", "kfold_split", "isa_closure"):
        df = Q.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        plain = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
        sql = db.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({Q.ORACLE_SQL[name]})").fetchall()
        assert plain(tuple(r) for r in df.select(*(F.col(c) for c in columns)).collect()) == plain(sql), name
