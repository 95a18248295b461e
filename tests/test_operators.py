import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.functions import vectors as V
from quaero.operators import answers as A
from quaero.operators import entities as E
from quaero.operators import metrics as M
from quaero.operators import preparation as P
from quaero.operators import ranking as R
from quaero.operators import scorers as SC
from quaero.operators import vocabulary as VOC

VECTORS = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(VECTORS, "term string, embedding array<float>"), spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.25)], "term string, weight double")


def test_rwmd(spark, tables):
    vectors, vocabulary = tables
    q = spark.createDataFrame([(1, "a"), (1, "b"), (1, "unknown")], "qid long, term string")
    s = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c"), (1, 2, "zzz")], "qid long, sid long, term string")
    got = {r.sid: r.score for r in R.rwmd(q, s, vectors, vocabulary).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(0.5**0.5, abs=1e-6) and got[2] == 0


def test_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 3.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<float>")
    bits = {r.vec_id: r.bits for r in V.bit_sets(df, "vec_id", 2).collect()}
    assert bits == {0: [0, 2], 1: [1, 3], 2: [0, 2]}
    x = spark.createDataFrame([([0, 2], [1, 2])], "a array<int>, b array<int>")
    assert x.select(V.jaccard(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / 3)
    assert x.select(V.weighted_jaccard(F.col("a"), F.col("b"), 4)).first()[0] == pytest.approx(0.5)
    top = R.top_similar(df, df.where("vec_id = 1"), 1).first()
    assert (top.vec_id, top.rank) == (2, 1)


def test_phrases_and_clusters(spark, tables):
    vectors, vocabulary = tables
    phrases = spark.createDataFrame([("a b",), ("c",)], "phrase string")
    got = {r.phrase: list(r.vector) for r in R.phrase_vectors(phrases, vectors).collect()}
    assert got == {"a b": [0.5, 0.5], "c": [1.0, 1.0]}
    assert R.agglomerate(np.array([[1, 0], [1, 0.01], [0, 1.0], [0, 0.9]])) == [[2, 3], [0, 1]]
    rows = spark.createDataFrame([(1, "p", [1.0, 0.0]), (1, "q", [1.0, 0.0]), (1, "r", [0.0, 1.0])], "qid long, phrase string, vector array<double>")
    assert {(r.phrase, r.cluster) for r in R.clustered(rows).collect()} == {("p", 1), ("q", 1), ("r", 0)}
    assert R.merge_preferences([("x", "y"), ("x", "z"), ("w", "x")]) == ["w", "x", "y", "z"]
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (2, 0, "b")], "id long, pos int, term string")
    got = {r.id: r.matched for r in R.fuzzy_match(tokens, spark.createDataFrame([("a",)], "term string"), vectors).collect()}
    assert got == {1: True, 2: False}
    prefs = spark.createDataFrame([(1, "x", "y"), (1, "x", "z"), (1, "w", "x")], "qid long, winner string, loser string")
    assert [r.item for r in R.ranked_by_preferences(prefs).orderBy("rank").collect()] == ["w", "x", "y", "z"]


def test_entities(spark):
    known = spark.createDataFrame([("p53", "gene"), ("insulin", "protein"), ("insulin", "drug"), ("fda", "protein"), ("breast cancer", "disease"), ("cancer", "disease"), ("breast", "anatomical entity")], "term string, entity_type string")
    terms = spark.createDataFrame([("Insulin",), ("FDA",), ("finding",), ("kinase",), (None,)], "term string")
    assert {r.term: r.types for r in E.typed(terms, known).collect()} == {"Insulin": ["protein", "drug"], "FDA": [], "finding": [], "kinase": ["protein"], None: []}
    s = spark.createDataFrame([("p53 in breast cancer and the protein",)], "sentence string")
    assert [(e.phrase, e.types) for e in E.tagged(s, known).first().entities] == [("p53", ["gene"]), ("breast cancer", ["disease"])]
    assert [e.phrase for e in E.tagged_by_join(s, known).first().entities] == ["p53", "breast cancer"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert E.ancestors(edges, most=5).where("node = 'a'").count() >= 3
    labels = spark.createDataFrame([("b", "Disease")], "node string, label string")
    tree = E.ancestors(spark.createDataFrame([("a", "b"), ("x", "y")], "child string, parent string"))
    assert [r.node for r in E.is_a(spark.createDataFrame([("a",), ("x",), ("b",)], "node string"), labels, tree, "disease").orderBy("node").collect()] == ["a", "b"]
    m = E.longest_match(spark.createDataFrame([("severe breast cancer",)], "phrase string"), spark.createDataFrame([("n1", "breast cancer"), ("n2", "cancer")], "node string, label string")).first()
    assert m.matched == "breast cancer"
    d = E.dictionary((spark.createDataFrame([("A; b",)], "names string"), "names", "drug", ";"), (spark.createDataFrame([("X",)], "symbol string"), "symbol", "gene", None))
    assert {(r.term, r.entity_type) for r in d.collect()} == {("a", "drug"), ("b", "drug"), ("x", "gene")}


def test_words_of_morphology(spark):
    acr = spark.createDataFrame([("TNF", "tumor necrosis factor", 5, 1), ("TNF", "tnf gene", 9, 1)], "acronym string, expansion string, freq int, cluster_id int")
    row = E.acronym_expansions(acr).first()
    assert row.total == 14 and row.expansions[0] == "tnf gene"
    q = spark.createDataFrame([(1, "the tumor necrosis factor level")], "question_id long, question string")
    assert E.acronym_in_ngrams(q, acr).first().acronym == "TNF"
    verbs = E.conjugations(spark.createDataFrame([("carry",), ("bind",), ("use",)], "verb string"), spark.createDataFrame([("bind", "bound", "bound")], "verb string, past string, participle string"))
    assert {(r.verb, r.third, r.past, r.gerund) for r in verbs.collect()} == {("carry", "carries", "carried", "carrying"), ("bind", "binds", "bound", "binding"), ("use", "uses", "used", "using")}
    words = E.lemmas(spark.createDataFrame([("genes",), ("mice",), ("ss",)], "term string"), spark.createDataFrame([("mice", "NN", "mouse", 0)], "term string, pos string, base string, ord int"))
    assert {r.term: r.lemma for r in words.collect()} == {"genes": "gene", "mice": "mouse", "ss": "ss"}


def test_answers(spark):
    long = "this sentence has more than forty characters, surely"
    rows = spark.createDataFrame([(1, 0, long, 0.5), (2, 0, long.replace(" ", "  "), 0.9), (3, 0, "short", 1.0), (4, 0, "s hort", 0.1)], "doc_id long, sid long, sentence string, score double")
    assert [r.doc_id for r in A.deduplicated(rows).collect()] == [2]
    texts = ["agents such as aspirin help", "Aspirin is a drug", "aspirin, a drug of old", "Aspirin was used", "aspirin helps; it is fine"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, sentence string")
    assert [r.doc_id for r in A.definition_answers(df, "aspirin").orderBy("doc_id").collect()] == [0, 1, 2]
    tagged = spark.createDataFrame([(1, 0, "s", 0.5, [("p53", ["gene"]), ("cancer", ["disease"])]), (2, 0, "t", 0.9, [("cancer", ["disease"])])], "doc_id long, sid long, sentence string, score double, entities array<struct<phrase:string,types:array<string>>>")
    kept = A.focus_scores(tagged, ["cancer"], ["gene"]).collect()
    assert [(r.doc_id, r.focus_score) for r in kept] == [(1, 2.0)]
    assert A.combined(A.focus_scores(tagged, ["cancer"], ["gene"])).first().score == pytest.approx(0.6)
    assert [r.answer for r in A.exact_answers(tagged, ["cancer"], ["gene", "disease"]).collect()] == ["p53"]


def test_measures(spark):
    ranks = spark.createDataFrame([("1",), ("2 ",), ("N/A",), (None,)], "rank string")
    row = M.rank_measures(ranks, "rank").first()
    assert (row.questions, row.answered, row.mrr, row.p1) == (4, 2, 0.375, 0.25)
    assert M.rank_measures(spark.createDataFrame([("0",), ("NA",)], "rank string"), "rank", zero_based=True).first().mrr == 0.5
    res = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "qid long, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 10), (1, 99), (2, 13)], "qid long, doc_id long")
    assert {r.qid: r.precision for r in M.precision_at(res, gold, 5).collect()} == {1: 0.2, 2: 0.0}
    cov = M.coverage(res, gold)
    assert {r.qid: r.coverage for r in cov.collect()} == {1: 0.5, 2: 0.0}
    s = M.coverage_summary(cov).first()
    assert (s["mean"], s["none"], s["full"]) == (0.25, 1, 0)
    folds = M.precision_recall(spark.createDataFrame([(0, 1, 0.9), (0, 0, 0.8), (0, 1, 0.1)], "fold int, y int, p double"), "y", "p", ["fold"])
    assert M.over_folds(folds).first().f1_mean == pytest.approx(50.0)
    t = M.t_test(spark.createDataFrame([(True, 1.0), (True, 3.0), (False, 2.0), (False, 6.0)], "g boolean, v double"), "v", "g").first()
    assert t.t == pytest.approx(-2 / (5 * 1.0) ** 0.5) and t.df == 2
    curve = M.learning_curve(spark.createDataFrame([([0.5, 1.0],), ([0.0, 1.0],)], "acc array<double>"), "acc")
    assert {r.epoch: r["mean"] for r in curve.collect()} == {0: 25.0, 1: 100.0}


def test_preparation(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, y int").withColumn("q", F.col("id") % 3)
    folds = P.k_folds(rows, "id", 4, 1).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [5, 5, 5, 5]
    assert P.first_part(rows, "id", 6, 3).where("part = 'a'").count() == 6
    assert P.negatives(rows, "q", "id", "y", 1, 5).where("y = 0").count() == 3
    ev = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "u long, t long, k string")
    assert [r.n for r in P.consecutive_runs(ev, "u", "t", "k").orderBy("run").collect()] == [2, 2, 1]
    a = spark.createDataFrame([("a b c",), ("x",)], "key string")
    qs = spark.createDataFrame([(1, "A bc"), (2, "xyz"), (3, "x1")], "id long, question string")
    assert {(r.key, r.id) for r in P.join_or_prefix(a, qs).collect()} == {("a b c", 1), ("x", 2)}
    pair = spark.createDataFrame([("q1 q2 q3 q4", "s1 s2 s3")], "q string, s string").select(P.pair_input(F.col("q"), F.col("s"), 9).alias("x")).first().x
    assert pair == ["[CLS]", "q1", "q2", "q3", "[SEP]", "s1", "s2", "s3", "[SEP]"]
    spans = P.inside(spark.createDataFrame([(1, 2, 3)], "k int, start int, end int"), spark.createDataFrame([(1, 2, 4), (1, 0, 9)], "k int, start int, end int"), "k").first()
    assert (spans.outer_start, spans.outer_end) == (0, 9)
    parts = P.split_by_lists(spark.createDataFrame([("a b",), ("c",)], "question string"), "question", {"dev": spark.createDataFrame([("ab",)], "question string")})
    assert [r.question for r in parts["dev"].collect()] == ["a b"] and [r.question for r in parts["rest"].collect()] == ["c"]
    feats = P.concat_features(spark.createDataFrame([(1, 1, [3.0, 4.0]), (1, 0, None)], "id long, pos int, embedding array<float>"), 3, 2).first().features
    assert feats == [0.0, 0.0, 3.0, 4.0, 0.0, 0.0]


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, "Alpha beta. Alpha"), (2, "beta"), (3, None)], "doc_id long, text string")
    v = {r.term: (r.df, r.weight) for r in VOC.idf_weights(VOC.document_frequency(docs), 4).collect()}
    assert v["alpha"] == (1, 1.0) and v["beta"][1] == pytest.approx(0.5)
    parts = spark.createDataFrame([(1, 0, "alpha", None), (1, 1, "alpha gamma", None), (1, 2, "x-y", "x-y")], "question long, part int, term string, hyphen string")
    w = {r.part: r.weight for r in VOC.part_weights(parts, spark.createDataFrame([("alpha", 0.5)], "term string, weight double")).collect()}
    assert w == {0: 1.0, 1: 1.0, 2: 2.0}
    phrases = spark.createDataFrame([("beta",), ("beta",)], "phrase string")
    row = VOC.phrase_weights(phrases, spark.createDataFrame([("Beta beta betas",)], "sentence string"), spark.createDataFrame([("beta", 0.5)], "term string, weight double")).first()
    assert row.tf == 4 and row.factor == pytest.approx(np.log(5) * 0.5)


def test_scorers(spark):
    assert SC.select_keywords(["which", "big", "gene"], ["WDT", "JJ", "NN"]) == ["big", "gene"]
    assert SC.order_keywords(["a", "b"], {"b": 2.0}) == ["b", "a"]
    rows = spark.createDataFrame([(1, "q", "s1", 1), (1, "q", "s2", 2)], "qid long, question string, sentence string, rank int")
    got = SC.reranked(rows, lambda q, s: [0.1 if x == "s1" else 0.9 for x in s]).orderBy("rank").collect()
    assert [r.sentence for r in got] == ["s2", "s1"]

    def broken(q, s):
        raise RuntimeError("no model")

    assert [r.sentence for r in SC.reranked(rows, broken).orderBy("rank").collect()] == ["s1", "s2"]


def test_factoids(spark):
    from quaero.operators import factoids as FA

    names = ["iron", "copper", "metal", "table", "binds"]
    space = {"iron": [1.0, 0.2, 0], "copper": [0.9, 0.3, 0], "metal": [1.0, 0.1, 0], "table": [0, 0, 1.0], "binds": [0, 1.0, 0]}
    vectors = spark.createDataFrame([(w, [float(x) for x in space[w]]) for w in names], "term string, embedding array<float>")
    vocabulary = spark.createDataFrame([(w, 0.5) for w in names], "term string, weight double")
    s = spark.createDataFrame([(1, 1, 0, "iron"), (1, 2, 0, "table"), (1, 3, 0, "binds")], "qid long, doc_id long, sid long, sentence string")
    focus = spark.createDataFrame([(1, "metal", [1.0, 0.1, 0.0])], "qid long, focus string, vector array<double>")
    asked = spark.createDataFrame([(1, "binds")], "qid long, term string")
    got = FA.candidates(s, focus, asked, vectors, vocabulary)
    assert [r.phrase for r in got.orderBy("rank").collect()] == ["iron"]
    gold = spark.createDataFrame([(1, "copper")], "qid long, answer string")
    row = FA.matched_to_gold(got, gold, vectors, vocabulary).first()
    assert (row.phrase, row.rank) == ("iron", 1) and row.score > 0.9
    assert FA.reranked_by_similarity(got, asked, vectors, vocabulary).count() == 1
    assert E.query_types("breast disease", {}) == ("disease",) and E.query_types("protein kinase", {}) == ("protein",) and E.query_types("gene", {"gene": ("gene",)}) == ()


def test_both_ways_of_tagging(spark):
    """The dictionary that travels and the one that is joined give the same entities."""
    long = "one two three four five six seven eight"
    prefixes = [" ".join(long.split()[:k]) for k in range(1, 9)]
    known = spark.createDataFrame([*((p, "disease") for p in prefixes), ("p53", "gene"), ("il-2", "protein"), ("insulin", "drug"), ("insulin", "protein"), ("insulin", "unlisted"), ("breast", "anatomical entity"), ("breast cancer", "disease"), ("protein", "protein"), ("kinase", "protein"), ("kinase c", "enzyme")], "term string, entity_type string")
    texts = [f"Here {long} nine.", "Breast cancer (p53, IL-2) and protein kinase C; protein XYZ; protein insulin's role.", "cancer of the breast cancer", "", None, "p53 P53 p53/insulin", "Gene insulin"]
    s = spark.createDataFrame(list(enumerate(texts)), "sid long, sentence string")
    rows = lambda df: {r.sid: [(e.phrase, list(e.types)) for e in r.entities] for r in df.collect()}
    want = rows(E.tagged(s, known))
    assert want[0][0] == (long, ["disease"]) and len(want[1]) > 3
    assert rows(E.tagged_by_join(s, known)) == want == rows(E.tagged(s, known, most_terms=2))
