from quaero.operators import entities as E
from quaero.operators import factoids as FA
from quaero.operators import preparation as P


def test_questions_are_judged_apart(spark):
    """A phrase of one question stays, though another question's words say it, and is counted in its own question's sentences."""
    space = {"iron": [1.0, 0.2, 0.0], "metal": [1.0, 0.1, 0.0], "binds": [0.0, 1.0, 0.0]}
    vectors = spark.createDataFrame(list(space.items()), "term string, embedding array<float>")
    vocabulary = spark.createDataFrame([(w, 0.5) for w in space], "term string, weight double")
    s = [(1, 1, 0, "iron"), (1, 2, 0, "iron"), (2, 3, 0, "iron"), (2, 4, 0, "iron"), (2, 5, 0, "iron")]
    focus = spark.createDataFrame([(q, "metal", space["metal"]) for q in (1, 2)], "qid long, focus string, vector array<double>")
    sentences = lambda q: spark.createDataFrame([r for r in s if r[0] in q], "qid long, doc_id long, sid long, sentence string")
    alone = FA.candidates(sentences((1,)), focus, spark.createDataFrame([(1, "binds")], "qid long, term string"), vectors, vocabulary).collect()
    both = FA.candidates(sentences((1, 2)), focus, spark.createDataFrame([(1, "binds"), (2, "iron")], "qid long, term string"), vectors, vocabulary).collect()
    assert [(r.qid, r.phrase) for r in both] == [(1, "iron")] and both == alone


def test_hierarchy_of_any_depth(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(36)] + [(36, 30)], "child long, parent long")
    got = {(r.node, r.ancestor) for r in E.ancestors(edges).collect()}
    assert (0, 36) in got and (30, 30) in got and len([1 for n, _ in got if n == 0]) == 36


def test_spellings_that_differ_in_case():
    assert E.tag_text("Insulin and INSULIN", {"insulin": ("protein",)}) == {"Insulin": ("protein",)}


def test_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(200).selectExpr("id", "1.0 + id % 3 AS w")
    pick = lambda n: {r.id for r in P.weighted_sample(rows.repartition(n), "w", 20, 5).collect()}
    assert pick(1) == pick(7) and len(pick(3)) == 20


def test_candidates_of_any_length(spark):
    from quaero.operators.answers import candidate_phrases

    text = "alpha beta gamma delta epsilon zeta eta"
    found = {r.phrase for r in candidate_phrases(spark.createDataFrame([(1, 0, text)], "doc_id long, sid int, sentence string")).collect()}
    assert text in found
    short = {r.phrase for r in candidate_phrases(spark.createDataFrame([(1, 0, text)], "doc_id long, sid int, sentence string"), 2).collect()}
    assert short == {p for p in found if len(p.split()) <= 2}
