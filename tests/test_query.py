from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaero.operators import questions as Q
from quaero.operators import search as S
from quaero.plans.query import Part, Query, Term, keyword_query, parse_query, prefix_syntax

PARTS = st.lists(
    st.builds(
        lambda words, types, w: Part(tuple(Term(x, types=types) for x in words), w),
        st.lists(st.sampled_from("alpha beta gamma delta epsilon".split()), min_size=1, max_size=3, unique=True), st.sampled_from([(), ("gene",)]), st.floats(0.5, 3),
    ),
    min_size=1, max_size=4,
)


@settings(max_examples=100, deadline=None)
@given(PARTS)
def test_rungs_shrink(parts):
    rungs = list(Query.of(parts).grouped().ladder())
    assert all(a.n_terms == b.n_terms + 1 for a, b in zip(rungs, rungs[1:], strict=False))


def test_relaxation_order():
    entity, plain = Part((Term("tp53", types=("gene",)),)), Part((Term("cells"), Term("cell")))
    q = Query(((entity,), (plain,)))
    assert [r.rendered() for r in q.ladder()] == ["tp53 AND (cells OR cell)", "tp53 AND cells", "tp53"]
    both = Query(((entity, Part((Term("brca1", types=("gene",)),))),))
    assert [r.rendered() for r in both.ladder()] == ["tp53 AND brca1", "tp53"]


def test_weights_and_boosts():
    q = Query.of([Part((Term("rare"),)), Part((Term("two words", True),)), Part((Term("common"),))]).weighted({"rare": 0.8, "two": 0.4, "words": 0.2, "common": 0.1})
    assert [round(p.weight, 6) for p in q.parts] == [8.0, 2.0, 1.0]
    assert [p.weight for p in q.boosted(["rare"]).parts] == [16.0, 1.0, 0.5]
    assert [p.terms[0].text for p in q.pruned().parts] == ["rare", "two words"]
    assert q.rendered(weighted=True) == 'rare^8.0 AND "two words"^2.0 AND common^1.0'


def test_reads_what_it_writes():
    text = '(a1 OR "b c") AND d'
    assert parse_query(text).rendered() == text
    assert parse_query("x^2.5").parts[0].terms[0].weight == 2.5


def test_deduplication_and_grouping():
    q = Query.of([Part((Term("(gene)"),)), Part((Term("gene therapy", True),)), Part((Term("12"),))]).deduplicated()
    assert q.rendered() == '"gene therapy"'
    grouped = Query.of([Part((Term("cell"),), 1.2), Part((Term("stem cell", True),), 2.0), Part((Term("liver"),), 3.0)]).grouped()
    assert [[p.terms[0].text for p in g] for g in grouped.groups] == [["liver"], ["stem cell", "cell"]]
    assert q.without_term("gene therapy").groups == ()
    assert prefix_syntax(Query.of([Part((Term("regulation"),))])) == "regulation*[All Fields]"


def test_keyword_query():
    q = keyword_query(["which", "gene", "wild-type"], [0, 1, 2], by_rank=True)
    assert q.rendered() == '"wild type" AND (gene OR genes)'


def test_compiled_search(spark):
    docs = spark.createDataFrame([(1, "Gene therapy of the liver."), (2, "genes and livers"), (3, None), (4, "therapy, gene"), (5, "")], "doc_id long, text string")
    found = lambda q, c="AND": [r.doc_id for r in S.search(docs, q, connective=c).collect()]
    gene, liver, phrase = Part((Term("gene"),), 2), Part((Term("liver"),)), Part((Term("gene therapy", True),))
    assert found(Query.of([gene, liver])) == [1]
    assert found(Query.of([phrase])) == [1]
    assert sorted(found(Query.of([gene, liver]), "OR")) == [1, 4]
    assert found(Query.of([Part((Term("liver*"),))])) == [1, 2]
    assert found(Query()) == []
    assert [n for _, n in S.ladder_counts(docs, Query.of([gene, Part((Term("absent"),))]))] == [0, 2]
    assert S.relax(docs, Query.of([gene, Part((Term("absent"),))]), enough=1)[0].rendered() == "gene"
    assert S.relax(docs, Query.of([Part((Term("absent"),))]))[1] == "OR"
    assert [r.doc_id for r in S.retrieve(docs, Query.of([gene, Part((Term("absent"),))]), "keyword").collect()] == [1, 4]
    assert sorted(r.doc_id for r in S.search_postings(S.postings(docs), ["gene", "therapy"]).collect()) == [1, 4]


def test_unions_and_sessions(spark):
    lists = [spark.createDataFrame(r, "doc_id long, rank int") for r in ([(5, 1), (3, 2)], [(3, 1), (9, 2)])]
    assert [r.doc_id for r in S.ordered_union(lists).orderBy("rank").collect()] == [5, 3, 9]
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "doc_id long, text string")
    session = S.Session(docs)
    session.build("q", Query.of([Part((Term("alpha"),)), Part((Term("beta"),))]))
    gold = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert session.coverage("q", gold) == (1, 2)
    assert session.remove_term("q", "beta") == "alpha"
    assert session.coverage("q", gold) == (2, 2)
    best, value = S.best_sequences(docs, Query.of([Part((Term("alpha"),)), Part((Term("beta"),))]), gold, n=5, stop_above=1)
    assert best[-1].rendered() == "alpha" and value == 1.0
    assert S.count(docs, Query.of([Part((Term("alpha"),))])) == 2
    assert S.append_new(gold, docs.select("doc_id").union(spark.createDataFrame([(7,)], "doc_id long"))).agg(F.sum("doc_id")).first()[0] == 10


def test_questions():
    p = Q.parse("What is the function of the p53 gene in humans?")
    assert p.words[-1] == "?" and p.chunks
    focus = Q.focus(p)
    assert focus.word == "gene" and focus.modifier == "function"
    assert Q.definition_phrases(Q.parse("What is mitochondrial myopathy?")) == ["mitochondrial myopathy"]
    assert Q.definition_phrases(Q.parse("Is aspirin a drug?")) is None
    assert Q.definition_phrases(Q.parse("Where is the gene?")) is None
    built = Q.build_query(p, keywords=["apoptosis"])
    assert "apoptosis" in built.rendered() and "p53 gene" in built.rendered()


def test_trees():
    tree = "(ROOT (S (NP (DT the) (JJ big) (NN gene)) (VP (VBZ binds) (NP (NP (NN protein)) (PP (IN of) (NP (NN yeast)))))))"
    assert [w for _, w in Q.tree_leaves(tree)] == "the big gene binds protein of yeast".split()
    assert [c.text for c in Q.tree_noun_phrases(tree)] == ["the big gene", "protein", "yeast"]
    assert Q.tree_leaves("nothing") is None


def test_whole_question_is_analysed():
    from quaero.operators import questions as Q

    focus, definition, query = Q.analysed("Patients took 3.5 mg of aspirin, e.g. daily. Which gene regulates calcium? The kidney filters blood.")
    assert focus == "gene" and definition is None
    assert all(w in query for w in ("Patients", "aspirin", "gene", "calcium", "kidney", "blood"))
    assert Q.analysed("A long story was told. What is aspirin?")[1] == "aspirin"
    assert Q.analysed("Which gene regulates calcium?") == (Q.focus(p := Q.parse("Which gene regulates calcium?")).phrase, None, Q.build_query(p).rendered())
    assert Q.analysed("") == Q.analysed(" . ") == (None, None, "")
