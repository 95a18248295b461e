"""All questions at once against a plain loop over questions, documents, rungs and sentences."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from quaero.operators import entities as E
from quaero.operators import phrases as P
from quaero.operators import questions as Q
from quaero.plans import batch as B
from quaero.plans.query import Part, Query, Term

WORDS = "alpha beta gamma delta epsilon zeta kappa lambda sigma omega liver heart protein regulates calcium binds iron nothing".split()
KNOWN = [("alpha", "protein"), ("beta", "gene"), ("gamma", "disease"), ("heart", "anatomical entity"), ("Sigma Omega", "gene"), ("beta", "drug")]
QUESTIONS = {
    1: "What is alpha beta?", 2: "Which gene regulates alpha and heart calcium?", 3: "When does the liver protein bind sigma iron?", 4: "What is zzz?", 5: "alpha beta gamma delta epsilon zeta kappa lambda",
    6: "Which diseases regulate beta?", 7: "unknown words only", 8: "sigma omega, liver*; heart protein calcium iron binds nothing kappa", 9: "", 10: None,
}


def _corpus():
    rng = random.Random(2)
    texts = []
    for _ in range(170):
        sentences = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 12))).capitalize() + rng.choice([".", "?", " ."]) for _ in range(rng.randint(1, 4))]
        texts.append(" ".join(sentences))
    texts += ["Such things as these, also called alpha beta are known in the whole world by all people.", "It says that alpha beta is a protein of the liver and of the heart.", None, "", "...", texts[3], texts[4]]
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)]


DOCS = _corpus()
WEIGHTS = {w: round(0.1 + 0.9 * i / len(WORDS), 3) for i, w in enumerate(WORDS)}
VECTORS = {w: [math.sin(i * 3 + k) for k in range(5)] for i, w in enumerate(WORDS)}


def _has(text, term):
    words = re.findall(r"[a-z0-9]+", term.lower())
    return bool(words) and re.search(r"(?<![a-z0-9])" + "[^a-z0-9]+".join(words) + r"(?![a-z0-9])", text.lower()) is not None


def _matches(text, query, connective):
    each = [(all if p.inner == "AND" else any)(_has(text, t.text) for t in p.terms) for p in query.parts]
    return bool(each) and (all(each) if connective == "AND" else any(each))


def _found(query, ladder):
    rungs, q = (list(query.ladder()), None) if ladder else ([], query if query.parts else None)
    while q is not None:
        rungs.append(q)
        q = q.without_last()
    texts = [(d, t) for d, t in DOCS if t]
    counts = [sum(_matches(t, r, "AND") for _, t in texts) for r in rungs]
    chosen = None
    if ladder:
        for k, n in enumerate(counts):
            chosen = k if n else None
            if n >= 40:
                before = [j for j in range(k) if counts[j]]
                chosen = before[-1] if n > 1000 and before and counts[before[-1]] > 10 else k
                break
    else:
        chosen = next((k for k, n in enumerate(counts) if n), None)
    rung, connective = (query, "OR") if chosen is None else (rungs[chosen], "AND")
    scored = [(-sum(x.weight for p in rung.parts for x in p.terms if _has(t, x.text)), d) for d, t in texts if _matches(t, rung, connective)]
    return [d for _, d in sorted(scored)]


def _cosine(a, b):
    return float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))


def _answers(question, mode, most):
    parsed = Q.parse(question)
    words = {w.lower() for w in parsed.words}
    weights = {w: WEIGHTS[w] for w in words if w in WEIGHTS}
    table = {}
    for term, kind in KNOWN:
        table[term.lower()] = tuple(sorted({*table.get(term.lower(), ()), kind}, key=E.TYPE_ORDER.index))
    docs = []
    for strategy in B.MODES[mode]:
        terms = {t.text.lower() for p in B.query_of(question, weights, strategy, {}).parts for t in p.terms}
        query = B.query_of(question, weights, strategy, {t: E.query_types(t, table) for t in terms})
        docs += [d for d in _found(query, strategy.startswith("baseline")) if d not in docs]
    sentences = []
    for d, t in DOCS:
        if d in docs and t:
            split = [s.strip() for s in re.findall(r"[^.?!]+[.?!]?", t) if s.strip()]
            sentences += [(d, k, s) for k, s in enumerate(split)]
    phrase = (Q.definition_phrases(parsed) or [None])[0]
    if phrase:
        p = re.escape(phrase)
        tests = [rf"\s+such\s+as\s+{p}", rf"\s+also\s+called\s+{p}", rf"{p}\s*,\s*an?\s+\w+\s+", rf"{p}\s+are\s+\w+\s+"]
        behind = lambda s: re.match(r"[\W_]*is[\s.]\s*\S", s[s.lower().index(phrase.lower()) + len(phrase) :])
        defined = sorted((d, k, s) for d, k, s in sentences if phrase.lower() in s.lower() and (any(re.search(t, s) for t in tests) or behind(s)))
        if defined:
            return [(d, k, s, 1.0) for d, k, s in defined[:most]]
    scored = []
    for d, k, s in sentences:
        near = [w for w in re.findall(r"[a-z0-9]+", s.lower()) if w in VECTORS]
        above = sum(WEIGHTS[w] * max(_cosine(VECTORS[w], VECTORS[x]) for x in near) for w in weights) if near else 0
        scored.append((d, k, s, above / sum(weights.values()) if above > 0 else 0.0))
    focus, types = Q.focus(parsed), []
    if focus:
        types = [*E.query_types(focus.word.lower(), table), *([E.FOCUS_NOUNS[focus.word.lower()]] if focus.word.lower() in E.FOCUS_NOUNS else [])]
    if types:
        named = list(E.tag_text(parsed.text, {w: k for w, k in table.items() if w in words}))
        rows = []
        for d, k, s, score in scored:
            entities = E.tag_text(s, table)
            if any(e not in named and set(entities[e]) & set(types) for e in entities):
                rows.append((d, k, s, score, 1 + sum(e in named for e in entities) / len(named) if named else 1.0))
        best = max((r[4] for r in rows), default=1)
        scored = [(d, k, s, 0.8 * score + 0.2 * f / best) for d, k, s, score, f in rows]
    first = {}
    for d, k, s, score in sorted(scored, key=lambda r: (-round(r[3], 6), r[0], r[1])):
        first.setdefault(re.sub(r"\s+", "", s), (d, k, s, score))
    return [r for r in sorted(first.values(), key=lambda r: (-round(r[3], 6), r[0], r[1])) if len(r[2]) >= 40][:most]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id long, text string, qid string").repartition(5)
    vocabulary = spark.createDataFrame(list(WEIGHTS.items()), "term string, weight double")
    vectors = spark.createDataFrame(list(VECTORS.items()), "term string, embedding array<double>")
    return docs, vocabulary, vectors, spark.createDataFrame(KNOWN, "term string, entity_type string")


def _asked(spark, questions):
    return spark.createDataFrame([(q, t, 1) for q, t in questions.items()], "qid long, question string, doc_id int")


@pytest.mark.parametrize(("mode", "at_once"), [("baseline", 1000), ("ensemble", 2), ("hybrid", 1000), ("baseline-kw", 1000)])
def test_equal_to_a_plain_loop(spark, tables, monkeypatch, mode, at_once):
    monkeypatch.setattr(B, "QUESTIONS_AT_ONCE", at_once)
    monkeypatch.setattr(B, "BLOCK_BYTES", 2000)
    docs, vocabulary, vectors, known = tables
    got = {}
    for r in B.ask_all(docs, _asked(spark, QUESTIONS), vocabulary, vectors, known, 6, mode).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_id, r.sid, r.sentence, r.score))
    want = {q: rows for q, t in QUESTIONS.items() if t and (rows := _answers(t, mode, 6))}
    assert got.keys() == want.keys() and {1, 2, 3, 8} <= set(want)
    for q, rows in want.items():
        found = sorted(got[q])
        assert [r[4] for r in found] == pytest.approx([r[3] for r in rows], abs=1e-5), (q, mode)
        assert [r[1:4] for r in found] == [r[:3] for r in rows], (q, mode)


def test_equal_to_the_engine_and_reranked(spark, tables):
    from quaero.plans.engine import Engine

    docs, vocabulary, vectors, known = tables
    engine = Engine(docs.drop("qid"), vocabulary, vectors, known)
    some = {q: QUESTIONS[q] for q in (1, 2, 3)}
    got = {}
    for r in B.ask_all(docs, _asked(spark, some), vocabulary, vectors, known, 4, "rank").collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_id, r.sid))
    for q, text in some.items():
        assert sorted(got[q]) == sorted((r["rank"], r.doc_id, r.sid) for r in engine.ask_table(text, 4, "rank").collect())
    by_length = lambda questions, sentences: [float(len(s)) for s in sentences]
    ranked = B.ask_all(docs, _asked(spark, {3: QUESTIONS[3]}), vocabulary, vectors, known, 5, scorer=by_length).collect()
    lengths = [len(r.sentence) for r in sorted(ranked, key=lambda r: r["rank"])]
    assert len(lengths) == 5 and lengths == sorted(lengths, reverse=True)


def test_nothing_to_ask_or_to_find(spark, tables):
    docs, vocabulary, vectors, known = tables
    assert B.ask_all(docs, _asked(spark, {1: "alpha"}).limit(0), vocabulary, vectors, known).collect() == []
    assert B.ask_all(docs.limit(0), _asked(spark, {1: "alpha", 2: "What is alpha?"}), vocabulary, vectors, known).collect() == []


def test_compiled_rungs_are_the_ladder():
    rng = random.Random(4)
    for _ in range(40):
        parts = [Part(tuple(Term(f"w{rng.randrange(9)}", types=("gene",) * rng.randrange(2)) for _ in range(rng.randint(1, 4))), rng.random(), rng.choice(["OR", "OR", "AND"])) for _ in range(rng.randint(1, 5))]
        query = Query.of(parts).grouped() if rng.random() < 0.5 else Query.of(parts)
        for ladder in (True, False):
            ask = B.compiled(query, ladder)
            rungs = list(query.ladder()) if ladder else [Query.of(query.parts[:k]) for k in range(len(query.parts), 0, -1)]
            words, terms = B._numbered([ask])
            texts = [{t for t in range(len(words)) if rng.random() < 0.5} for _ in range(30)]
            m = B._Matched([ask], terms, len(words), [np.array(sorted(t), np.int32).tobytes() for t in texts])
            depth = m.depth(0)
            on = m.on_rungs(0, depth, [np.packbits(t, axis=1) for t in B.failing(ask)])
            assert m.any_part(0, depth).tolist() == [_matches(" ".join(words[t][0] for t in s), Query.of(query.parts), "OR") for s in texts]
            spoken = [" ".join(words[t][0] for t in sorted(s)) for s in texts]
            assert len(ask.rungs) == len(rungs)
            for k, (counts, rung) in enumerate(zip(ask.rungs, rungs, strict=True)):
                assert on[:, k].tolist() == [_matches(s, rung, "AND") for s in spoken]
                assert m.score(0, counts).tolist() == pytest.approx([sum(t.weight for p in rung.parts for t in p.terms if _has(s, t.text)) for s in spoken])


def test_automaton_equals_a_search_at_every_place(spark):
    rng = random.Random(9)
    words = ["a", "b", "c", "dé"]
    phrases = list({tuple(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    texts = [[rng.choice([*words, "x"]) for _ in range(rng.randint(0, 40))] for _ in range(60)]
    automaton = P.Automaton(phrases)
    where = lambda t: {(i, i + len(p), k) for k, p in enumerate(phrases) for i in range(len(t) - len(p) + 1) if tuple(t[i : i + len(p)]) == p}
    for t in texts:
        assert set(automaton.find(t)) == where(t)
        assert automaton.found(t) == {k for *_, k in where(t)}
    assert list(P.Automaton([()]).find(["a"])) == []
    docs = spark.createDataFrame([(i, " ".join(t).upper() + ".") for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    listed = spark.createDataFrame([(" ".join(p),) for p in phrases] + [("--",), (None,)], "phrase string")
    want = sorted((i, a, z - a, " ".join(phrases[k])) for i, t in enumerate(texts) for a, z, k in where(t))
    for most in (1000, 3):
        assert sorted(map(tuple, P.occurrences(docs, listed, most=most).collect())) == want


def test_numbered_in_order(spark):
    from pyspark.sql import functions as F

    from quaero.operators.preparation import numbered

    rows = [(random.Random(i).randrange(50), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = sorted(map(tuple, numbered(frame, [F.desc("a"), F.col("b")], "n").select("n", "a", "b").collect()))
    assert got == [(n, a, b) for n, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
    assert numbered(frame.limit(0), [F.col("a")], "n").collect() == []
    assert list(itertools.chain(got))[0][0] == 0
