import random

from quaero.llm import decontaminate as D


def test_shortest_stretches(spark):
    """Against brute force, with repeated words, ties, one term, nulls and rows without a word."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcxy") for _ in range(rng.randint(0, 25)))) for k in range(60)] + [(100, None), (101, ""), (102, "x x x x x x x x b x a x x b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for terms, span in ((["a", "b", "c"], 5), (["a", "b"], 3), (["c"], 1)):
        want = set()
        for k, text in rows:
            w = (text or "").split()
            holds = [(s, e) for s in range(len(w)) for e in range(s, min(len(w), s + span)) if set(terms) <= set(w[s : e + 1])]
            want |= {(k, s, e) for s, e in holds if not any((s, e) != (p, q) and s <= p and q <= e for p, q in holds)}
        got = [tuple(r) for r in D.proximity_matches(df, terms, span).collect()]
        assert set(got) == want and len(got) == len(want)
