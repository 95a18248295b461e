import random

import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key string, size string, words string, b long, digest string, spans int, label string"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and blank texts, a long one and non-ASCII words."""
    rng = random.Random(seed)
    words = [w + e for w in "alpha Beta gamma été delta Über eps zeta η theta iota kappa".split() for e in ("", "s", "en", "ing", "ó")]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = sentence(40)
    texts: list = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            t = rng.choice(texts)
        elif kind < 0.45 and texts:
            base = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            t = " ".join(base)
        elif kind < 0.6:
            t = sentence(rng.randint(0, 30)) + "\n" + passage + ".\n" + sentence(rng.randint(0, 30))
        else:
            t = "\n".join(sentence(rng.randint(1, 60)) for _ in range(rng.randint(1, 4)))
        texts.append(t)
    texts += [None, "", " \t\n", "ab", None, "one two", "one  TWO", "ONE two\n", sentence(3000), "x " * 400, "İstanbul é " * 30, "*** ### !!! " * 20]
    rows = [(i * 3 - 9, t, rng.choice(["s0", "s0", "s1", None, ""]), "en", None, "k", "big", "w", 5, "d", 1, "l") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(7)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Repeated rows, repeated ids with other texts, and null ids."""
    more = [rows[0], rows[0], (rows[1][0], "another text for the same id " * 8, *rows[1][2:]), (None, rows[2][1], *rows[2][2:]), (None, None, *rows[2][2:]), (None, rows[2][1], *rows[2][2:])]
    return spark.createDataFrame(rows[:20] + more, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
