import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaero.functions import lexing as L
from quaero.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame(pd.DataFrame({k: [v] for k, v in values.items()})).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("expression", "text", "wanted"),
    [
        (T.strip_ws, " a b\tc ", "abc"),
        (T.is_all_special, "", True),
        (T.is_all_special, "-(", True),
        (T.is_all_special, "a-", False),
        (T.is_all_capital, "DNA", True),
        (T.has_numbers, "p53", True),
        (T.ws_tokens, "  a  b ", ["a", "b"]),
        (T.ws_tokens, " ", []),
        (T.sentences, "One. Two? Three", ["One.", "Two?", "Three"]),
        (T.split_conjunctions, "the liver and a heart or lung", ["liver", "heart", "lung"]),
        (T.strip_article, "The gene", "gene"),
        (T.is_number, "-1.5e3", True),
        (T.is_number, "1a", False),
        (T.looks_like_number, "1,200%", True),
        (T.item_number, "12) text", 12),
        (T.score_suffix, "text [0.42]", 0.42),
        (T.plain_brackets, "-LRB-x-RRB-", "(x)"),
        (T.id_of_url, "http://a/b/17", "17"),
    ],
)
def test_expressions(spark, expression, text, wanted):
    assert one(spark, expression(F.col("x")), x=text) == wanted


def test_counts_and_offsets(spark):
    assert one(spark, T.count_overlapping(F.col("x"), "aa"), x="aaaa") == 3
    assert one(spark, T.count_char(F.col("x"), "a"), x="banana") == 3
    assert [tuple(r) for r in one(spark, T.ws_tokens_with_offsets(F.col("x")), x=" ab  c")] == [("ab", 1, 3), ("c", 5, 6)]


def test_phrases(spark):
    w = F.split("x", " ")
    assert one(spark, T.ngrams(w, 2), x="a b c") == ["a b", "b c"]
    assert one(spark, T.suffixes(w), x="a b c") == ["b c", "c"]
    assert one(spark, T.prefixes(w), x="a b c") == ["a b", "a"]
    assert one(spark, T.prefixes(w), x="a") == []
    assert one(spark, T.common_prefix(F.col("x"), F.col("y")), x="regulates", y="regulation") == "regulat"
    assert one(spark, T.common_prefix(F.col("x"), F.col("y")), x="abc", y="abd") is None
    assert one(spark, T.split_slash_and_amp(F.split("x", " ")), x="and/or & a/b") == ["and", "/", "or", "and", "a/b"]
    assert one(spark, T.keyword_labels(F.split("x", " ")), x="NN VB JJ") == [1, 0, 1]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("The p53 gene, e.g. TP53.", ["The", "p53", "gene", ",", "e.g.", "TP53", "."]),
        ("0.5 mg at 10:30", ["0.5", "mg", "at", "10:30"]),
        ("see http://a.org/x now", ["see", "http://a.org/x", "now"]),
        ("Alzheimer's disease", ["Alzheimer", "'s", "disease"]),
        ("What is it?", ["What", "is", "it", "?"]),
        ("factor (IL-2) binds", ["factor", "(", "IL-2", ")", "binds"]),
        ("1,000 cells", ["1,000", "cells"]),
        ("E.coli grows", ["E.coli", "grows"]),
    ],
)
def test_tokens(text, wanted):
    assert [t for t, _, _ in L.tokens(text)] == wanted


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1.,'()[]?!: \t%/", max_size=40))
def test_tokens_cover_the_text(text):
    found = L.tokens(text)
    assert all(text[a:b] == t for t, a, b in found)
    assert "".join(t for t, _, _ in found) == "".join(text.split())


def test_scanning_functions():
    assert L.merge_phrases(["a", "b", "c", "-", "d"], {"a b", "a b c"}) == ["a_b_c", "d"]
    assert L.merge_phrases(["a", "b", "c"], {"a b c"}) == ["a", "b", "c"]  # no prefix, no phrase
    assert L.range_without_ws("bcd", "a b c d") == (2, 7)
    assert L.common_run(["x", "a", "b"], ["a", "b", "y"]) == (1, 0, 2)
    assert L.query_tokens("A & wild/type") == ["A", "and", "wild", "/", "type"]
    words = "the tumor necrosis factor ( TNF ) binds".split()
    assert L.acronyms(words, ["DT", "NN", "NN", "NN", "-LRB-", "NN", "-RRB-", "VBZ"]) == [("TNF", "tumor necrosis factor")]
    assert L.wrap("aa bb cc", 5) == "aa bb\ncc"


def test_columns_of_python_functions(spark):
    df = spark.createDataFrame([("a b c.",), (None,)], "x string")
    assert [[t.token for t in r.x] for r in df.select(L.tokens_column(F.col("x")).alias("x")).collect()] == [["a", "b", "c", "."], []]
    assert [list(r.x) for r in df.select(L.merged_column(L.query_tokens_column(F.col("x")), {"a b"}).alias("x")).collect()] == [["a_b", "c"], []]
