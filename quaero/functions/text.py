"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that never carry a query or an answer by themselves.
STOP_WORDS = tuple(
    (
        "a able about across after all almost also am among an and any are as at be because been but by can cannot could "
        "dear did do does either else ever every for from get got had has have he her hers him his how however i if in "
        "into is it its just least let like likely may me might most must my neither no nor not of off often on only or "
        "other our own rather said say says she should since so some than that the their them then there these they this "
        "tis to too twas us wants was we were what when where which while who whom why will with would yet you your"
    ).split()
)
ARTICLES = ("the", "a", "an")


def strip_ws(x: Column) -> Column:
    """Join key of a text: without any white space."""
    return F.regexp_replace(x, r"\s+", "")


def is_all_special(x: Column) -> Column:
    """No letter and no digit; true for the empty string."""
    return ~x.rlike(r"[\p{L}\p{Nd}]")


def is_all_capital(x: Column) -> Column:
    return x.rlike(r"^\p{Lu}+$")


def is_all_letters(x: Column) -> Column:
    return x.rlike(r"^\p{L}+$")


def has_numbers(x: Column, at_least: int = 1) -> Column:
    return F.regexp_count(x, F.lit(r"\p{Nd}")) >= at_least


def is_vowel(x: Column) -> Column:
    return F.lower(x).isin("a", "e", "i", "o", "u")


def count_char(x: Column, char: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(char), F.lit("")))


def count_overlapping(x: Column, part: str) -> Column:
    """Occurrences of a part, overlapping ones included."""
    return F.regexp_count(x, F.lit(f"(?=\\Q{part}\\E)"))


def equal_no_ws(a: Column, b: Column) -> Column:
    """Equal once white space is dropped and curly quotes are straight."""
    key = lambda x: F.translate(strip_ws(x), "‘’“”", "''\"\"")
    return key(a) == key(b)


def ws_tokens(x: Column) -> Column:
    """White-space tokens; blank texts have none."""
    return F.when(F.trim(x) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+"))


def ws_tokens_with_offsets(x: Column) -> Column:
    """Tokens with (start, end) offsets, end exclusive."""
    parts = F.regexp_extract_all(x, F.lit(r"(\s*)(\S+)"), F.lit(0))
    step = lambda acc, p: F.struct(
        F.concat(acc["found"], F.array(F.struct(
            F.ltrim(p).alias("token"),
            (acc["at"] + F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))).alias("start"),
            (acc["at"] + F.length(p)).alias("end"),
        ))).alias("found"),
        (acc["at"] + F.length(p)).alias("at"),
    )
    empty = F.struct(F.array().cast("array<struct<token:string,start:int,end:int>>").alias("found"), F.lit(0).alias("at"))
    return F.transform(F.aggregate(parts, empty, step, lambda acc: acc["found"]), lambda s: F.struct(F.regexp_replace(s["token"], r"^\s+", "").alias("token"), s["start"].alias("start"), s["end"].alias("end")))


def split_slash_and_amp(tokens: Column) -> Column:
    """Tokens longer than three with one slash become three; ``&`` becomes ``and``."""
    cut = lambda t: F.when((F.length(t) > 3) & t.rlike("^[^/]+/[^/]+$"), F.array(F.substring_index(t, "/", 1), F.lit("/"), F.substring_index(t, "/", -1))).otherwise(
        F.array(F.when(t == "&", F.lit("and")).otherwise(t))
    )
    return F.flatten(F.transform(tokens, cut))


#: Bracket codes of treebank tokens.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def plain_brackets(x: Column) -> Column:
    for code, char in BRACKETS.items():
        x = F.replace(x, F.lit(code), F.lit(char))
    return x


def sentences(x: Column) -> Column:
    """Sentences of a text: runs up to a full stop, question or exclamation mark, trimmed, without blanks."""
    found = F.transform(F.regexp_extract_all(x, F.lit("[^.?!]+[.?!]?"), F.lit(0)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(found, lambda s: s != "")


def is_stop_word(x: Column) -> Column:
    return x.isin(*STOP_WORDS)


def to_number(x: Column, kind: str, default: float) -> Column:
    return F.coalesce(F.trim(x).try_cast(kind), F.lit(default).cast(kind))


def is_number(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), F.lit(False))


def is_all_digits(x: Column) -> Column:
    return x.rlike(r"^\p{Nd}+$")


def looks_like_number(x: Column) -> Column:
    """Digits with separators, signs, percent."""
    return x.rlike(r"^[-+]?[\d.,]*\d[\d.,]*%?$")


def to_bool(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("true", "yes", "1")


def one_decimal(x: Column) -> Column:
    return F.format_number(x, 1)


def eligible_phrase(x: Column) -> Column:
    """A letter first, not a number, not all special, not a stop word."""
    return x.rlike(r"^\p{L}") & ~is_number(x) & ~is_all_special(x) & ~is_stop_word(F.lower(x))


def strip_article(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?i)^\s*({'|'.join(ARTICLES)})\s+", "")


def split_conjunctions(x: Column) -> Column:
    """Parts of a phrase between ``and`` and ``or``, articles stripped."""
    parts = F.transform(F.split(x, r"(?i)\s+(?:and|or)\s+"), lambda p: F.trim(strip_article(p)))
    return F.filter(parts, lambda p: p != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; a lambda would compute an expression that it refers to anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by a space."""

    def runs(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))

    return let(tokens, runs)


def suffixes(tokens: Column, at_least: int = 1) -> Column:
    """Proper suffixes with ``at_least`` tokens, the longest first."""

    def runs(t: Column) -> Column:
        starts = F.when(F.size(t) > at_least, F.sequence(F.lit(2), F.size(t) - at_least + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.size(t)), " "))

    return let(tokens, runs)


def prefixes(tokens: Column, at_least: int = 1) -> Column:
    """Proper prefixes with ``at_least`` tokens, the longest first."""

    def runs(t: Column) -> Column:
        sizes = F.when(F.size(t) > at_least, F.sequence(F.size(t) - 1, F.lit(at_least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.transform(sizes, lambda k: F.array_join(F.slice(t, 1, k), " "))

    return let(tokens, runs)


def sub_phrases(tokens: Column) -> Column:
    """What a phrase may be looked up as: itself, its proper suffixes, and each token that is no stop word."""
    single = F.filter(tokens, lambda t: ~is_stop_word(F.lower(t)) & t.rlike(r"^\p{L}"))
    return F.array_distinct(F.concat(F.array(F.array_join(tokens, " ")), suffixes(tokens), single))


def vocabulary_candidates(tokens: Column) -> Column:
    """Proper suffixes, then proper prefixes, of two tokens or more."""
    return F.array_distinct(F.concat(suffixes(tokens, 2), prefixes(tokens, 2)))


def common_prefix(a: Column, b: Column, at_least: int = 4) -> Column:
    """The longest common prefix if it has ``at_least`` characters, else null."""
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)), i).otherwise(acc),
    )
    return F.when(n >= at_least, F.substring(a, F.lit(1), n))


def id_of_url(x: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(x, "/", -1)


def item_number(x: Column) -> Column:
    """The number in ``12) text``, else null."""
    return F.regexp_extract(x, r"^(\d+)\)", 1).try_cast("int")


def score_suffix(x: Column) -> Column:
    """The score in ``text [0.42]``, else null."""
    return F.regexp_extract(x, r"\[([-+0-9.eE]+)\]", 1).try_cast("double")


def keyword_labels(tags: Column) -> Column:
    """1 for noun and adjective tags, else 0."""
    return F.transform(tags, lambda p: F.when(F.substring(p, 1, 1).isin("N", "J"), 1).otherwise(0))


#: Tag classes over the Penn treebank tags.
TAG_CLASSES = {
    "noun": ("NN", "NNS", "NNP", "NNPS"), "common_noun": ("NN", "NNS"), "proper_noun": ("NNP", "NNPS"), "plural_noun": ("NNS", "NNPS"),
    "verb": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"), "past": ("VBD", "VBN"), "participle": ("VBG", "VBN"), "adjective": ("JJ", "JJR", "JJS"),
    "adverb": ("RB", "RBR", "RBS"), "pronoun": ("PRP", "PRP$"), "wh": ("WDT", "WP", "WP$", "WRB"), "determiner": ("DT", "PDT", "WDT"),
    "preposition": ("IN", "TO"), "conjunction": ("CC",), "number": ("CD",), "modal": ("MD",), "particle": ("RP",), "possessive": ("POS", "PRP$", "WP$"),
    "punctuation": (".", ",", ":", "``", "''", "-LRB-", "-RRB-"), "existential": ("EX",),
}


def tag_is(tag: Column, kind: str) -> Column:
    return tag.isin(*TAG_CLASSES[kind])


def one_hot(index: Column, size: int) -> Column:
    """An array of zeros with a one at ``index`` (from 0; none if it is out of range)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def padded(values: Column, size: int, fill: float = 0.0) -> Column:
    """Cut or filled up to ``size`` entries."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), size)), 1, size)
