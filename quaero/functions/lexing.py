"""Token functions that scan with state: Python rules over one text, wrapped as Arrow UDFs where a column needs them."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations whose full stop does not end a token.
ABBREVIATIONS = (
    "vs.", "i.", "i.e.", "i.p.", "e.", "e.g.", "U.", "U.S.", "S.", "S.D.", "M.", "M.E.", "d.", "d.f.", "s.c.",
    "etc.", "et.", "cat.", "Cat.", "no.", "No.", "al.", "Dr.",
)

_ALWAYS = set("?!\"%")
Token = tuple[str, int, int]


def _stop_splits(text: str, i: int) -> bool:
    """Whether the full stop at i stands alone."""
    if i + 1 == len(text):
        return True
    following = text[i + 1]
    if following.isdigit() or any(text[: i + 1].endswith(a) and (i + 1 == len(a) or not text[i - len(a)].isalnum()) for a in ABBREVIATIONS):
        return False
    if following.isspace():
        return True
    if i and text[i - 1].isupper() and following.islower():  # a shortened genus name
        return False
    rest = re.match(r"\S+", text[i + 1 :])[0]
    return not (any(c.isdigit() for c in rest) or sum(c.isupper() for c in rest) > 1)  # a gene name


def _splits(text: str, i: int, in_url: bool) -> bool:
    """Whether the character at i is a token of its own."""
    c, before, after = text[i], text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
    if c in _ALWAYS:
        return True
    if c == ".":
        return not in_url and _stop_splits(text, i)
    if c == ",":
        return not after.isdigit()
    if c == ":":
        return not (in_url or after == "/" or (before.isdigit() and after.isdigit()))
    if c in ")]":
        return after.isspace() or after == "?" or (after == "." and i + 2 == len(text))
    if c in "([":
        return not before.isalpha()
    return False


def tokens(text: str) -> list[Token]:
    """(token, start, end) of a biomedical text, end exclusive: keeps decimals, addresses, abbreviations, gene and species names and
    compound names whole, and parts possessives."""
    found: list[Token] = []
    for run in re.finditer(r"\S+", text or ""):
        start, in_url = run.start(), bool(re.search(r"://|www\.", run[0]))

        def cut(end: int, start_: int) -> int:
            if end > start_:
                found.append((text[start_:end], start_, end))
            return end

        i = run.start()
        while i < run.end():
            if text[i] == "'" and i > run.start():
                rest = text[i + 1 : run.end()]
                if rest in ("s", "") or re.match(r"s?[.,?!]", rest):
                    start = cut(i, start)
                    end = i + 1 + (rest[:1] == "s")
                    start = i = cut(end, start)
                    continue
            elif _splits(text, i, in_url):
                start = cut(i, start)
                start = i = cut(i + 1, start)
                continue
            i += 1
        cut(run.end(), start)
    return found


def query_tokens(text: str) -> list[str]:
    """Tokens with a single slash taken apart and ``&`` spelt out."""
    out: list[str] = []
    for t, _, _ in tokens(text):
        if t == "&":
            out.append("and")
        elif len(t) > 3 and t.count("/") == 1 and t[0] != "/" and t[-1] != "/":
            a, z = t.split("/")
            out += [a, "/", z]
        else:
            out.append(t)
    return out


def merge_phrases(words: list[str], phrases: Collection[str], most: int = 4) -> list[str]:
    """Greedy longest phrases: from each token on, grow while every longer run is a known phrase; joined with ``_``. Tokens without a letter or
    digit are dropped."""
    out, i = [], 0
    while i < len(words):
        if not any(c.isalnum() for c in words[i]):
            i += 1
            continue
        n = 1
        while n < most and i + n < len(words) and " ".join(words[i : i + n + 1]) in phrases:
            n += 1
        out.append("_".join(words[i : i + n]))
        i += n
    return out


def range_without_ws(part: str, text: str) -> tuple[int, int] | None:
    """(start, end) of the first place where ``part`` stands in ``text`` if white space is ignored in both."""
    places = [i for i, c in enumerate(text) if not c.isspace()]
    key = "".join(part.split())
    at = "".join(text[i] for i in places).find(key)
    return None if at < 0 or not key else (places[at], places[at + len(key) - 1] + 1)


def to_token_start(at: int, text: str) -> int:
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return at


def to_token_end(at: int, text: str) -> int:
    while at < len(text) and not text[at].isspace():
        at += 1
    return at


def common_run(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest run of tokens that both have; tokens without a letter or digit equal each other."""
    key = lambda t: t if any(c.isalnum() for c in t) else ""
    best, last = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if key(x) == key(y):
                row[j] = last[j - 1] + 1
                if row[j] > best[2]:
                    best = (i - row[j], j - row[j], row[j])
        last = row
    return best


def wrap(text: str, width: int) -> str:
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}".strip()
    return "\n".join([*lines, line] if line else lines)


def acronyms(words: list[str], tags: list[str]) -> list[tuple[str, str]]:
    """(acronym, expansion) of ``... expansion ( ABC ) ...``: walks left over words that may belong, and takes the shortest run that starts with
    the first letter and in which the acronym's letters are found in order, the first of each at or inside a word."""
    allowed = ("N", "JJ", "VB", "FW", "POS", "TO", "IN", "CC", "CD")
    found = []
    for i in range(1, len(words) - 2):
        short = words[i + 1]
        if words[i] != "(" or words[i + 2] != ")" or not re.fullmatch(r"(?=.*[A-Z].*[A-Z])[A-Za-z0-9-]{2,10}", short):
            continue
        letters = [c.lower() for c in short if c.isalnum()]
        start = i
        while start > 0 and i - start < len(letters) + 4 and tags[start - 1].startswith(allowed):
            start -= 1
            run = [p for w in words[start:i] for p in w.lower().split("-")]
            if run[0][:1] == letters[0] and _spells(letters, run):
                found.append((short, " ".join(words[start:i])))
                break
    return found


def _spells(letters: list[str], run: list[str]) -> bool:
    """Whether the letters can be read off the words in order, every word giving its first letter or being skipped as a small word."""
    reach = {(0, 0)}  # (letters used, words used)
    for w in range(len(run)):
        after = set()
        for used, _ in reach:
            if run[w] in ("of", "and", "the", "for", "in", "to", "a"):
                after.add((used, w + 1))
            k, at = used, -1
            while k < len(letters):
                at = run[w].find(letters[k], at + 1)
                if at < 0 or (k == used and at != 0):
                    break
                k += 1
                after.add((k, w + 1))
        reach = after
    return any(used == len(letters) for used, _ in reach)


TOKENS = "array<struct<token:string,start:int,end:int>>"


def tokens_column(text: Column) -> Column:
    @F.pandas_udf(TOKENS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"token": a, "start": b, "end": c} for a, b, c in tokens(t or "")])

    return run(text)


def query_tokens_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: query_tokens(t or ""))

    return run(text)


def merged_column(words: Column, phrases: Iterable[str], most: int = 4) -> Column:
    """:func:`merge_phrases` over an array column; ``phrases`` is a vocabulary of checked size that goes with the function."""
    known = frozenset(phrases)

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda w: merge_phrases(list(w), known, most))

    return run(words)
