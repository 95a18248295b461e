"""Question understanding by rules over words and tags: tagging, noun phrases, definition questions, focus, query parts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from quaero.functions.lexing import acronyms, query_tokens
from quaero.functions.text import STOP_WORDS
from quaero.plans.query import Part, Query, Term, plural

#: Closed word classes for the default tagger, and verbs of definition questions.
CLOSED = {
    **dict.fromkeys(("what", "who", "whom"), "WP"), **dict.fromkeys(("which", "whatever"), "WDT"), **dict.fromkeys(("where", "when", "why", "how"), "WRB"), "whose": "WP$",
    **dict.fromkeys(("the", "a", "an", "this", "that", "these", "those", "any", "some", "each", "every", "no", "all"), "DT"),
    **dict.fromkeys(("of", "in", "on", "for", "with", "by", "from", "at", "into", "between", "during", "after", "before", "through", "against", "as", "than", "if", "about", "under", "via"), "IN"),
    "to": "TO", "and": "CC", "or": "CC", "but": "CC", "there": "EX", "not": "RB", "'s": "POS",
    **dict.fromkeys(("is", "has", "does"), "VBZ"), **dict.fromkeys(("are", "have", "do"), "VBP"), **dict.fromkeys(("was", "were", "had", "did"), "VBD"), "be": "VB", "been": "VBN", "being": "VBG",
    **dict.fromkeys(("can", "could", "may", "might", "must", "shall", "should", "will", "would"), "MD"),
    **dict.fromkeys(("it", "they", "he", "she", "we", "you", "i"), "PRP"), **dict.fromkeys(("its", "their", "his", "her", "our", "your", "my"), "PRP$"),
    "(": "-LRB-", ")": "-RRB-", "[": "-LSB-", "]": "-RSB-", ",": ",", ".": ".", "?": ".", "!": ".", ":": ":", ";": ":",
}
#: Verbs of a question that asks for a definition.
DEFINITION_VERBS = ("is", "are", "describe", "name", "list", "define", "explain", "defined", "described")
COMMON_VERBS = ("list", "name", "define", "describe", "explain", "cause", "causes", "treat", "treats", "inhibit", "inhibits", "bind", "binds", "regulate", "regulates", "affect", "affects", "include",
                "includes", "encode", "encodes", "target", "targets", "induce", "induces", "contain", "contains", "use", "uses", "show", "play", "plays", "interact", "interacts", "produce", "produces")
AUXILIARY = ("is", "are", "was", "were", "be", "been", "do", "does", "did", "has", "have", "had", "can", "could")


@dataclass(frozen=True)
class Chunk:
    """A noun phrase; ``end`` is the last token's index."""

    text: str
    start: int
    end: int


@dataclass(frozen=True)
class Focus:
    phrase: str
    word: str
    modifier: str | None = None
    second: str | None = None


@dataclass(frozen=True)
class Parsed:
    words: tuple[str, ...]
    tags: tuple[str, ...]
    chunks: tuple[Chunk, ...]

    @property
    def text(self) -> str:
        return " ".join(self.words)


Tagger = Callable[[list[str]], list[str]]


def tag(words: list[str]) -> list[str]:
    """The default tagger: closed classes, endings, and nouns for the rest. Pass another one where a trained tagger is at hand."""
    tags = []
    for i, w in enumerate(words):
        low, before = w.lower(), tags[-1] if tags else ""
        if low in CLOSED:
            tags.append(CLOSED[low])
        elif re.fullmatch(r"[-+]?[\d.,]+%?", w):
            tags.append("CD")
        elif not any(c.isalnum() for c in w):
            tags.append(":")
        elif low in COMMON_VERBS and (i == 0 or before.startswith(("N", "PRP", "MD", "TO"))):
            tags.append("VB" if before in ("MD", "TO", "") else "VBZ" if low.endswith("s") else "VBP")
        elif before in ("MD", "TO") and low.isalpha() and w.islower():
            tags.append("VB")
        elif low.endswith("ed") and len(low) > 4:
            tags.append("VBN")
        elif low.endswith("ly") and len(low) > 4:
            tags.append("RB")
        elif re.search(r"(ous|ical|ic|ive|able|ible|al|ary|less|ful)$", low) and len(low) > 4 and w.islower():
            tags.append("JJ")
        elif w[0].isupper() and i:
            tags.append("NNP")
        else:
            tags.append("NNS" if low.endswith("s") and not low.endswith(("ss", "is", "us")) else "NN")
    return tags


def chunk(words: list[str], tags: list[str]) -> list[Chunk]:
    """Maximal runs of determiners, adjectives, participles, numbers and nouns that end in a noun; determiners are cut off in front."""
    found, i = [], 0
    inside = ("DT", "JJ", "N", "CD", "VBN", "VBG", "PRP$", "POS", "FW")
    while i < len(words):
        j = i
        while j < len(words) and tags[j].startswith(inside):
            j += 1
        end = j
        while end > i and not tags[end - 1].startswith("N"):
            end -= 1
        start = i
        while start < end and tags[start] in ("DT", "PRP$"):
            start += 1
        if start < end:
            found.append(Chunk(" ".join(words[start:end]), start, end - 1))
        i = max(j, i + 1)
    return found


def parse(question: str, tagger: Tagger = tag) -> Parsed:
    words = query_tokens(question)
    tags = tagger(words)
    return Parsed(tuple(words), tuple(tags), tuple(chunk(words, tags)))


def parse_sentences(question: str, tagger: Tagger = tag) -> list[Parsed]:
    """Each sentence of a text parsed by itself; the tokenizer says which full stops end one."""
    sentences: list[list[str]] = [[]]
    for w in query_tokens(question):
        if w != ".":
            sentences[-1].append(w)
        if w in (".", "?", "!") and sentences[-1]:
            sentences.append([])
    return [Parsed(tuple(words), tuple(tags), tuple(chunk(words, tags))) for words in sentences if words for tags in (tagger(words),)]


# Trees ----------------------------------------------------------------------------------------------------------------


def tree_leaves(tree: str) -> list[tuple[str, str]] | None:
    """(tag, token) leaves of a bracketed parse tree in order; None if it is not one."""
    if not re.match(r"\s*\((S|NP|ROOT|\(|\s)", tree):
        return None
    return re.findall(r"\(([^\s()]+) ([^\s()]+)\)", tree)


def tree_noun_phrases(tree: str) -> list[Chunk]:
    """Noun phrase nodes without a preposition inside, not a lone pronoun or ``there``; a final verb is cut; nested ones are given too."""
    stack: list[tuple[str, int]] = []
    leaves: list[tuple[str, str]] = []
    found: list[Chunk] = []
    for bra, label, word, ket in re.findall(r"(\()\s*([^\s()]*)|([^\s()]+)|(\))", tree):
        if bra:
            stack.append((label, len(leaves)))
        elif word:
            leaves.append((stack[-1][0], word))
        elif ket and stack:
            label, start = stack.pop()
            own = leaves[start:]
            if label == "NP" and own and not any(t in ("IN", "TO") for t, _ in own) and not (len(own) == 1 and own[0][0] in ("EX", "PRP")):
                end = len(leaves) - (own[-1][0].startswith("V") and len(own) > 1)
                found.append(Chunk(" ".join(w for _, w in leaves[start:end]), start, end - 1))
    return sorted(found, key=lambda c: (c.start, -c.end))


def join_attributive(parsed: Parsed) -> Parsed:
    """Verbs between a determiner or adjective and a noun (from the third token on, no copula) join the chunks on both sides."""
    chunks = list(parsed.chunks)
    for i in range(2, len(parsed.words) - 1):
        if parsed.tags[i].startswith("V") and parsed.words[i].lower() not in ("is", "are") and parsed.tags[i - 1].startswith(("J", "DT")) and parsed.tags[i + 1].startswith("N"):
            left = [c for c in chunks if c.end == i - 1]
            right = [c for c in chunks if c.start == i + 1]
            for r in right:
                start = left[0].start if left else i
                chunks = [c for c in chunks if c is not r and c not in left]
                chunks.append(Chunk(" ".join(parsed.words[start : r.end + 1]), start, r.end))
    return Parsed(parsed.words, parsed.tags, tuple(sorted(chunks, key=lambda c: c.start)))


# Classification -------------------------------------------------------------------------------------------------------


def definition_phrases(parsed: Parsed) -> list[str] | None:
    """The phrase(s) that a definition question asks about, else None."""
    words, tags = list(parsed.words), list(parsed.tags)
    if not words or any(t.startswith("W") for t in tags[1:]):
        return None
    first = words[0].lower()
    if (tags[0].startswith("W") and len(tags) > 1 and tags[1].startswith(("N", "J")) and tags[0] != "WRB") or first in ("where", "why", "when", "how", "list"):
        return None
    verbs = [w.lower() for w, t in zip(words, tags, strict=True) if t.startswith("V") and not (w[0].isupper() and w != words[0])]
    if len(verbs) > 2 or (verbs and verbs[0] == first and first in AUXILIARY):
        return None
    if len(verbs) == 2 and not (verbs[0] in AUXILIARY and verbs[1].endswith(("ed", "n"))):
        return None
    verb = verbs[-1] if len(verbs) == 2 else verbs[0] if verbs else first
    if verb not in DEFINITION_VERBS or not parsed.chunks:
        return None
    chunks = parsed.chunks
    if len(chunks) == 1:
        return _with_brackets(chunks[0], parsed)
    whole = next((c for c in chunks if all(c.start <= o.start and o.end <= c.end for o in chunks)), None)
    if whole:
        return _with_brackets(whole, parsed)
    a, z = chunks[0], chunks[-1]
    if len(chunks) == 2 and a.end + 1 < len(words) and words[a.end + 1] == "(":
        return [a.text, z.text]
    return None


def _with_brackets(c: Chunk, parsed: Parsed) -> list[str]:
    m = re.fullmatch(r"(.+?) \( (.+?) \)", c.text)
    if m:
        return [m[1], m[2]]
    rest = parsed.words[c.end + 1 : c.end + 4]
    return [c.text, rest[1]] if len(rest) == 3 and rest[0] == "(" and rest[2] == ")" else [c.text]


def focus(parsed: Parsed) -> Focus | None:
    """The first noun behind the question word, or the noun it is qualified by (``kind of X``); the head is the last word of its noun phrase."""
    words, tags = parsed.words, parsed.tags
    if not words:
        return None
    start = 0
    if not (words[0].lower() == "list" or tags[0].startswith("V") or tags[0] == "MD"):
        start = next((i for i, t in enumerate(tags) if t.startswith("W")), len(words))
    for i in range(start + 1, len(words)):
        if i == start + 1 and tags[i].startswith("V"):
            if tags[start].startswith("W") and words[i].lower() in AUXILIARY:
                continue
            return None
        if tags[i].startswith("N"):
            c = _chunk_at(i, parsed)
            end = c.end if c else i
            behind = _behind_preposition(end, parsed)
            if behind is None:
                return Focus(c.text if c else words[i], _head(words[end]))
            c2 = _chunk_at(behind, parsed)
            end2 = c2.end if c2 else behind
            phrase = " ".join([words[end], words[end + 1], c2.text if c2 else words[behind]])
            third = _behind_preposition(end2, parsed)
            if third is None:
                return Focus(phrase, _head(words[end2]), words[end])
            c3 = _chunk_at(third, parsed)
            return Focus(f"{phrase} {words[end2 + 1]} {c3.text if c3 else words[third]}", _head(words[end2]), words[end], _head(words[c3.end if c3 else third]))
    return None


def _chunk_at(i: int, parsed: Parsed) -> Chunk | None:
    """The longest noun phrase that covers a token."""
    return max((c for c in parsed.chunks if c.start <= i <= c.end), key=lambda c: c.end - c.start, default=None)


def _behind_preposition(i: int, parsed: Parsed) -> int | None:
    if i + 2 < len(parsed.words) and parsed.words[i + 1].lower() in ("of", "in"):
        return next((j for j in range(i + 2, min(i + 6, len(parsed.words))) if parsed.tags[j].startswith("N")), None)
    return None


def _head(word: str) -> str:
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "is", "us")) and len(word) > 3 else word


# Query building -------------------------------------------------------------------------------------------------------


def build_query(parsed: Parsed, weights: dict[str, float] | None = None, keywords: list[str] | None = None, option: str = "ENSURE_INCLUSION",
                nouns: dict[str, list[str]] | None = None, lemma: Callable[[str], str] | None = None, vocabulary: set[str] | None = None) -> Query:
    """Noun phrases, nouns outside them and content verbs as OR-connected parts.

    Coordinated phrases share a part; verbs bring their base form and nominalizations; an acronym in brackets joins its expansion; phrases bring the sub-phrases that
    the vocabulary knows. ``option`` FILTER keeps parts with a keyword, ENSURE_INCLUSION adds keywords that no part has, BOOST weighs them.
    """
    words, tags = list(parsed.words), list(parsed.tags)
    short = dict(acronyms(words, tags))
    parts: list[Part] = []
    covered: set[int] = set()
    for c in join_attributive(parsed).chunks:
        covered |= set(range(c.start, c.end + 1))
        terms = [Term(t, phrase=" " in t, tag="NN") for t in re.split(r" (?:and|or) ", c.text) if t]
        for a, expansion in short.items():
            if expansion.lower() in c.text.lower() and all(t.text != a for t in terms):
                terms.append(Term(a, tag="NNP"))
        if vocabulary is not None:
            have = {t.text for t in terms}
            tokens = c.text.split()
            subs = [" ".join(tokens[i:]) for i in range(1, len(tokens) - 1)] + [" ".join(tokens[:-i]) for i in range(1, len(tokens) - 1)]
            hits = [s for s in subs if s in vocabulary] or [w for w in tokens if w in vocabulary and len(tokens) > 1]
            terms += [Term(s, phrase=" " in s, tag="NN") for s in dict.fromkeys(hits) if s not in have]
        parts.append(Part(tuple(terms)))
    for i, (w, t) in enumerate(zip(words, tags, strict=True)):
        if i in covered or w.lower() in STOP_WORDS or w.lower() in AUXILIARY or (i == 0 and w.lower() in ("list", "name")):
            continue
        if t.startswith("N"):
            parts.append(Part(tuple(Term(x, tag=t) for x in dict.fromkeys((w, lemma(w) if lemma else w)))))
        elif t.startswith("V"):
            base = lemma(w) if lemma else w
            parts.append(Part(tuple(Term(x, tag=t) for x in dict.fromkeys((w, base, *(nouns or {}).get(base.lower(), ()))))))
    query = Query.of(parts).deduplicated().without_term("list").without_stop_words()
    if weights:
        query = query.weighted(weights)
    keys = [k.lower() for k in keywords or []]
    has = lambda p: any(k in t.text.lower() for t in p.terms for k in keys)
    if keys and option == "FILTER":
        query = Query.of([p for p in query.parts if has(p)])
    elif keys and option == "ENSURE_INCLUSION":
        seen = " ".join(t.text.lower() for p in query.parts for t in p.terms)
        query = Query.of([*query.parts, *(Part((Term(k), Term(plural(k)))) for k in keys if k not in seen)])
    elif keys and option == "BOOST":
        query = query.boosted(keys)
    return query


def analysed(question: str) -> tuple[str | None, str | None, str]:
    """(focus, definition phrase, query) of a text: the first sentence's that has one, and the parts of all sentences, those that repeat left out."""
    parsed = parse_sentences(question)
    focused = next((f.phrase for f in map(focus, parsed) if f), None)
    defined = next((d[0] for d in map(definition_phrases, parsed) if d), None)
    return focused, defined, Query.of([part for p in parsed for part in build_query(p).parts]).deduplicated().rendered()
