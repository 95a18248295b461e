"""The engine's own logical query: weighted parts of alternative terms, grouped, rendered, relaxed and compiled to columns.

Queries are a handful of terms, so all rewriting happens in plain Python on the driver; what touches documents is the compiled predicate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaero.functions.text import STOP_WORDS


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False
    hyphen: str | None = None
    tag: str | None = None
    weight: float = 1.0
    types: tuple[str, ...] = ()

    def rendered(self, weighted: bool = False) -> str:
        shown = f'"{self.text}"' if self.phrase or "/" in self.text or " " in self.text else self.text
        return f"{shown}^{self.weight:.1f}" if weighted else shown


@dataclass(frozen=True)
class Part:
    terms: tuple[Term, ...]
    weight: float = 1.0
    inner: str = "OR"

    def __post_init__(self) -> None:
        if self.inner not in ("AND", "OR"):
            raise ValueError(f"a part joins its terms by AND or OR, not {self.inner!r}")

    @property
    def is_entity(self) -> bool:
        return any(t.types for t in self.terms)

    def rendered(self, weighted: bool = False) -> str:
        shown = f" {self.inner} ".join(t.rendered(weighted) for t in self.terms)
        return f"({shown})" if len(self.terms) > 1 else shown

    def contains(self, other: Part) -> bool:
        return any(o.text.lower() in t.text.lower() for t in self.terms for o in other.terms)


Group = tuple[Part, ...]


@dataclass(frozen=True)
class Query:
    """Parts joined by OR, or, once grouped, an AND of groups of ANDed parts."""

    groups: tuple[Group, ...] = field(default=())

    @staticmethod
    def of(parts: Iterable[Part]) -> Query:
        return Query(tuple((p,) for p in parts if p.terms))

    @property
    def parts(self) -> list[Part]:
        return [p for g in self.groups for p in g]

    @property
    def n_terms(self) -> int:
        return sum(len(p.terms) for p in self.parts)

    def rendered(self, connective: str = "AND", weighted: bool = False) -> str:
        return f" {connective} ".join(p.rendered(weighted) for p in self.parts)

    # Rewrites ----------------------------------------------------------------------------------------------------

    def map_terms(self, change: Callable[[Term], Term]) -> Query:
        return Query(tuple(tuple(replace(p, terms=tuple(map(change, p.terms))) for p in g) for g in self.groups))

    def weighted(self, weights: dict[str, float]) -> Query:
        """Parts weighed by vocabulary and divided by the least; terms inherit."""

        def worth(t: Term) -> float:
            if t.text in weights:
                return weights[t.text]
            if not t.phrase and " " not in t.text:
                return 1.0
            if t.hyphen is not None:
                return weights.get(t.hyphen, 1.0)
            return min([1.0, *(weights[w] for w in t.text.split() if w in weights)])

        raw = [sum(map(worth, p.terms)) / len(p.terms) for p in self.parts]
        least = min(raw, default=1.0) or 1.0
        scaled = iter(w / least for w in raw)
        return Query(tuple(tuple(_weigh(p, next(scaled)) for p in g) for g in self.groups))

    def boosted(self, keywords: Iterable[str], factor: float = 2.0) -> Query:
        keys = {k.lower() for k in keywords}
        hit = lambda p: any(t.text.lower() in keys or keys & set(t.text.lower().split()) for t in p.terms)
        return Query(tuple(tuple(_weigh(p, p.weight * factor if hit(p) else p.weight / factor) for p in g) for g in self.groups))

    def deduplicated(self) -> Query:
        """Without numbers, single characters, repeated terms, and single-term parts that another part contains."""
        parts = []
        for p in self.parts:
            terms: dict[str, Term] = {}
            for t in p.terms:
                bare = re.sub(r"[()]", "", t.text).strip()
                if len(bare) > 1 and not re.fullmatch(r"[-+.,\d]+", bare):
                    terms.setdefault(bare.lower(), replace(t, text=bare))
            if terms:
                parts.append(replace(p, terms=tuple(terms.values())))
        kept = []
        for i, p in enumerate(parts):
            single = len(p.terms) == 1
            covered = any(
                j != i and any(p.terms[0].text.lower() in t.text.lower() and (p.terms[0].text.lower() != t.text.lower() or j < i) for t in q.terms) for j, q in enumerate(parts)
            )
            if not (single and covered):
                kept.append(p)
        return Query.of(kept)

    def without_stop_words(self) -> Query:
        parts = (replace(p, terms=tuple(t for t in p.terms if t.text.lower() not in STOP_WORDS)) for p in self.parts)
        return Query.of(parts)

    def pruned(self, at_least: float = 1.1) -> Query:
        """Without light parts, if there are more than two."""
        kept = [p for p in self.parts if p.weight >= at_least]
        return Query.of(kept) if len(self.parts) > 2 and kept else self

    def grouped(self, stem: Callable[[str], str] | None = None) -> Query:
        """The conjunctive form: light single words go, verbs are cut to their base, parts that contain one another form groups."""
        parts = list(self.parts)
        if parts and max(p.weight for p in parts) > 1.5:
            parts = [p for p in parts if not (len(p.terms) == 1 and not p.terms[0].phrase and p.weight <= 1.0)]
        parts = [replace(p, terms=tuple(_base(t, stem) for t in p.terms)) for p in parts]
        rest = sorted(parts, key=lambda p: -max(len(t.text.split()) for t in p.terms))
        groups: list[list[Part]] = []
        while rest:
            head = rest[0]
            same = [p for p in rest if p is head or p.contains(head) or head.contains(p)]
            rest = [p for p in rest if p not in same]
            groups.append(sorted(same, key=lambda p: (-p.weight, max(len(t.text.split()) for t in p.terms))))
        groups.sort(key=lambda g: -max(p.weight for p in g))

        def late(g: list[Part]) -> bool:
            p = g[0]
            return len(g) == 1 and ((len(p.terms) > 2 and not any(t.phrase for t in p.terms)) or any((t.tag or "").startswith("V") for t in p.terms))

        return Query(tuple(tuple(g) for g in sorted(groups, key=late)))

    def without_term(self, text: str) -> Query:
        """Every equal term goes, from every part."""
        groups = tuple(tuple(q for p in g if (q := replace(p, terms=tuple(t for t in p.terms if t.text.lower() != text.lower()))).terms) for g in self.groups)
        return Query(tuple(g for g in groups if g))

    def without_last(self) -> Query | None:
        """The query without its last part; None if only one is left."""
        return Query.of(self.parts[:-1]) if len(self.parts) > 1 else None

    def relaxed(self) -> Query | None:
        """One step down the ladder, or None: from the weakest group back, the last term of a part that names no entity; when all do, a term of
        the last part of a group with several."""
        for entity in (False, True):
            for g in range(len(self.groups) - 1, -1, -1):
                group = self.groups[g]
                if entity and (len(group) < 2 or self.n_terms < 2):
                    continue
                for p in (len(group) - 1,) if entity else range(len(group) - 1, -1, -1):
                    if not entity and group[p].is_entity:
                        continue
                    terms = group[p].terms[:-1]
                    parts = (*group[:p], *([replace(group[p], terms=terms)] if terms else []), *group[p + 1 :])
                    return Query(tuple(x for x in (*self.groups[:g], parts, *self.groups[g + 1 :]) if x))
        return None

    def ladder(self) -> Iterator[Query]:
        """The query and all its relaxations that still have a term."""
        rung: Query | None = self
        while rung is not None and rung.n_terms:
            yield rung
            rung = rung.relaxed()

    # Compilation -------------------------------------------------------------------------------------------------

    def predicate(self, text: Column, connective: str = "AND") -> Column:
        """Whether a document matches: AND (or OR) of parts, OR inside a part."""
        whole = None
        for p in self.parts:
            any_term = None
            for t in p.terms:
                one = matches(text, t.text)
                any_term = one if any_term is None else (any_term & one if p.inner == "AND" else any_term | one)
            whole = any_term if whole is None else (whole & any_term if connective == "AND" else whole | any_term)
        return F.lit(False) if whole is None else F.coalesce(whole, F.lit(False))

    def score(self, text: Column) -> Column:
        """Sum of the weights of the terms that match, once each."""
        total = F.lit(0.0)
        for p in self.parts:
            for t in p.terms:
                total = total + F.when(matches(text, t.text), float(t.weight)).otherwise(0.0)
        return total


def _weigh(p: Part, weight: float) -> Part:
    return replace(p, weight=weight, terms=tuple(replace(t, weight=weight) for t in p.terms))


def _base(t: Term, stem: Callable[[str], str] | None) -> Term:
    if not (t.tag or "").startswith("V"):
        return t
    base = stem(t.text) if stem else t.text
    return replace(t, text=base[:-1] if base == t.text and len(base) > 5 and base.endswith("ed") else base)


def matches(text: Column, term: str) -> Column:
    """Whether lower-cased ``text`` has the term as whole words; a trailing ``*`` asks for a prefix."""
    words = re.findall(r"[^\W_]+", term.lower())
    if not words:
        return F.lit(False)
    pattern = r"[^\p{L}\p{Nd}]+".join(words)
    end = "" if term.endswith("*") else r"(?![\p{L}\p{Nd}])"
    return text.rlike(rf"(?<![\p{{L}}\p{{Nd}}]){pattern}{end}")


_PIECE = re.compile(r'\s*(?:(\()|(\))|(AND|OR)\b|"([^"]*)"|([^\s()"^]+))(?:\^([\d.]+))?')


def parse_query(text: str) -> Query:
    """Reads what :meth:`Query.rendered` writes: parts in brackets, phrases in quotes, weights behind ``^``."""
    parts, terms, inner, depth = [], [], "OR", 0
    for bra, ket, word, quoted, bare, weight in _PIECE.findall(text):
        if bra:
            terms, inner, depth = [], "OR", 1
        elif ket:
            parts.append(Part(tuple(terms), max((t.weight for t in terms), default=1.0), inner))
            depth = 0
        elif word:
            inner = word if depth else inner
        else:
            t = Term(quoted or bare, bool(quoted), weight=float(weight or 1))
            if depth:
                terms.append(t)
            else:
                parts.append(Part((t,), t.weight))
    return Query.of(parts)


def prefix_syntax(query: Query) -> str:
    """The older rendering: ``term*[All Fields]`` for single words that are long enough to be cut."""

    def one(t: Term) -> str:
        bare = re.sub(r"^(?:most|main)\s+|'s$", "", t.text)
        return f'"{bare}"[All Fields]' if t.phrase or " " in bare else f"{bare}*[All Fields]" if len(bare) > 5 else f"{bare}[All Fields]"

    return " AND ".join("(" + " OR ".join(map(one, p.terms)) + ")" if len(p.terms) > 1 else one(p.terms[0]) for p in query.parts)


def keyword_query(words: list[str], labels: list[int], lemma: Callable[[str], str] | None = None, weights: dict[str, float] | None = None, by_rank: bool = False) -> Query:
    """One part for each selected word (label > 0), an alternative for its base form or plural; in rank order if asked. Hyphenated words are phrases."""
    chosen = [(k, w, label) for k, (w, label) in enumerate(zip(words, labels, strict=True)) if label > 0]
    if by_rank:
        chosen.sort(key=lambda c: (-c[2], c[0]))
    parts = []
    for _, w, _ in chosen:
        if "-" in w:
            terms = [Term(w.replace("-", " "), True, hyphen=w)]
        else:
            base = lemma(w) if lemma else w
            terms = [Term(w)] + ([Term(base)] if base != w else [Term(plural(w))] if w.islower() and not w.endswith("s") else [])
        parts.append(Part(tuple(terms)))
    query = Query.of(parts).without_stop_words()
    return query.weighted(weights) if weights else query


def plural(noun: str) -> str:
    if re.search(r"(s|x|z|ch|sh)$", noun):
        return noun + "es"
    return noun[:-1] + "ies" if re.search(r"[^aeiou]y$", noun) else noun + "s"
