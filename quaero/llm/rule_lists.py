"""Quality rules: text statistics, and a decision list learned from labelled statistics.

The statistics are array and string expressions over one row, so no text leaves its task. The learner is sequential
covering: each rule grows by the threshold condition with the most information gain on one part of the labelled rows, loses
its last conditions while that raises its worth on the other part, and is kept only where it is nearly always right. The list
is emitted as one ordered Spark ``CASE`` expression.

Defined results: null text counts as empty and has no words; without labelled rows, or with one class only, the list is empty
and says keep; labels with a null id or grade are left out, and of several grades of one document the lowest holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import WS, WS_CHARS, split_words

#: Statistics per document that the conditions of a learned rule may use.
RATIOS = {
    "mean_word": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "bangs_per_word": "n_bangs / n_words",
    "distinct_share": "n_distinct / n_words",
    "n_words": "n_words",
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column, span: int) -> Column:
    """How many positions are covered by windows (hashes by start) that occur twice or more."""

    def twice(pairs: Column) -> Column:
        same = lambda p, k: F.get(pairs, k)["h"].eqNullSafe(p["h"])
        marked = F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    starts = _let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-span).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(span), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def text_statistics(docs: DataFrame, span: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the columns ``keep`` with the counts that rules are made of, one row for each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    parts = docs.select(
        "doc_id",
        *keep,
        text.alias("text"),
        split_words(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(WS_CHARS))) > 0).alias("lines"),
    )
    hashes = F.transform(
        F.when(F.size("words") >= span, F.sequence(F.lit(0), F.size("words") - span)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(span))),
    )
    repeated = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, span)))
    count = lambda x: F.regexp_count("text", F.lit(x)).cast("long")
    counted = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count("[A-Z]").alias("n_upper"),
        count("!").alias("n_bangs"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    # A generator, since the optimizer would copy these expressions into every filter above a projection.
    return parts.select("doc_id", *keep, F.inline(F.array(counted)))


def ratio(name: str) -> Column:
    """A statistic that a rule compares; 0 where its denominator is."""
    above, _, below = RATIOS[name].partition(" / ")
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(0.0) if below else F.col(above).cast("double")


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return ratio(self.statistic) >= self.threshold if self.above else ratio(self.statistic) <= self.threshold

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.statistic] >= self.threshold if self.above else row[self.statistic] <= self.threshold


Rule = tuple[Condition, ...]


def _thresholds(values: list[float], bins: int) -> list[float]:
    ordered = sorted(values)
    return sorted({ordered[min(len(ordered) - 1, k * len(ordered) // bins)] for k in range(bins + 1)})


def _counts(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> tuple[int, int]:
    hit = [bad for row, bad in rows if all(c.holds(row) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows: list[tuple[dict[str, float], bool]], bins: int, most: int) -> Rule:
    rule: Rule = ()
    inside = rows
    while len(rule) < most and any(not bad for _, bad in inside):
        p0, n0 = sum(b for _, b in inside), sum(not b for _, b in inside)
        if not p0:
            break
        base, best = math.log2(p0 / (p0 + n0)), None
        for name in RATIOS:
            for t in _thresholds([row[name] for row, bad in inside if bad], bins):
                for above in (True, False):
                    c = Condition(name, above, t)
                    p, n = _counts((c,), inside)
                    gain = p * (math.log2(p / (p + n)) - base) if p else 0.0
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, c)
        if best is None:
            break
        rule += (_midway(best[1], inside),)
        inside = [(row, bad) for row, bad in inside if best[1].holds(row)]
    return rule


def _midway(c: Condition, rows: list[tuple[dict[str, float], bool]]) -> Condition:
    """The condition with its threshold halfway to the nearest good row that it leaves out."""
    outside = [row[c.statistic] for row, bad in rows if not bad and not c.holds(row)]
    if not outside:
        return c
    near = max(outside) if c.above else min(outside)
    return Condition(c.statistic, c.above, (c.threshold + near) / 2)


def _prune(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> Rule:
    def worth(r: Rule) -> float:
        p, n = _counts(r, rows)
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)))


def learn(rows: list[tuple[dict[str, float], bool]], bins: int = 24, most: int = 4, precision: float = 0.97, least: int = 3, rules: int = 12) -> list[Rule]:
    """An ordered list of rules that reject, from (ratios, is bad) in an order that has nothing to do with either."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    found: list[Rule] = []
    while len(found) < rules and any(bad for _, bad in grow):
        if not (rule := _grow(grow, bins, most)):
            break
        rule = _prune(rule, prune)
        (p, n), (q, m) = _counts(rule, prune), _counts(rule, grow)
        if p + q < least or p + q < precision * (p + q + n + m):
            break
        found.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r[0]) for c in rule)] for part in (grow, prune))
    return found


def as_expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects, and what none matches is kept."""
    verdict = None
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition &= c.column()
        verdict = F.when(condition, False) if verdict is None else verdict.when(condition, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def base_failed(least_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 4000) -> list[Rule]:
    """Learns from the labelled documents that pass the base rules: ``most_rows`` of them at most, those with the least hashes of their id."""
    graded = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = text_statistics(chosen, keep=("quality",)).where(~base_failed()).groupBy("doc_id", "quality").agg(*(F.min(ratio(r)).alias(r) for r in RATIOS)).collect()
    rows.sort(key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF)
    return learn([({k: r[k] for k in RATIOS}, r.quality == 0) for r in rows])


def judge(docs: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of every row with ``base_failed`` and ``kept``."""
    return text_statistics(docs, keep=keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & as_expression(rules))


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that are kept, with all their columns."""
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    kept = judge(packed, rules, keep=("__row",)).where("kept")
    return kept.select(*(F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
