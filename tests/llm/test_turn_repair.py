"""Conversation repair against a plain search over all edits, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quaero.llm import turn_repair
from quaero.llm.turn_repair import Turn

ROWS = "conv_id long, turn long, role string, text string, key string, place int, block string, copies int"
_GRAMMAR = re.compile(r"(s?(ua)+)?")


def _every_edit(rows, most):
    """(cost, audit, repaired) of every sequence of edits with ``most`` insertions at most that ends in the grammar. A row is (role, text, fault)."""
    found = []

    def go(i, cost, audit, out, inserted):
        if i == len(rows) and _GRAMMAR.fullmatch("".join(r[:1] for r, _ in out)):
            found.append((cost, audit, out))
        if inserted < most:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (role, "")], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", out, inserted)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                go(i + 1, cost + more, audit + "K", [*out, (role, text)], inserted)
                for other in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", [*out, (other, text)], inserted)

    go(0, 0, "", [], 0)
    return found


def _faults(rows):
    """Rows (turn, role, text) in order with their first faults, counts of faults, gaps and illegal neighbours."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    return out, [gaps, *(sum(f == x for _, _, f in out) for x in ("blank", "duplicate", "truncated")), illegal]


def _row_by_row(rows):
    """Cheapest (cost, audit, repaired) with one state and one row at a time; no queue."""
    follow = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "", [])}

    def inserted(best):
        for _ in range(2):
            for s, (c, e, out) in list(best.items()):
                for r, role in (("u", "user"), ("a", "assistant")):
                    if s in follow[r]:
                        new = (c + 5, e + "I", [*out, (role, "")])
                        best[follow[r][s]] = min(best.get(follow[r][s], new), new)
        return best

    for role, text, fault in rows:
        then = {}
        for s, (c, e, out) in inserted(best).items():
            more = 5 if fault == "truncated" else 0
            options = [(s, (c + 2, e + "D", out))]
            if fault not in ("blank", "duplicate"):
                if s in follow.get(role[:1], ()):
                    options.append((follow[role[:1]][s], (c + more, e + "K", [*out, (role, text)])))
                options += [(follow[r][s], (c + more + 1, e + "R", [*out, (name, text)])) for r, name in (("u", "user"), ("a", "assistant")) if s in follow[r]]
            for t, new in options:
                then[t] = min(then.get(t, new), new)
        best = then
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _expected(rows, damage=True):
    want = {}
    hurt = _damage(rows) if damage else rows
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, x) for c, t, r, x in hurt if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        judged, counts = _faults(own)
        cost, audit, left = _row_by_row(judged) if own else (0, "", [])
        said = "\n".join(f"{r}:{t}" for r, t in left)
        want[conv] = (*counts, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return want


def _conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and so", "", " \t", None, "Ünïcode… done.", "Yes.", "end. ", "x" * 50 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"]
    rows = []
    for conv in [*range(n), None]:
        turn = 0
        for _ in range(rng.randint(0, most)):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(roles), rng.choice(texts)))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "b", 2) for r in rows], ROWS).repartition(5)


def test_search_finds_what_all_edits_hold():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "x", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 4))]
        cost, audit, out = min(_every_edit(rows, 3), key=lambda x: x[:2])
        found = turn_repair.search([Turn(r[:1], f) for r, _, f in rows], 0, (0, 3), every=False)
        assert list(found.values()) == [(cost, audit)] == [_row_by_row(rows)[:2]]
        left, state = turn_repair.replay([Turn(r[:1], f) for r, _, f in rows], 0, audit)
        assert [(rows[i][0] if role is None else role, "" if i is None else rows[i][1]) for i, role in left] == out
        assert state in (0, 3)


def _digested(spark, rows, most):
    done = turn_repair.repair(_frame(spark, rows), most)
    said = {r.key: r.repaired_sha256 for r in turn_repair.digests(done.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {int(r.key[1:]) if r.key else None: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, said.get(r.key, empty)) for r in done.conversations.collect()}


@pytest.mark.parametrize("most", [1, 3, 256])
def test_blocks_do_not_change_the_repair(spark, most):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in _conversations(5, 30, 14)]
    rows += [(7, 40 + i, ["user", "assistant"][i % 2], f"line {i % 50}.") for i in range(200)] + [(8, 1, "user", "again.")] * 40
    assert _digested(spark, rows, most) == _expected(rows, damage=False)


def test_report_counts_the_damage(spark):
    rows = _conversations(11, 80, 9)
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.report(_frame(spark, rows)).collect()}
    assert got == _expected(rows)


def test_extremes_and_nothing(spark):
    assert turn_repair.report(_frame(spark, []).limit(0)).collect() == []
    low, high = -(2**63), 2**63 - 1
    rows = [(low, low, "user", "a."), (low, high, "assistant", "b."), (high, None, "user", "c" * 300_000 + ".")]
    done = {r.key: r for r in turn_repair.repair(_frame(spark, rows)).conversations.collect()}
    assert (done[f"={low}"].gaps, done[f"={low}"].audit) == (high, "KK")
    assert (done[f"={high}"].gaps, done[f"={high}"].cost, done[f"={high}"].audit) == (0, 2, "D")
