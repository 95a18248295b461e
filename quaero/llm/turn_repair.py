"""Repair of damaged conversations: the cheapest edits that turn a list of turns into ``(system? (user assistant)+)?``.

A node of the implicit edit lattice is (turns read, grammar state). Its edges keep a turn, give it another role, delete it, or insert
an empty turn. Dijkstra's search pops nodes by (cost, audit), where the audit is the string of the edits' initials, and stops at the
first accepting end node that it pops. All paths to a node read the same turns, so one audit is never a proper prefix of another of equal
cost, and extending two audits by the same edits keeps their order: the first pop of a node is its cheapest and ASCII-least path.

A conversation may be as long as the table. Its turns are range-sorted over all tasks and cut into blocks of at most ``BLOCK`` turns. The
search runs in each block from every grammar state that a block can begin in; the blocks of a conversation are then chained by the same
(cost, audit) order, which takes one row a block. Turns repeated exactly are counted before they are moved, and repeats at other
turns are found by a partial aggregate and a salted join, so neither gathers a conversation.

Defined results: turns are ordered by number (null first), then role, then text; null roles and texts are one space; a null id is
a conversation of its own; other columns are ignored; an empty table gives no rows. Numbers beyond 64 bits (the gaps between extreme turn
numbers) stop at the largest long.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import SALTS, WS, WS_CHARS
from quaero.sources.shared import ready_to_checkpoint

#: Turns, and bytes of text, after which a block is closed.
BLOCK, BLOCK_BYTES = 256, 1 << 22

#: Costs of the edits, and what an unfinished turn costs that is not deleted.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5

#: The grammar over role initials: state 0 before all, 1 behind the system turn, 2 behind a user's, 3 behind an assistant's.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ACCEPTS = (0, 3)
#: States that can follow each state.
_REACHED = {0: (0, 1, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (2, 3)}
_SPOKEN = {"u": "user", "a": "assistant"}
_LONG = 2**63 - 1


# One block of turns ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Turn:
    """Initial of the role, fault (``blank``, ``duplicate``, ``truncated`` or empty), and how often the turn stands there."""

    initial: str
    fault: str = ""
    copies: int = 1


def _edges(turn: Turn, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, initials, next state) of the edits that read the turn. Its further copies are duplicates, deleted right behind it: putting an insertion before
    one of them costs the same and is not ASCII-least."""
    more, gone = turn.copies - 1, DELETE * (turn.copies - 1)
    yield DELETE + gone, "D" * (more + 1), state
    if turn.fault in ("blank", "duplicate"):
        return
    worse = gone + (UNFINISHED if turn.fault == "truncated" else 0)
    if state in _NEXT.get(turn.initial, ()):
        yield KEEP + worse, "K" + "D" * more, _NEXT[turn.initial][state]
    for role in _SPOKEN:
        if state in _NEXT[role]:
            yield REROLE + worse, "R" + "D" * more, _NEXT[role][state]


def search(turns: list[Turn], begin: int, ends: tuple[int, ...], every: bool = True) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)} of the cheapest edits from state ``begin``; with ``every`` unset only the first end that is popped."""
    queue, done, found = [(0, "", 0, begin)], set(), {}
    while queue and (len(found) < len(ends) if every else not found):
        cost, audit, at, state = heapq.heappop(queue)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns):
            if state in ends:
                found[state] = cost, audit
        else:
            for more, edits, then in _edges(turns[at], state):
                if (at + 1, then) not in done:
                    heapq.heappush(queue, (cost + more, audit + edits, at + 1, then))
        for role in _SPOKEN:
            if state in _NEXT[role] and (at, _NEXT[role][state]) not in done:
                heapq.heappush(queue, (cost + INSERT, audit + "I", at, _NEXT[role][state]))
    return found


def replay(turns: list[Turn], begin: int, audit: str) -> tuple[list[tuple[int | None, str | None]], int]:
    """What the edits leave, and the end state: for each turn of the result (its index or None if inserted, its new role or None if kept)."""
    left, state, at, place = [], begin, 0, 0
    while place < len(audit):
        edit, place = audit[place], place + 1
        role = "a" if state == 2 else "u"
        if edit == "I":
            left.append((None, _SPOKEN[role]))
            state = _NEXT[role][state]
            continue
        if edit != "D":
            left.append((at, None if edit == "K" else _SPOKEN[role]))
            state = _NEXT[turns[at].initial if edit == "K" else role][state]
        place += turns[at].copies - 1
        at += 1
    return left, state


# Turns in order ----------------------------------------------------------------------------------------------------


def _key(id_column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit(""))


def _judged(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, copies, fault): distinct turns, each with its first fault."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    turns = rows.select(_key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    counted = turns.groupBy("key", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.sha2("text", 256))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = counted.groupBy("key", "role", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = counted.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")).join(spread, ["key", "role", "digest", "salt"], "left")
    end = F.substring(F.rtrim("text", F.lit(WS_CHARS)), -1, 1)
    fault = F.when(~F.col("text").rlike(f"[^{WS}]"), "blank").when(F.coalesce(at > F.col("first"), F.lit(False)), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    return met.select("key", "turn", "role", "text", "copies", fault.alias("fault"))


def _into_blocks(most: int):
    """Adds ``place``, which grows through the whole table, and ``block``, the place of the first turn of the row's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, key, block, n, size = TaskContext.get().partitionId() << 33, None, 0, 0, 0
        for b in batches:
            places = np.arange(place, place + len(b), dtype=np.int64)
            blocks = np.empty(len(b), np.int64)
            for i, (k, length) in enumerate(zip(b["key"].to_pylist(), b["size"].to_numpy(), strict=True)):
                if k != key or n >= most or size >= BLOCK_BYTES:
                    key, block, n, size = k, int(places[i]), 0, 0
                n, size, blocks[i] = n + 1, size + int(length), block
            place += len(b)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(places), pa.array(blocks)], [*b.schema.names[:-1], "place", "block"])

    return run


def in_order(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """(key, turn, role, text, copies, fault, place, block): all turns in order, range-sorted over the tasks, kept in the shared checkpoint folder."""
    ready_to_checkpoint(rows.sparkSession)
    judged = _judged(rows).withColumn("size", F.octet_length("text"))
    dealt = judged.repartitionByRange("key", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("key", "turn", "role", "text")
    return dealt.mapInArrow(_into_blocks(most), "key string, turn long, role string, text string, copies long, fault string, place long, block long").checkpoint()


# Blocks and their chains -------------------------------------------------------------------------------------------

_PATHS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_BLOCKS = pa.schema([
    ("key", pa.string()), ("block", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("low", pa.int64()),
    ("high", pa.int64()), ("turns", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("paths", _PATHS),
])
_BLOCKS_SQL = (
    "key string, block long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, head string, tail string, "
    "paths array<struct<begin: int, end: int, cost: long, audit: string>>"
)
_LEGAL = {"su", "ua", "au"}


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _turns(rows: list[dict]) -> list[Turn]:
    return [Turn(r["initial"], r["fault"], r["copies"]) for r in rows]


def _summary(key: str, block: int, rows: list[dict], whole: bool) -> dict:
    turns = _turns(rows)
    numbers = [r["turn"] for r in rows if r["turn"] is not None]
    count = lambda fault: sum(t.copies if t.fault == fault else 0 for t in turns)
    more = sum(t.copies - 1 for t in turns)
    # Copies that stand behind a turn are duplicates of it, unless they are blank like the turn.
    repeats = sum(t.copies - 1 for t in turns if t.fault in ("", "truncated"))
    illegal = more + sum(a.initial + b.initial not in _LEGAL for a, b in zip(turns, turns[1:], strict=False))
    if whole:
        paths = [{"begin": 0, "end": e, "cost": c, "audit": a} for e, (c, a) in search(turns, 0, _ACCEPTS, every=False).items()]
    else:
        paths = [{"begin": s, "end": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in search(turns, s, _REACHED[s]).items()]
    return {
        "key": key, "block": block, "blank": count("blank"), "duplicate": count("duplicate") + repeats, "truncated": sum(t.fault == "truncated" for t in turns), "illegal": illegal,
        "low": numbers[0] if numbers else None, "high": numbers[-1] if numbers else None, "turns": len(set(numbers)), "head": turns[0].initial, "tail": turns[-1].initial, "paths": paths,
    }


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's counts and cheapest paths. A conversation that begins and ends inside the partition, in one block, is searched once, from the first state to
    the first accepting end."""

    def found() -> Iterator[dict]:
        before, waiting = None, None
        for (key, block), rows in groupby(_stream(batches), lambda r: (r["key"], r["block"])):
            if waiting is not None:
                yield _summary(*waiting, whole=before not in (None, waiting[0]) and key != waiting[0])
                before = waiting[0]
            waiting = (key, block, list(rows))
        if waiting is not None:
            yield _summary(*waiting, whole=False)

    return _in_batches(found(), _BLOCKS)


_CHAINED = pa.schema([
    ("key", pa.string()), ("block", pa.int64()), ("begin", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
])
_CHAINED_SQL = "key string, block long, begin int, audit string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def _chain(key: str, blocks: Iterator[dict]) -> Iterator[dict]:
    """The conversation's row (block null), then one row a block with the edits chosen in it."""
    best: dict[int, tuple[int, str]] = {0: (0, "")}
    steps: list[tuple[int, dict[int, tuple[int, str]]]] = []
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    low = high = tail = None
    turns = 0
    for b in blocks:
        total = {k: n + b[k] for k, n in total.items()}
        total["illegal"] += tail is not None and tail + b["head"] not in _LEGAL
        tail = b["tail"]
        turns += b["turns"] - (high is not None and high == b["low"])
        low, high = b["low"] if low is None else low, b["high"] if b["high"] is not None else high
        then: dict[int, tuple[int, str]] = {}
        via: dict[int, tuple[int, str]] = {}
        for p in b["paths"]:
            if p["begin"] in best:
                cost, audit = best[p["begin"]]
                reached = cost + p["cost"], audit + p["audit"]
                if p["end"] not in then or reached < then[p["end"]]:
                    then[p["end"]], via[p["end"]] = reached, (p["begin"], p["audit"])
        best = then
        steps.append((b["block"], via))
    (cost, audit), state = min((best[s], s) for s in _ACCEPTS if s in best)
    gaps = 0 if low is None else min(high - low + 1 - turns, _LONG)
    yield {"key": key, "block": None, "begin": None, "audit": audit, "cost": cost, "gaps": gaps, **total}
    for block, via in reversed(steps):
        begin, edits = via[state]
        yield {"key": key, "block": block, "begin": begin, "audit": edits}
        state = begin


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_batches((r for key, blocks in groupby(_stream(batches), lambda r: r["key"]) for r in _chain(key, blocks)), _CHAINED)


# Results -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Repaired:
    """``conversations``: (key, gaps, blank, duplicate, truncated, illegal, cost, audit). ``turns``: (key, place, sub, role, text) of what is left, in order by place and sub."""

    conversations: DataFrame
    turns: DataFrame


def _edit(turns: pa.Table, edits: pa.Table) -> pa.Table:
    """The turns of one block after its edits. Inserted turns carry the place of the turn that they stand before, or of the block's last."""
    rows = sorted(turns.to_pylist(), key=lambda r: r["place"])
    chosen = edits.to_pylist()[0]
    left, _ = replay(_turns(rows), chosen["begin"], chosen["audit"])
    out, place = [], rows[0]["place"]
    for sub, (at, role) in enumerate(left):
        place = place if at is None else rows[at]["place"]
        out.append({"key": chosen["key"], "place": place, "sub": sub, "role": rows[at]["role"] if role is None else role, "text": "" if at is None else rows[at]["text"]})
    return pa.Table.from_pylist(out, pa.schema([("key", pa.string()), ("place", pa.int64()), ("sub", pa.int32()), ("role", pa.string()), ("text", pa.string())]))


def repair(rows: DataFrame, most: int = BLOCK) -> Repaired:
    """The cheapest repair of every conversation of (conv_id, turn, role, text); ``most`` turns make a block."""
    ordered = in_order(rows, most)
    light = ordered.select("key", "block", "place", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    blocks = light.mapInArrow(_search_blocks, _BLOCKS_SQL)
    chained = blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_chain_blocks, _CHAINED_SQL).checkpoint()
    conversations = chained.where("block is null").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = chained.where("block is not null").select("block", "key", "begin", "audit")
    texts = ordered.select("block", "place", "role", F.substring("role", 1, 1).alias("initial"), "text", "fault", "copies")
    turns = texts.groupBy("block").cogroup(edits.groupBy("block")).applyInArrow(_edit, "key string, place long, sub int, role string, text string")
    return Repaired(conversations, turns)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[dict]:
        for key, rows in groupby(_stream(batches), lambda r: r["key"]):
            said = hashlib.sha256()
            for i, r in enumerate(rows):
                said.update(f"{chr(10) if i else ''}{r['role']}:{r['text']}".encode())
            yield {"key": key, "repaired_sha256": said.hexdigest()}

    return _in_batches(found(), pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())]))


def digests(turns: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of ``role:text``, newline-joined. A digest reads its conversation in order, so one task streams it; only one batch is held."""
    return turns.repartition("key").sortWithinPartitions("key", "place", "sub").mapInArrow(_digest, "key string, repaired_sha256 string")


# Damage ------------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults by the checksum of ``conv_id:turn``: a twentieth each is dropped, emptied, stripped of its ends of sentences, repeated, or given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    said = hurt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return said.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def report(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of undamaged rows: what the damage did, what its repair costs, and the digest of what is left."""
    ids = conversations.select("conv_id").distinct().withColumn("key", _key("conv_id"))
    done = repair(damaged(conversations))
    joined = ids.join(done.conversations, "key", "left").join(digests(done.turns), "key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
