"""Set-similarity join of documents on word shingles, by prefixes of token combinations.

Tokens (hashed shingles) stand in one global order: those found once in the corpus, then rare ones, then those of unknown
frequency, then frequent ones. Two sets with Jaccard similarity at least t differ in at most m = n - ceil(t n) tokens of a set of n, so
a prefix that m missing tokens cannot empty must share a signature with its partner's. Rare tokens are signatures on their
own. Frequent ones are dealt by hash into classes, about n / 16 of them, and only pairs of one class are signatures;
a class of k tokens withstands k - 1 missing ones, so the prefix is extended until its withstanding exceeds m. For pairs to agree on
the classes, their number depends on the power of two below n, and a document signs for each power that a partner's size may have.

Frequencies come from one token in four, chosen by hash, counted over all documents: a prefix takes less than a fifth of the
tokens, so clean documents stay inside the counted ones, and what is left out is ordered by hash. Signatures only propose. Documents
linked by proposals, with sizes that allow a link, form candidate groups, and a task verifies the pairs of a group by whole sets: those that share a token
of their prefixes (in the group's own order of frequency) and are not connected already. A group beyond the size of a block is dealt
into blocks, each compared in itself; then one document of every component found
is compared with the others', which connects near copies of one text in linear work; only where a group still has several components, their
documents meet in pairs of blocks. Tasks send on spanning forests of links, never all pairs.

Defined results: lower-casing touches A-Z only; a document with fewer words than a shingle is one shingle; one without words, or null,
has the empty set and no links; rows that share an id are one node, whose links are those of all its rows, each with its own count; a
null id is a node of its own, returned as null (as is 2^63-1, which stands for it); equal texts are linked through the smallest id without being compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.buckets import BLOB_SCHEMA, NO_ID, Layout, blob_table, by_target, in_buckets, layout, with_ids
from quaero.llm.common import WS, components, later_copies, likely_among, ready_to_checkpoint, spanning

#: Words hashed at once.
PIECE = 1 << 18
#: A token that more documents have is frequent.
RARE = 24
#: Sets below this size use single tokens only.
SMALL = 64
#: Bytes of text whose signatures are one list: about a sixth of it. A list sends on at most one pair for each document that it has, so fewer lists repeat fewer pairs.
KEY_BYTES = 16 << 20
#: Bytes of tokens (eight each) in one block of a candidate group.
BLOCK_BYTES = 1 << 24

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


_FORWARD = _powers(_P, PIECE * 2)
_BACK = _powers(np.uint64(pow(int(_P), -1, 1 << 64)), PIECE * 2)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, whole words only, a piece of the text at a time."""
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r" and end - at < PIECE * 2 - 1:
            end += 1
        if end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":  # one word longer than a piece
            stop = next((k for k in range(end, len(text)) if text[k] in b" \t\n\x0b\x0c\r"), len(text))
            found += [np.array([hash_long(w) for w in text[at:stop].split()], np.uint64)]
            at = stop
            continue
        found.append(_hash_piece(np.frombuffer(text, np.uint8, end - at, at)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def hash_long(word: bytes) -> int:
    """The hash of one word of any length, equal to what a piece gives."""
    total, power = 0, 1
    for c in word:
        total = (total + (c + 1) * power) % (1 << 64)
        power = power * int(_P) % (1 << 64)
    return int(_mix(np.array([total + len(word) * int(_BACK[1]) & (1 << 64) - 1], np.uint64))[0])


def _hash_piece(data: np.ndarray) -> np.ndarray:
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = turns[::2], turns[1::2]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _FORWARD[: len(data)], dtype=np.uint64)])
    return _mix((sums[end] - sums[start]) * _BACK[start] + (end - start).astype(np.uint64) * _BACK[1])


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes."""
    words = word_hashes(text.translate(_LOWER))
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, np.uint64(min(width, len(words))))
    for k in range(min(width, len(words))):
        h = _mix(h * _P + words[k : k + n])
    return np.unique(h)


def needed(n: int, percent: int) -> int:
    """The least number of tokens of a set of n that a partner must share."""
    return -(-percent * n // 100)


def signatures(tokens: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set; ``rank`` is 0 for tokens found once, 1 rare, 2 unknown, 3 frequent."""
    n = len(tokens)
    order = np.lexsort((tokens, rank))
    tokens, rank = tokens[order], rank[order]
    found = []
    missing = n - needed(n, percent)
    for band in range((needed(n, percent)).bit_length(), (100 * n // percent).bit_length() + 1):
        if (1 << band) <= SMALL:
            end, single = missing + 1, np.ones(n, bool)
        else:
            cls = (tokens >> np.uint64(17)) % np.uint64((1 << band) // 32)
            single = rank < 2
            cover = np.ones(n, np.int64)
            many = np.flatnonzero(~single)
            cover[many[np.unique(cls[many], return_index=True)[1]]] = 0
            end = int(np.searchsorted(np.cumsum(cover), missing + 1)) + 1
            pair = many[many < end]
            pair = pair[np.argsort(cls[pair], kind="stable")]
            lag = 1
            while lag < len(pair):
                a, z = pair[:-lag], pair[lag:]
                same = cls[a] == cls[z]
                if not same.any():
                    break
                found.append(_mix(_mix(tokens[a[same]]) * _P + tokens[z[same]] + np.uint64(band)))
                lag += 1
        found.append(tokens[:end][single[:end] & (rank[:end] > 0)])
    return np.unique(np.concatenate(found))


_TOKEN = np.dtype([("t", "<u4"), ("n", "<u1")])
_SIGN = np.dtype([("s", "<u8"), ("id", "<i8"), ("n", "<u4")])
#: A row's size n (v unused), or a link (n below 0).
_NOTE = np.dtype([("u", "<i8"), ("v", "<i8"), ("n", "<i8")])


def _counted(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(3)) == 0


def _short(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def _texts(docs: pa.Table, notes: pa.Table) -> list[tuple[int, bytes, bool]]:
    """(id, text, is a copy of an earlier text)."""
    copies = {x for x, k in zip(notes["blob"].to_pylist(), notes["bucket"].to_pylist(), strict=True) if k < 0}
    ids, texts, digests = docs["doc_id"].to_pylist(), docs["text"].to_pylist(), docs["digest"].to_pylist()
    return [(i, (t or "").encode(), i.to_bytes(8, "big", signed=True) + (d or b"") in copies) for i, t, d in zip(ids, texts, digests, strict=True)]


def _count_tokens(width: int, plan: Layout):
    """Pass 1: in how many documents of a bucket each counted token is."""

    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        found = [_short(s[_counted(s)]) for _, text, copy in _texts(docs, notes) if not copy for s in (shingle_set(text, width),)]
        if not found:
            return blob_table([])
        t, n = np.unique(np.concatenate(found), return_counts=True)
        table = np.empty(len(t), _TOKEN)
        table["t"], table["n"] = t, np.minimum(n, 255)
        return blob_table([(k, key[0].as_py(), table[i].tobytes()) for k, i in by_target((t % np.uint32(plan.key_buckets)).astype(np.int64))])

    return run


def _repeated_tokens(key: tuple, rows: pa.Table) -> pa.Table:
    """Pass 2: to each bucket, its tokens that two or more documents have, with their number (255: or more)."""
    parts = [np.frombuffer(x, _TOKEN) for x in rows["blob"].to_pylist()]
    every = np.concatenate(parts)
    values, where = np.unique(every["t"], return_inverse=True)
    total = np.minimum(np.bincount(where, every["n"].astype(np.int64)), 255).astype(np.uint8)
    out = []
    for b, part in zip(rows["b"].to_pylist(), parts, strict=True):
        n = total[np.searchsorted(values, part["t"])]
        mine = part[n > 1].copy()
        mine["n"] = n[n > 1]
        if len(mine):
            out.append((key[0].as_py(), b, mine.tobytes()))
    return blob_table(out)


def _size_ranges(percent: int) -> np.ndarray:
    """Least sizes of ranges inside which any two sizes allow a link."""
    least = [1]
    while least[-1] < 1 << 32:
        least.append(100 * least[-1] // percent + 1)
    return np.array(least, np.int64)


def _fold(table: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the documents of one bucket with a common signature and sizes of one range, the smallest and the largest, and links from the others
    to the smallest.

    Signatures' lists connect the same documents as without this: whoever fits one of those left out fits one of those two, as a list is cut by sizes only.
    """
    table = table[np.lexsort((table["id"], table["n"], table["s"]))]
    of = np.searchsorted(least, table["n"], "right")
    turns = np.flatnonzero((table["s"][1:] != table["s"][:-1]) | (of[1:] != of[:-1])) + 1
    first, last = np.concatenate([[0], turns]), np.concatenate([turns, [len(table)]]) - 1
    stays = np.zeros(len(table), bool)
    stays[first] = stays[last] = True
    head = np.repeat(table["id"][first], last - first + 1)
    return table[stays], spanning(np.unique(np.stack([table["id"], head], 1)[~stays], axis=0))


def _sign(width: int, percent: int, plan: Layout):
    """Pass 3: signatures by key, folded inside the bucket, and the size of every row's set."""
    least = _size_ranges(percent)

    def run(key: tuple, docs: pa.Table, notes: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, _TOKEN), *(np.frombuffer(x, _TOKEN) for x, k in zip(notes["blob"].to_pylist(), notes["bucket"].to_pylist(), strict=True) if k >= 0)])
        known = known[np.argsort(known["t"])]
        signs, sizes = [], []
        for i, text, copy in _texts(docs, notes):
            tokens = shingle_set(text, width)
            sizes.append((i, 0, len(tokens)))
            if copy or not len(tokens):
                continue
            rank = np.full(len(tokens), 2, np.uint8)
            counted = _counted(tokens)
            rank[counted] = 0
            if len(known):
                short = _short(tokens[counted])
                at = np.minimum(np.searchsorted(known["t"], short), len(known) - 1)
                rank[counted] = np.where(known["t"][at] == short, np.where(known["n"][at] > RARE, 3, 1), 0)
            s = signatures(tokens, rank, percent)
            table = np.empty(len(s), _SIGN)
            table["s"], table["id"], table["n"] = s, i, len(tokens)
            signs.append(table)
        b = key[0].as_py()
        out = [(-1 - b % plan.key_buckets, b, np.array(sizes, _NOTE).tobytes())]
        if signs:
            table, links = _fold(np.concatenate(signs), least)
            out.append((-1 - b % plan.key_buckets, b, np.array([(u, v, -1) for u, v in links.tolist()], _NOTE).tobytes()))
            out += [(k, b, table[i].tobytes()) for k, i in by_target((table["s"] % np.uint64(plan.key_buckets)).astype(np.int64))]
        return blob_table(out)

    return run


def _propose(percent: int):
    """Pass 4: (u, v) that connect documents with a common signature and sizes that allow a link; (u, null, n) for sizes. Links found in pass 3 are handed on.

    In order of size, documents between two that could be linked could be linked to their neighbours too, so a signature's list
    is cut where neighbours are too unlike.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            notes = np.concatenate([np.frombuffer(x, _NOTE) for x in rows["blob"].to_pylist()])
            column = lambda name, absent: pa.array(np.ascontiguousarray(notes[name]), pa.int64(), mask=absent)
            return pa.table({"u": column("u", None), "v": column("v", notes["n"] >= 0), "n": column("n", notes["n"] < 0)})
        table = np.concatenate([np.frombuffer(x, _SIGN) for x in rows["blob"].to_pylist()])
        table = table[np.lexsort((table["id"], table["n"], table["s"]))]
        n = table["n"].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (table["s"][1:] != table["s"][:-1]) | (100 * n[:-1] < percent * n[1:])]))
        head = np.repeat(table["id"][first], np.diff(np.append(first, len(table))))
        pairs = spanning(np.unique(np.stack([table["id"], head], 1)[table["id"] != head], axis=0).reshape(-1, 2))
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1], "n": pa.nulls(len(pairs), pa.int64())})

    return run


def forest(sets: list[np.ndarray], percent: int, skip: np.ndarray | None = None, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the (non-empty) sets just as all pairs with enough similarity would. ``skip``: blocks, inside which all pairs are compared
    already; ``joined``: components that are known.

    Tokens are ordered by their number in these sets, rarest first; two similar sets share a token of their prefixes, so a set is compared
    with smaller ones that a list of prefix tokens gives and that are not connected with it yet.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    root = np.arange(n) if joined is None else np.unique(joined, return_inverse=True)[1]
    inside: dict[int, list[int]] = {}
    for k, r in enumerate(root.tolist()):
        inside.setdefault(r, []).append(k)
    tokens, dense, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_number = np.empty(len(tokens), np.int64)
    by_number[np.argsort(often, kind="stable")] = np.arange(len(tokens))
    once = int((often == 1).sum())  # ranks below are tokens of a single set
    ends = np.cumsum(sizes)
    own = [np.sort(by_number[dense[ends[i] - sizes[i] : ends[i]]]) for i in range(n)]
    prefix = []
    for s in own:
        head = s[: len(s) - needed(len(s), percent) + 1]
        prefix.append(head[np.searchsorted(head, once) :])
    room = np.bincount(np.concatenate(prefix), minlength=len(tokens)) if n else np.zeros(0, np.int64)
    begin = np.cumsum(room) - room
    filled = np.zeros(len(tokens), np.int64)
    listed = np.empty(int(room.sum()), np.int64)  # for each token, places in order of those sets that have it in their prefix
    mark = np.zeros(len(tokens), bool)
    links, pivot = [], None

    def similar(i: int, others: np.ndarray) -> np.ndarray:
        common = np.add.reduceat(mark[np.concatenate([own[j] for j in others])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        return others[100 * common >= percent * (sizes[i] + sizes[others] - common)]

    def join(i: int, j: int) -> None:
        links.append((i, j))
        a, z = sorted((int(root[i]), int(root[j])), key=lambda r: len(inside[r]))
        root[inside[a]] = z
        inside[z] += inside.pop(a)

    for k in range(n):
        i = int(order[k])
        mark[own[i]] = True
        if pivot is not None and root[pivot] != root[i] and (skip is None or skip[pivot] != skip[i]) and 100 * sizes[pivot] >= percent * sizes[i] and len(similar(i, np.array([pivot]))):
            join(i, pivot)
        mine, many = prefix[i], filled[prefix[i]]
        if many.any():
            at = np.repeat(begin[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            met = np.unique(listed[at])
            other = order[met]
            other = other[(100 * sizes[other] >= percent * sizes[i]) & (root[other] != root[i])]
            if skip is not None:
                other = other[skip[other] != skip[i]]
            if len(other):
                for j in similar(i, other).tolist():
                    pivot = j
                    if root[i] != root[j]:
                        join(i, j)
        pivot = i if pivot is None else pivot
        listed[begin[mine] + many] = k
        filled[mine] += 1
        mark[own[i]] = False
    return links


def _compare(width: int, percent: int):
    """Pass 5: the links of one block of a candidate group, or between two blocks."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.not_equal(pc.fill_null(pc.utf8_trim(rows["text"], " \t\n\x0b\x0c\r"), ""), ""))
        ids = rows["doc_id"].to_pylist()
        if not ids:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        sets = [shingle_set((t or "").encode(), width) for t in rows["text"].to_pylist()]
        across = key[1].as_py() != key[2].as_py()
        found = forest(sets, percent, rows["block"].to_numpy() if across else None, rows["comp"].to_numpy() if across else None)
        return pa.table({"u": pa.array([ids[i] for i, _ in found], pa.int64()), "v": pa.array([ids[j] for _, j in found], pa.int64())})

    return run


def _links(members: DataFrame, width: int, percent: int, pairs: bool) -> DataFrame:
    """(u, v) links inside each block of (label, block, blocks, comp, doc_id, text), or of each pair of blocks of a label."""
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != F.col("block"))) if pairs else F.col("block")
    dealt = members.withColumn("other", other)
    keyed = dealt.select("label", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("z"), "block", "comp", "doc_id", "text")
    return keyed.groupBy("label", "a", "z").applyInArrow(_compare(width, percent), "u long, v long")


def _in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``members`` (label, comp, doc_id, text) with the number of blocks of their label, from (label, size), and their own."""
    weight = sizes.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("long").alias("blocks"))
    placed = members.join(weight, "label").withColumn("block", F.pmod(F.xxhash64("doc_id", "label"), F.col("blocks")))
    return placed.select("label", "block", "blocks", "comp", "doc_id", "text")


def _verified(members: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): links that connect the members (label, doc_id, text) of each candidate group as all pairs with enough similarity would."""
    dealt = _in_blocks(members.withColumn("comp", F.col("doc_id")), sizes)
    if sizes.groupBy("label").agg(F.sum("size").alias("size")).where(F.col("size") > BLOCK_BYTES).isEmpty():
        return _links(dealt, width, percent, pairs=False)
    dealt = dealt.checkpoint()
    links = _links(dealt, width, percent, pairs=False).checkpoint()
    return links.union(_across(dealt.where("blocks > 1"), links, width, percent))


def _across(large: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the blocks of large groups: between one document of each component, then between all documents of what is still apart."""
    named = lambda found: large.drop("comp").join(components(found, "u", "v").select(F.col("node").alias("doc_id"), F.col("root").alias("comp")), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    heads = named(links).where("doc_id = comp").select("label", "comp", "doc_id", "text")
    both = _in_blocks(heads, heads.select("label", F.octet_length("text").alias("size"))).checkpoint()
    more = _links(both, width, percent, pairs=False).union(_links(both.where("blocks > 1"), width, percent, pairs=True)).checkpoint()
    placed = named(links.union(more))
    apart = placed.groupBy("label").agg((F.min("comp") != F.max("comp")).alias("apart")).where("apart").select("label")
    rest = placed.join(apart, "label", "left_semi")
    return more.union(_links(rest.select("label", "block", "blocks", "comp", "doc_id", "text"), width, percent, pairs=True))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the smallest id reachable over links of at least ``percent`` similarity."""
    ready_to_checkpoint(docs.sparkSession)
    plan = layout(docs, KEY_BYTES)
    ids = with_ids(docs)
    copies = later_copies(ids.where(F.col("text").rlike(f"[^{WS}]"))).checkpoint()
    texts = in_buckets(ids, plan).withColumn("digest", F.unhex(F.sha2("text", 256)))
    notes = in_buckets(copies, plan).select(
        F.lit(-1).cast("long").alias("bucket"), "b", F.concat(F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), F.unhex("digest")).alias("blob")
    )
    together = lambda more: texts.groupBy("b").cogroup(more.groupBy("b"))
    counts = together(notes).applyInArrow(_count_tokens(width, plan), BLOB_SCHEMA)
    known = counts.groupBy("bucket").applyInArrow(_repeated_tokens, BLOB_SCHEMA)
    signed = together(notes.union(known)).applyInArrow(_sign(width, percent, plan), BLOB_SCHEMA)
    proposed = signed.groupBy("bucket").applyInArrow(_propose(percent), "u long, v long, n long").checkpoint()
    sizes = proposed.where("v is null").select(F.col("u").alias("doc_id"), F.col("n").alias("n_shingles"))

    groups = components(proposed.where("v is not null"), "u", "v").select(F.col("node").alias("doc_id"), F.col("root").alias("label"))
    candidates = likely_among(ids, F.col("doc_id"), groups.select("doc_id")).join(groups, "doc_id")
    # A copy is one row's text: other rows of its id are compared.
    members = candidates.withColumn("digest", F.sha2("text", 256)).join(copies.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").select("label", "doc_id", "text")
    weights = sizes.join(groups, "doc_id").select("label", (8 * F.col("n_shingles")).alias("size")).checkpoint()
    links = _verified(members, weights, width, percent)

    roots = components(links.union(copies.select("doc_id", "first_id")), "u", "v")
    joined = sizes.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    bare = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return joined.select(bare("doc_id"), "n_shingles", bare("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest id, null last (of several texts of that id, the one of the least hash).

    Each distinct (id, text) is a node of its own here, so different texts under one id, or under none, are judged apart.
    """
    rows = docs.withColumn("__node", F.xxhash64("doc_id", F.sha2("text", 256)))
    groups = near_duplicates(rows.select(F.col("__node").alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias("__node"), "component_id").distinct()
    ids = rows.select("__node", F.col("doc_id").cast("long").alias("id")).distinct()
    staying = ids.join(groups, "__node").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "__node")).alias("s")).select("s.__node")
    return rows.join(staying, "__node", "left_semi").dropDuplicates(["__node"]).drop("__node")
