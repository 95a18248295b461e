import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quaero.llm import decontaminate as D
from quaero.llm import edit_join as E
from quaero.llm import mixing as M
from quaero.llm import ring_shards as S
from quaero.llm import rule_lists as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEARCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Sharding


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    got = S.shard_documents(df, 8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == df.count()
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    again = {(r.doc_id, r.text_crc32, r["size"]): r.shard for r in S.shard_documents(df.repartition(3), 8).collect()}
    assert len(again) < len(got) or again == {(r.doc_id, r.text_crc32, r["size"]): r.shard for r in got}


def test_shards_empty(empty):
    assert S.shard_documents(empty).collect() == []


def test_bounded_loads():
    order = S.preferences(8)
    assert len(order) == 1 << S.SLOT_BITS and all(sorted(o) == list(range(8)) for o in order[::97])
    counts = {0: 1000, 5: 3, 9000: 7}
    runs = S.allocate(counts, order, [127, 127, 126, 126, 126, 126, 126, 126])
    assert sum(r[2] - r[1] for r in runs) == 1010
    load = Counter()
    for _, a, z, shard, base in runs:
        assert load[shard] == base
        load[shard] += z - a


def test_growth_moves_little(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r.doc_id: r.shard for r in S.shard_documents(df, 8, capacity_slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in S.shard_documents(df, 9, capacity_slack=0.25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)


# Mixing


def targets(size, cap=3):
    names = sorted((n for n in size if n is not None), key=lambda n: n.encode()) + ([None] if None in size else [])
    weight, full = {s: k % 3 + 1 for k, s in enumerate(names)}, set()
    total = sum(size.values())
    while True:
        rest = total - sum(cap * size[s] for s in full)
        below = sum(weight[s] for s in names if s not in full)
        target = {s: cap * size[s] if s in full else rest * weight[s] / below for s in names}
        over = {s for s in names if s not in full and target[s] > cap * size[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixture(which, request):
    df = request.getfixturevalue(which)
    got = M.mix(df).collect()
    size = Counter()
    for r in df.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
    want = targets(size)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == df.count() and all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in want)
    assert Counter(tuple(r) for r in M.mix(df.repartition(2)).collect()) == Counter(tuple(r) for r in got)


def test_small_sources_stop_at_three_times(spark):
    rows = [(i, "w " * 100, "big") for i in range(20)] + [(100, "a b", "tiny"), (101, "c", "tiny"), (102, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in M.mix(df).collect()}
    assert got[100].taken == 6 and got[101].taken == 3 and got[102].target == 0


def test_materialised(docs):
    taken = {r.doc_id: (r["size"], r.taken) for r in M.mix(docs).collect()}
    out = defaultdict(list)
    for r in M.materialise(docs).collect():
        out[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert M.materialise(docs).schema == docs.schema
    for i, (size, n) in taken.items():
        words = [len(WORD.findall(r.text or "")) for r in out[i]]
        assert sum(words) == n and (size or len(words) == 1)
        assert all((r.text or "") == (texts[i] or "") or (texts[i].strip().startswith(r.text)) for r in out[i])


def test_mixture_empty(empty):
    assert M.mix(empty).collect() == [] and M.materialise(empty).collect() == []


# Decontamination


def brute_contamination(rows, items):
    index = defaultdict(set)
    for item, text in items:
        w = SEARCH.findall((text or "").translate(LOWER))
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            index[tuple(w[s : s + k])].add("" if item is None else str(item))
    out = []
    for doc_id, text in rows:
        w = SEARCH.findall((text or "").translate(LOWER))
        mark, found = [0] * len(w), set()
        for k in {len(x) for x in index}:
            for s in range(len(w) - k + 1):
                if hit := index.get(tuple(w[s : s + k])):
                    found |= hit
                    mark[s : s + k] = [1] * k
        n = sum(mark)
        out.append((doc_id, len(w), n, sorted(found), n > 0 and 20 * n >= len(w)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_contamination(spark, which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    texts = [t for _, t in rows if t and len(t) > 150][:6]
    items = [(k, " ".join(t.split()[3:25]).translate(str.maketrans("abcdeg", "ABCDEG"))) for k, t in enumerate(texts)]
    items += [(90, "one two"), (91, ""), (92, None), (93, "never seen words of any kind"), (None, items[0][1]), (94, "x " * 20), (95, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.contamination(df, bench).collect()]
    want = brute_contamination(rows, items)
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == want
    assert any(r[2] for r in want)
    assert D.clean(df, bench).count() == sum(not r[4] for r in want) and D.clean(df, bench).columns == df.columns


def test_contamination_without_rows(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in D.contamination(docs, bench).collect())
    assert D.contamination(empty, bench).collect() == []


def test_contamination_without_broadcasts(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WORDS", 0)
    items = [(1, " ".join(rows[5][1].split()[:20]))]
    got = D.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(r.n_hit for r in got) == sum(r[2] for r in brute_contamination([r[:2] for r in rows], items)) > 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x x b c"), (2, "a x x x x x b c"), (3, "c b a")], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end) for r in D.proximity_matches(df, ["a", "b", "c"], 5).collect())
    assert got == [(1, 0, 4), (3, 0, 2)]
    assert D.proximity_matches(df, ["a", "zzz"], 5).collect() == []


# Rules


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_statistics(which, request):
    df = request.getfixturevalue(which)

    def brute(doc_id, text):
        t = text or ""
        w = WORD.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n, mark = Counter(tri), [0] * len(w)
        for k, x in enumerate(tri):
            if n[x] > 1:
                mark[k : k + 3] = [1] * 3
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return (doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(mark))

    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.text_statistics(df).collect()]
    assert Counter(got) == Counter(brute(r.doc_id, r.text) for r in df.collect())


def test_rules_are_learned(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(80)), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(f"w{(i * 5 + k * k) % 997}###" for k in range(80)), 0) for i in range(60)]
    loud = [(2000 + i, " ".join(f"WORD{(i * 3 + k * k) % 997}!!" for k in range(80)), 0) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in good + bad + loud], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in good + bad + loud if r[0] % 2] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = R.fit(df, labels)
    kept = {r.doc_id: r.kept for r in R.judge(df, rules).collect()}
    assert rules and all(kept[r[0]] == bool(r[2]) for r in good + bad + loud)
    assert sorted(r.doc_id for r in R.accepted(df, rules).collect()) == [r[0] for r in good]
    assert R.fit(df, labels) == rules


def test_rules_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert R.fit(docs, none) == [] and R.judge(empty, []).collect() == []
    assert all(r.kept == (not r.base_failed) for r in R.judge(docs, []).collect())
    assert R.accepted(docs, []).columns == docs.columns


# Lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(17, 40))) for _ in range(14)] + ["short", "shorx", "  "]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
            lines.append("".join(line))
        texts.append("\n".join(lines))
    rows = [*enumerate(texts), (98, None), (99, "")]
    places = [(d, n, line) for d, t in rows if t is not None for n, line in enumerate(t.split("\n")) if WORD.search(line)]
    first: dict = {}
    for d, n, line in places:
        first.setdefault(line, (d, n))
    near = {line for line, at in first.items() if any(first[o] < at and min(len(o), len(line)) >= 16 and abs(len(o) - len(line)) <= 2 and distance(o, line) <= 2 for o in first if o != line)}
    want = defaultdict(list)
    for d, n, line in places:
        if first[line] != (d, n) or line in near:
            want[d].append(n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in E.removed_lines(df).collect()}
    assert {d: list(r.removed) for d, r in got.items()} == {d: want[d] for d, _ in rows}
    assert near and sum(r.n_near for r in got.values()) == len(near)
    assert sum(r.n_lines for r in got.values()) == len(places)


def test_lines_of_odd_rows(odd, empty):
    got = E.removed_lines(odd).collect()
    assert len(got) == len({r.doc_id for r in odd.collect()}) and E.removed_lines(empty).collect() == []


def test_lines_of_shared_ids(spark, odd):
    """Rows of one id, or of none, are numbered together in order of their text."""
    same = "the very first line of this\nand another clean line here"
    more = [(None, same), (None, same), (None, "quite unlike anything else\nand another clean line herf"), (3000, same), (3000, "zz entirely different words\nsecond unlike all the rest"), (3000, same)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + more
    by_id: dict = defaultdict(list)
    for d, t in rows:
        by_id[d] += [] if t is None else [t]
    places = [((d is None, d or 0), n, line) for d in by_id for n, line in enumerate(line for t in sorted(by_id[d], key=str.encode) for line in t.split("\n")) if WORD.search(line)]
    first: dict = {}
    for d, n, line in sorted(places):
        first.setdefault(line, (d, n))
    near = {line for line, at in first.items() if any(first[o] < at and min(len(o), len(line)) >= 16 and abs(len(o) - len(line)) <= 2 and distance(o, line) <= 2 for o in first if o != line)}
    want, copies = defaultdict(list), defaultdict(int)
    for d, n, line in sorted(places):
        copies[d] += first[line] != (d, n)
        if first[line] != (d, n) or line in near:
            want[d].append(n)
    got = {(r.doc_id is None, r.doc_id or 0): r for r in E.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near and len(got) == len(by_id)
    assert {d: (list(r.removed), r.n_copies) for d, r in got.items()} == {d: (want[d], copies[d]) for d in got}


def test_hash_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_lines_of_a_template(spark, monkeypatch):
    """Very many lines that share segments are told apart by further segments: no near pair is lost, with insertions and deletions between them."""
    import random

    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz é"
    base = "".join(rng.choice(letters) for _ in range(60))
    lines = set()
    while len(lines) < 160:
        line = list(rng.choice(sorted(lines)) if lines and rng.random() < 0.3 else base)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(line) + 1)
            line[at : at + rng.randint(0, 1)] = rng.choice(["", *letters])
        lines.add("".join(line))
    lines |= {"ab" * 12, "ab" * 11 + "a", "ba" * 12, "ab" * 13}
    chosen = sorted(lines)
    want = {(x, y) for i, x in enumerate(chosen) for y in chosen[i + 1 :] if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2}
    df = spark.createDataFrame([(i, line) for i, line in enumerate(chosen)], "id long, line string")
    monkeypatch.setattr(E, "MANY", 8)
    met, real = [], E._meet
    monkeypatch.setattr(E, "_meet", lambda *a: met.append(real(*a)) or met[-1])
    got = {(chosen[r.a], chosen[r.z]) for r in E.near_pairs(df).collect()}
    assert want and got == want
    assert len(met) == 1 + E.LEVELS and not met[-2].where("z is null").isEmpty()


def test_cuts_are_made_once_for_each_level(spark, monkeypatch):
    """The cuts of lines under a frequent segment are read several times and made once: what a level meets comes from stored rows."""
    lines = [("x" * 20) + f"{i:03d}" + ("y" * 20) + f"{i * 7 % 100:02d}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    monkeypatch.setattr(E, "MANY", 8)
    deeper, real = [], E._meet
    met = []

    def meet(index, asks, *more):
        deeper.append(index._jdf.queryExecution().analyzed().toString())
        met.append(real(index, asks, *more))
        return met[-1]

    monkeypatch.setattr(E, "_meet", meet)
    got = {(r.a, r.z) for r in E.near_pairs(df).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if distance(lines[i], lines[j]) <= 2}
    assert len(deeper) > 1 and not any("Generate" in plan for plan in deeper)
    assert all({(r.a, r.z) for r in m.where("z is not null").collect()} <= got for m in met[1:])  # only near lines meet where many share a key


def test_lines_of_a_segment_are_compared_before_they_are_cut_on(spark, monkeypatch):
    """Lines under a frequent segment meet by what they have beside it; further cuts, several rows for each line, are made only where these are very many."""
    import random

    rng = random.Random(9)
    lines = ["a common head of all these lines, " + "".join(rng.choice("bcdefgh") for _ in range(60)) for _ in range(22)]
    lines += [lines[0][:-1] + "z", lines[1][:50] + "y" + lines[1][50:], lines[2][:60] + lines[2][62:]]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    monkeypatch.setattr(E, "MANY", 16)
    wanted, real, met, meet = [], E._at_places, [], E._meet
    monkeypatch.setattr(E, "_at_places", lambda rows, places, edits, only=None: wanted.append(only is not None) or real(rows, places, edits, only))
    monkeypatch.setattr(E, "_meet", lambda *a: met.append(meet(*a)) or met[-1])
    got = {(r.a, r.z) for r in E.near_pairs(df).collect()}
    assert got == {(i, j) for i in range(25) for j in range(i + 1, 25) if distance(lines[i], lines[j]) <= 2} and len(got) == 3
    assert len(met) == 2 and not met[0].where("z is null").isEmpty() and not any(wanted)


def test_keys_of_lines_are_one_short_expression(spark):
    """All look-ups of a line share one expression, and words of map bits are read as numbers."""
    rows = spark.createDataFrame([(1, 20, b"\0" * 80)], "id long, n int, raw binary")
    found = E._at_places(rows, E._places(2), 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") <= 2
    assert found.where("cut_own").select("start", "size").orderBy("start").collect() == [(1, 6), (7, 7), (14, 7)]
