"""From a table of questions to their ranked answers, in one plan for all of them.

Questions are understood on the executors: words, weights and entity types come by joins, and each question becomes an :class:`Ask` with its whole relaxation ladder. All terms of
all asks are one automaton, so documents are split into words once; what is kept of a document is the set of terms that it has. From these sets every rung of every
ladder is counted in one aggregate, the rung to run is chosen, and each ask's best documents are taken. Only those documents are split into sentences, once, however many
questions chose them. Their sentences are compared with question words block by block: a block's distinct words meet their vectors in one join, and
cosines are products of matrices that never leave the task. Then the router deals each question to definitions, typed answers or similarity.

What is broadcast is bounded by ``QUESTIONS_AT_ONCE``: more questions are answered in blocks of that many.

Defined results: a null or empty question has no answers; a null document text has no sentences; of questions that share an id each gets answers as if they
were one list; an empty table of either kind gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quaero.functions import text as T
from quaero.operators import answers as A
from quaero.operators import entities as E
from quaero.operators import phrases as P
from quaero.operators import questions as Q
from quaero.operators import scorers as S
from quaero.operators import search
from quaero.operators.best import Best
from quaero.operators.vocabulary import in_parts, lower_words
from quaero.plans.query import Query, keyword_query
from quaero.sources.shared import ready_to_checkpoint

#: Questions in one block, bytes of sentences in one block of documents, and parts into which one ask's documents are dealt.
QUESTIONS_AT_ONCE, BLOCK_BYTES, PARTS = 1000, 1 << 22, 32
#: Documents of questions up to which their ids are sent to all tasks instead of shuffling the texts.
MOST_BROADCAST = 1 << 20
#: For all sentences: most words of questions in one pass, most frequent terms and numbers of their vectors (64 MB as floats) that are sent to all tasks, and words that are compared together.
WORDS_AT_ONCE, FREQUENT, NUMBERS, TOGETHER = 256, 1 << 18, 1 << 24, 1 << 13
#: For the best sentences: words of questions in one product of matrices, and bytes of text of one task.
WORDS_TOGETHER, TEXT_OF_TASK = 64, 1 << 22

#: The strategies that a mode unites, in order.
MODES = {
    "baseline": ("baseline",), "baseline-kw": ("baseline-kw",), "keyword": ("keyword",), "rank": ("rank",), "ensemble": ("baseline", "rank", "keyword"), "ensemble2": ("rank", "keyword"),
    "hybrid": ("keyword", "baseline"),
}


# Questions ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Ask:
    """A query as positions: for each part its terms and weights; each rung says how many of each part's terms it still has."""

    parts: tuple[tuple[str, ...], ...]
    weights: tuple[tuple[float, ...], ...]
    every: tuple[bool, ...]
    rungs: tuple[tuple[int, ...], ...]
    ladder: bool


def compiled(query: Query, ladder: bool) -> Ask:
    """The query with all rungs of its ladder; without ``ladder`` the rungs lose one part after another from the end."""
    marked = iter(range(query.n_terms))
    query = query.map_terms(lambda t: replace(t, hyphen=str(next(marked))))
    parts = query.parts
    place = {t.hyphen: k for k, p in enumerate(parts) for t in p.terms}

    def left(rung: Query) -> tuple[int, ...]:
        counts = [0] * len(parts)
        for p in rung.parts:
            for t in p.terms:
                counts[place[t.hyphen]] += 1
        return tuple(counts)

    rungs: list[Query] = list(query.ladder()) if ladder else []
    rung: Query | None = None if ladder or not parts else query
    while rung is not None:
        rungs.append(rung)
        rung = rung.without_last()
    return Ask(tuple(tuple(t.text for t in p.terms) for p in parts), tuple(tuple(float(t.weight) for t in p.terms) for p in parts), tuple(p.inner == "AND" for p in parts), tuple(map(left, rungs)), ladder)


def query_of(question: str, weights: dict[str, float], mode: str, types: dict[str, tuple[str, ...]]) -> Query:
    """The query of a question for one strategy, entities marked."""
    parsed = Q.parse(question)
    keys = S.select_keywords(list(parsed.words), list(parsed.tags))
    if mode in ("keyword", "rank"):
        ordered = S.order_keywords(keys, weights) if mode == "rank" else keys
        built = keyword_query(ordered, [len(ordered) - i for i in range(len(ordered))], weights=weights, by_rank=mode == "rank")
    else:
        built = Q.build_query(parsed, weights, keys if mode == "baseline-kw" else None)
    marked = built.map_terms(lambda t: replace(t, types=types.get(t.text.lower(), ())))
    return marked.grouped() if mode.startswith("baseline") else marked


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _on_rows(frame: DataFrame, each: Callable[[dict], dict], schema: str, kinds: pa.Schema) -> DataFrame:
    """``each`` of the rows of a small table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [each(r) for r in _rows(batches)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return frame.mapInArrow(run, schema)


def _words(r: dict) -> dict:
    return {"qid": r["qid"], "question": r["question"], "words": sorted({w.lower() for w in Q.parse(r["question"]).words})}


def _lookups(modes: tuple[str, ...]) -> Callable[[dict], dict]:
    def run(r: dict) -> dict:
        weights = dict(r["weights"] or [])
        asked = {t.text.lower() for m in modes for p in query_of(r["question"], weights, m, {}).parts for t in p.terms}
        focus = Q.focus(Q.parse(r["question"]))
        return {**r, "lookups": sorted(asked | set(r["words"]) | ({focus.word.lower()} if focus else set()))}

    return run


def _planned(modes: tuple[str, ...]) -> Callable[[dict], dict]:
    def run(r: dict) -> dict:
        question, weights = r["question"], dict(r["weights"] or [])
        found = {term: tuple(sorted(types, key=E.TYPE_ORDER.index)) for term, types in r["types"] or []}
        parsed = Q.parse(question)
        of = lambda terms: {t: k for t in terms if (k := E.query_types(t, found))}
        asks = []
        for m in modes:
            terms = {t.text.lower() for p in query_of(question, weights, m, {}).parts for t in p.terms}
            ask = compiled(query_of(question, weights, m, of(terms)), m.startswith("baseline"))
            asks.append({"mode": m, "parts": ask.parts, "weights": ask.weights, "every": ask.every, "rungs": ask.rungs, "ladder": ask.ladder})
        focus, types = Q.focus(parsed), []
        if focus:
            types = list(of([focus.word.lower()]).get(focus.word.lower(), ()))
            if focus.word.lower() in E.FOCUS_NOUNS:
                types = list(dict.fromkeys([*types, E.FOCUS_NOUNS[focus.word.lower()]]))
        named = list(E.tag_text(parsed.text, {w: found[w] for w in r["words"] if w in found})) if types else []
        defined = Q.definition_phrases(parsed)
        return {"qid": r["qid"], "words": r["words"], "definition": defined[0] if defined else None, "types": types, "named": named, "asks": asks}

    return run


def understood(questions: DataFrame, vocabulary: DataFrame, dictionary: DataFrame, mode: str = "baseline") -> DataFrame:
    """(qid, words, definition, types, named, asks) for each of (qid, question): its words, the phrase of a definition question, the types of its focus, the entities that it names
    itself, and one ask for each strategy of the mode. Weights and types are looked up by equi-joins."""
    qid = questions.schema["qid"].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[qid]
    modes = MODES[mode]
    asked = questions.select("qid", "question").where(F.length("question") > 0)
    pairs = lambda value: pa.list_(pa.struct([("term", pa.string()), ("value", value)]))
    base = [("qid", kind), ("question", pa.string()), ("words", pa.list_(pa.string()))]
    words = _on_rows(asked, _words, f"qid {qid}, question string, words array<string>", pa.schema(base))
    weights = words.select("qid", F.explode("words").alias("term")).distinct().join(vocabulary.select("term", F.col("weight").cast("double").alias("weight")), "term")
    weights = weights.groupBy("qid").agg(F.collect_list(F.struct("term", F.col("weight").alias("value"))).alias("weights"))
    known = words.join(weights, "qid", "left")

    def in_pairs(each: Callable[[dict], dict], *columns: str) -> Callable[[dict], dict]:
        return lambda r: each({**r, **{c: [(x["term"], x["value"]) for x in r[c] or []] for c in columns}})

    def with_lookups(r: dict) -> dict:
        return {**r, "lookups": in_pairs(_lookups(modes), "weights")(r)["lookups"]}

    looked = _on_rows(known, with_lookups, f"qid {qid}, question string, words array<string>, weights array<struct<term: string, value: double>>, lookups array<string>",
                      pa.schema([*base, ("weights", pairs(pa.float64())), ("lookups", pa.list_(pa.string()))]))
    entries = dictionary.select(F.lower("term").alias("term"), "entity_type").distinct()
    types = looked.select("qid", F.explode("lookups").alias("term")).distinct().join(entries, "term").groupBy("qid", "term").agg(F.collect_list("entity_type").alias("value"))
    types = types.groupBy("qid").agg(F.collect_list(F.struct("term", "value")).alias("types"))
    ask = pa.struct([("mode", pa.string()), ("parts", pa.list_(pa.list_(pa.string()))), ("weights", pa.list_(pa.list_(pa.float64()))), ("every", pa.list_(pa.bool_())), ("rungs", pa.list_(pa.list_(pa.int32()))), ("ladder", pa.bool_())])
    strings = pa.list_(pa.string())
    return _on_rows(
        looked.drop("lookups").join(types, "qid", "left"), in_pairs(_planned(modes), "weights", "types"),
        f"qid {qid}, words array<string>, definition string, types array<string>, named array<string>, "
        "asks array<struct<mode: string, parts: array<array<string>>, weights: array<array<double>>, every: array<boolean>, rungs: array<array<int>>, ladder: boolean>>",
        pa.schema([("qid", kind), ("words", strings), ("definition", pa.string()), ("types", strings), ("named", strings), ("asks", pa.list_(ask))]),
    )


def _tasks(spark: SparkSession) -> int:
    """Parts into which small rows that cost much are dealt, however few bytes they have."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


# Retrieval ---------------------------------------------------------------------------------------------------------


def failing(ask: Ask) -> list[np.ndarray]:
    """For each part and depth (:meth:`_Matched.depth`), the rungs whose part such a document does not match."""
    rungs, tables = np.array(ask.rungs, np.int16).reshape(len(ask.rungs), len(ask.parts)), []
    for kept, part, every in zip(rungs.T, ask.parts, ask.every, strict=True):
        at = np.arange(len(part) + 2)[:, None]
        tables.append((kept > at) if every else (kept > 0) & (kept < at))
    return tables


class _Matched:
    """Which parts and rungs of which asks the documents of one batch match. Terms are rows and documents columns, so that what an ask needs lies together."""

    def __init__(self, asks: list[Ask], terms: list[list[list[int]]], n_terms: int, found: list[bytes]) -> None:
        self.asks, self.terms = asks, terms
        self.has = np.zeros((n_terms + 1, len(found)), bool)  # the last row is that of terms without a word
        for i, ids in enumerate(found):
            self.has[np.frombuffer(ids, np.int32), i] = True

    def depth(self, k: int) -> np.ndarray:
        """For each part and document the least number of the part's terms with which it matches, one more than there are if with none; of a part that asks for all its terms, how many of the
        first ones the document has."""
        terms, every = self.terms[k], np.array(self.asks[k].every, bool)[:, None]
        if not terms:
            return np.zeros((0, self.has.shape[1]), np.int16)
        sizes = np.array([len(ids) for ids in terms], np.int16)
        begins = np.cumsum(sizes, dtype=int) - sizes
        hit = self.has[np.concatenate(terms)]
        place = (np.arange(1, len(hit) + 1) - np.repeat(begins, sizes)).astype(np.int16)[:, None]
        behind = np.repeat(sizes + 1, sizes).astype(np.int16)[:, None]
        found = np.minimum.reduceat(np.where(hit, place, behind), begins, axis=0)
        return np.where(every, np.minimum.reduceat(np.where(hit, behind - 1, place - 1), begins, axis=0), found) if every.any() else found

    def on_rungs(self, k: int, depth: np.ndarray, fails: list[np.ndarray]) -> np.ndarray:
        """For each document and rung, whether it matches every part that the rung still has; ``fails`` has the tables of :func:`failing` as bits."""
        empty = np.array([not any(r) for r in self.asks[k].rungs], bool)
        failed = np.repeat(np.packbits(empty)[None, :], self.has.shape[1], axis=0)
        for at, table in zip(depth, fails, strict=True):
            failed |= table[at]
        return np.unpackbits(~failed, axis=1, count=len(empty)).view(bool)

    def any_part(self, k: int, depth: np.ndarray) -> np.ndarray:
        """Whether each document matches a part of the whole query."""
        sizes, every = np.array([len(p) for p in self.asks[k].parts])[:, None], np.array(self.asks[k].every, bool)[:, None]
        return np.where(every, depth >= sizes, depth <= sizes).any(0)

    def score(self, k: int, rung: tuple[int, ...]) -> np.ndarray:
        total = np.zeros(self.has.shape[1])
        for ids, weights, n in zip(self.terms[k], self.asks[k].weights, rung, strict=True):
            for t, w in zip(ids[:n], weights[:n], strict=True):
                total = total + np.where(self.has[t], w, 0.0)
        return total


def _parts(batches: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of few enough documents that their terms are a small matrix."""
    for b in batches:
        for at in range(0, len(b), most):
            yield b.slice(at, most)


def _numbered(asks: list[Ask]) -> tuple[list[tuple[str, ...]], list[list[list[int]]]]:
    """The distinct terms of all asks as words, and each ask's parts as numbers into them; a term without a word gets the number behind the last."""
    numbers: dict[tuple[str, ...], int] = {}
    spelt = [[[tuple(P.words_of(t.rstrip("*"))) for t in p] for p in a.parts] for a in asks]
    for words in (w for a in spelt for p in a for w in p if w):
        numbers.setdefault(words, len(numbers))
    return list(numbers), [[[numbers.get(w, len(numbers)) for w in p] for p in a] for a in spelt]


def retrieved(docs: DataFrame, asks: list[Ask], most: int = search.MOST_DOCS) -> DataFrame:
    """(ask, doc_id, rank): the best documents of each ask of a bounded list, by the rung of its ladder that the counts of all rungs choose."""
    spark = docs.sparkSession
    ready_to_checkpoint(spark)
    words, terms = _numbered(asks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = P.phrase_sets(docs, words).repartition(_tasks(spark), "doc_id").checkpoint()
    shared = spark.sparkContext.broadcast((asks, terms, len(words)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, terms, n_terms = shared.value
        totals = [np.zeros(len(a.rungs), np.int64) for a in asks]
        fails = [[np.packbits(t, axis=1) for t in failing(a)] for a in asks]
        for b in _parts(batches):
            m = _Matched(asks, terms, n_terms, b["found"].to_pylist())
            for k, a in enumerate(asks):
                if a.rungs:
                    totals[k] += m.on_rungs(k, m.depth(k), fails[k]).sum(0)
        rows = [(k, r, int(n)) for k, t in enumerate(totals) for r, n in enumerate(t) if n]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["ask", "rung", "n"])

    counts = [[0] * len(a.rungs) for a in asks]
    for r in sets.select("found").mapInArrow(count, "ask int, rung int, n long").groupBy("ask", "rung").agg(F.sum("n").alias("n")).collect():
        counts[r.ask][r.rung] = r.n
    chosen = [search.chosen_rung(n) if a.ladder else next((r for r, x in enumerate(n) if x), None) for a, n in zip(asks, counts, strict=True)]
    picked = spark.sparkContext.broadcast(chosen)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, terms, n_terms = shared.value
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(asks)
        fails = [None if r is None else [t[:, r] for t in failing(a)] for a, r in zip(asks, picked.value, strict=True)]
        for b in _parts(batches):
            m, ids = _Matched(asks, terms, n_terms, b["found"].to_pylist()), np.array(b["doc_id"].to_pylist(), object if kind == "string" else np.int64)
            for k, a in enumerate(asks):
                depth, rung = m.depth(k), picked.value[k]
                if rung is None:  # no rung has a match: the whole query by OR
                    rung = tuple(map(len, a.parts))
                    hit = m.any_part(k, depth)
                else:
                    hit = ~np.any([table[at] for at, table in zip(depth, fails[k], strict=True)], axis=0)
                    rung = a.rungs[rung]
                if hit.any():
                    more = ids[hit], m.score(k, rung)[hit]
                    both = more if best[k] is None else tuple(np.concatenate(x) for x in zip(best[k], more, strict=True))
                    order = np.lexsort((both[0], -both[1]))[:most] if kind != "string" else np.array(sorted(range(len(both[0])), key=lambda i: (-both[1][i], both[0][i]))[:most])  # noqa: B023
                    best[k] = both[0][order], both[1][order]
        for k, found in enumerate(best):
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found[0]), pa.int32()), pa.array(found[0].tolist(), b.schema.field("doc_id").type), pa.array(found[1])], ["ask", "doc_id", "score"])

    hits = sets.mapInArrow(pick, f"ask int, doc_id {kind}, score double").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    order = [F.desc("score"), "doc_id"]
    some = hits.withColumn("rank", F.row_number().over(Window.partitionBy("ask", "part").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy(*order))).where(F.col("rank") <= most).select("ask", "doc_id", "rank")


def _united(found: DataFrame, names: list[tuple], spark_kind: str, most: int = search.MOST_DOCS) -> DataFrame:
    """(qid, doc_id, rank) from the asks' lists: a question's lists one after another, each document where it comes first. ``names`` has the (qid, place) of each ask."""
    spark = found.sparkSession
    of = spark.createDataFrame([(k, q, s) for k, (q, s) in enumerate(names)], f"ask int, qid {spark_kind}, src int")
    first = found.join(F.broadcast(of), "ask").groupBy("qid", "doc_id").agg(F.min(F.struct("src", "rank")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "doc_id"))).where(F.col("rank") <= most).select("qid", "doc_id", "rank")


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


# Similarity --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Keep:
    """What of a question's scored sentences leaves a task: what may be among the ``most`` best of different texts, and sentences with its phrase (lower-cased), or all if it is in ``whole``."""

    most: int
    whole: frozenset = frozenset()
    phrases: dict = field(default_factory=dict)

    def chosen(self, qid: object, scores: np.ndarray, at: np.ndarray, docs: list, sids: np.ndarray, texts: list[str]) -> np.ndarray:
        """Which of the sentences ``at``: ordered as answers are, as many as bring ``most`` different ones that are long enough."""
        order = np.lexsort((sids[at], [docs[i] for i in at.tolist()], -scores))
        kept, keys, n = set(), set(), 0
        for i in order.tolist():
            if n == self.most:
                break
            text = texts[at[i]]
            key = _SPACE.sub("", text)
            if key not in keys:
                keys.add(key)
                kept.add(i)
                n += len(text) >= A.LEAST_LENGTH
        if phrase := self.phrases.get(qid):
            kept |= {i for i, k in enumerate(at.tolist()) if phrase in texts[k].lower()}
        return np.array(sorted(kept), np.int64)


@dataclass(frozen=True)
class SharedVectors:
    """Vectors of terms by reference: ``names`` (term, vec_id) and ``values`` (vec_id, embedding). A vector that many terms share is moved once for a block."""

    names: DataFrame
    values: DataFrame

    @staticmethod
    def of(vectors: DataFrame | SharedVectors) -> SharedVectors:
        """(term, embedding) as vectors of their own."""
        if isinstance(vectors, SharedVectors):
            return vectors
        return SharedVectors(vectors.select("term", F.col("term").alias("vec_id")), vectors.select(F.col("term").alias("vec_id"), "embedding"))


def _question_matrices(words: DataFrame, vectors: SharedVectors, vocabulary: DataFrame) -> dict:
    """{qid: (unit vectors of its known words, as rows; their weights)} of a bounded number of questions."""
    weighed = vocabulary.select("term", "weight").join(F.broadcast(words.select("qid", "term").distinct()), "term")
    named = vectors.names.join(F.broadcast(weighed), "term")
    known = vectors.values.join(F.broadcast(named), "vec_id")
    found: dict = {}
    for r in known.orderBy("qid", "term").collect():
        found.setdefault(r.qid, []).append((r.embedding, r.weight))
    return {q: (_units(np.array([e for e, _ in rows], float)), np.array([w for _, w in rows], float)) for q, rows in found.items()}


def _units(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def sentence_scores(docs: DataFrame, chosen: DataFrame, words: DataFrame, vectors: DataFrame | SharedVectors, vocabulary: DataFrame, keep: Keep | None = None) -> DataFrame:
    """(qid, doc_id, sid, sentence, score) for the sentences of each question's documents (qid, doc_id), as :func:`scored_sentences` gives them."""
    per_doc = chosen.groupBy("doc_id").agg(F.sort_array(F.collect_set("qid")).alias("qids"))
    few = chosen.count() <= MOST_BROADCAST
    return scored_sentences(docs.select("doc_id", "text").join(F.broadcast(per_doc) if few else per_doc, "doc_id"), words, vectors, vocabulary, keep)


def scored_sentences(docs: DataFrame, words: DataFrame, vectors: DataFrame | SharedVectors, vocabulary: DataFrame, keep: Keep | None = None) -> DataFrame:
    """(qid, doc_id, sid, sentence, score) for the sentences of (doc_id, text, qids) and the questions in ``qids``: relaxed word mover's similarity to the question's words (qid, term).

    A question word weighs its idf and takes its best cosine with a word of the sentence (-1 with none); the score is the weighted mean, 0 if not positive, as float. The questions
    are a bounded list. A document is split once; its distinct words meet their vectors once for each block of about ``BLOCK_BYTES``, and each document's words are multiplied
    with the words of the questions that chose it.
    """
    spark = docs.sparkSession
    ready_to_checkpoint(spark)
    vectors = SharedVectors.of(vectors)
    asked = spark.sparkContext.broadcast(_question_matrices(words, vectors, vocabulary))
    texts = docs.select("doc_id", "qids", T.sentences(F.col("text")).alias("sentences")).where(F.size("sentences") > 0)
    texts = texts.withColumn("words", F.transform("sentences", lambda s: F.array_join(lower_words(s), " "))).checkpoint()
    size = texts.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w)))).first()[0] or 0
    blocks = max(size // BLOCK_BYTES + 1, _tasks(spark))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    distinct = dealt.select("block", F.explode(F.array_distinct(F.split(F.array_join("words", " "), " "))).alias("term")).where(F.col("term") != "").distinct()
    named = distinct.join(vectors.names, "term").join(vocabulary.select("term"), "term", "left_semi").select(F.col("block").alias("of"), "term", "vec_id").checkpoint()
    needed = named.select("of", "vec_id").distinct().join(vectors.values, "vec_id").select("of", F.lit(None).cast("string").alias("term"), "vec_id", "embedding")
    near = named.withColumn("embedding", F.lit(None).cast(vectors.values.schema["embedding"].dataType)).unionByName(needed)
    qid, doc = docs.schema["qids"].dataType.elementType.simpleString(), docs.schema["doc_id"].dataType.simpleString()

    def score(rows: pa.Table, near: pa.Table) -> pa.Table:
        is_word = pc.is_valid(near["term"])
        words, values = near.filter(is_word), near.filter(pc.invert(is_word))
        place = {v: i for i, v in enumerate(values["vec_id"].to_pylist())}
        number = {w: place[v] for w, v in zip(words["term"].to_pylist(), words["vec_id"].to_pylist(), strict=True)}
        units = _units(np.array(values["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(place), -1)) if place else np.zeros((0, 1))
        docs, sids, texts, found = [], [], [], {}
        for doc_id, qids, sentences, words in zip(*(rows[c].to_pylist() for c in ("doc_id", "qids", "sentences", "words")), strict=True):
            each = [[number[w] for w in s.split() if w in number] for s in words]
            lengths = np.array([len(x) for x in each])
            full = np.flatnonzero(lengths)
            flat, place = np.unique(np.array([i for x in each for i in x], np.int64), return_inverse=True)
            begins = np.cumsum(lengths[full]) - lengths[full]
            at = np.arange(len(texts), len(texts) + len(sentences))
            docs += [doc_id] * len(sentences)
            sids += range(len(sentences))
            texts += sentences
            for q in qids:
                scores = np.zeros(len(sentences))
                if q in asked.value and len(full):
                    terms, weights = asked.value[q]
                    best = np.maximum.reduceat((units[flat] @ terms.T)[place], begins, axis=0)
                    above, below = np.maximum(best, -1.0) @ weights, weights.sum()
                    scores[full] = np.where(above > 0, above / below, 0.0) if below > 0 else 0.0
                found.setdefault(q, []).append((at, scores.astype(np.float32)))
        sids, columns = np.array(sids, np.int32), []
        for q, parts in found.items():
            at, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
            if keep and q not in keep.whole:
                some = keep.chosen(q, scores, at, docs, sids, texts)
                at, scores = at[some], scores[some]
            columns.append(([q] * len(at), [docs[i] for i in at.tolist()], sids[at], [texts[i] for i in at.tolist()], scores))
        kinds = rows.schema.field("qids").type.value_type, rows.schema.field("doc_id").type, pa.int32(), pa.string(), pa.float32()
        return pa.table([pa.chunked_array([pa.array(c[k], kind) for c in columns], kind) for k, kind in enumerate(kinds)], ["qid", "doc_id", "sid", "sentence", "score"])

    return dealt.repartition(blocks, "block").groupBy("block").cogroup(near.repartition(blocks, "of").groupBy("of")).applyInArrow(score, f"qid {qid}, doc_id {doc}, sid int, sentence string, score float")


#: Bytes of words that a task looks up at once.
BYTES_AT_ONCE = 1 << 23


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(document's id of each sentence, its number, how many words it has, all words) of the sentences with a word, about ``BYTES_AT_ONCE`` or one document's at a time."""
    for b in batches:
        sizes = np.diff(b["words"].offsets.to_numpy())
        texts = b["words"].flatten()
        ends = np.cumsum(np.concatenate([[0], pc.binary_length(texts).to_numpy(zero_copy_only=False)]))[np.cumsum(sizes)]
        owners, sids = np.repeat(np.arange(len(b)), sizes), (np.arange(len(texts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        part = np.repeat(ends // BYTES_AT_ONCE, sizes)
        full = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        for k in np.unique(part[full]):
            at = np.flatnonzero(full & (part == k))
            split = pc.split_pattern(texts.take(pa.array(at)), " ")
            yield b["doc_id"].take(pa.array(owners[at])), pa.array(sids[at]), np.diff(split.offsets.to_numpy()).astype(np.int64), split.flatten()


class _Words:
    """Words of sentences and their vectors of ``dims`` numbers. The vectors of the most frequent terms, a table of bounded size, go to all tasks."""

    def __init__(self, spark: SparkSession, vectors: SharedVectors, vocabulary: DataFrame, dims: int) -> None:
        self.values = vectors.values.where(F.size("embedding") == dims).select("vec_id", "embedding")
        self.known = vectors.names.join(vocabulary.select("term"), "term", "left_semi").select("term", "vec_id", "place")
        self.dims, self.most = dims, min(FREQUENT, NUMBERS // dims)
        frequent = self.known.where(F.col("place") < self.most).select("term", "vec_id").toArrow()
        used = spark.createDataFrame(pa.table({"vec_id": pc.unique(frequent["vec_id"])}))
        table = self.values.join(F.broadcast(used), "vec_id").toArrow()
        row = {v: i for i, v in enumerate(table["vec_id"].to_pylist())}
        named = [(t, row[v]) for t, v in zip(frequent["term"].to_pylist(), frequent["vec_id"].to_pylist(), strict=True) if v in row]
        self.head = spark.sparkContext.broadcast((named, _rows_of(table["embedding"].combine_chunks(), dims)))

    def __getstate__(self) -> dict:
        return {"head": self.head}  # tasks have no tables

    def numbered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
        """For the sentences of some documents at a time: document, number, numbers of the frequent words of all, how many each has; for those with other words those numbers as bytes and the others."""
        names = pa.array([t for t, _ in self.head.value[0]], pa.string())
        row = np.array([r for _, r in self.head.value[0]] + [-1], np.int32)
        for ids, sids, lengths, words in _word_batches(batches):
            numbers = row[pc.fill_null(pc.index_in(words, names), len(names)).to_numpy(zero_copy_only=False)]
            others = np.add.reduceat((numbers < 0).astype(np.int64), np.cumsum(lengths) - lengths)
            near, lengths = numbers[numbers >= 0], lengths - others
            ends = np.cumsum(lengths)
            left = pa.array([near[z - n : z].tobytes() if rest else None for z, n, rest in zip(ends.tolist(), lengths.tolist(), others.tolist(), strict=True)], pa.binary())
            far = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(others)]), pa.int32()), words.filter(pa.array(numbers < 0)))
            yield ids, sids, near, lengths, left, far

    def joined(self, open_ones: DataFrame) -> DataFrame:
        """(row, doc_id, sid, near, embedding): each sentence (row, doc_id, sid, near, far) and behind it the vectors of its rarer words, in one task."""
        rare = open_ones.select("row", F.explode("far").alias("term")).join(self.known.where(F.col("place") >= self.most), "term").select("row", "vec_id")
        few = self.values.count() * self.dims <= NUMBERS // 4
        rare = rare.join(F.broadcast(self.values) if few else self.values, "vec_id").select("row", "embedding")
        parts = open_ones.select("row", "doc_id", "sid", "near").unionByName(rare, allowMissingColumns=True)
        return parts.repartition("row").sortWithinPartitions("row", F.col("sid").desc_nulls_last())


def _spoken(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the words of each sentence with a space between them; sentences are numbered as T.sentences does, not trimmed."""
    pieces = F.filter(F.regexp_extract_all("text", F.lit("[^.?!]+[.?!]?"), F.lit(0)), lambda s: s.rlike(r"\S"))
    spoken = F.transform(pieces, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", " ")))
    return docs.select("doc_id", spoken.alias("words")).where(F.size("words") > 0)


def all_sentence_scores(docs: DataFrame, words: DataFrame, vectors: SharedVectors, vocabulary: DataFrame) -> DataFrame:
    """(qid, doc_id, sid, score) for every sentence with a word of (doc_id, text) and every question of (qid, term), scored as :func:`scored_sentences` does.

    ``vectors.names`` has the ``place`` of each term by falling frequency. The vectors of the most frequent terms, a table of bounded size, go to all tasks, which score sentences of such words
    where they are read; only a sentence with another word leaves its task, as the numbers of its frequent words, and meets the vectors of its rarer ones by joins.
    With more than ``WORDS_AT_ONCE`` words of questions, all words meet their vectors block by block.
    """
    spark = docs.sparkSession
    ready_to_checkpoint(spark)
    words = words.where("qid is not null")
    matrices = _question_matrices(words, vectors, vocabulary)
    qids = sorted(r.qid for r in words.select("qid").distinct().collect())
    if not matrices or sum(len(w) for _, w in matrices.values()) > WORDS_AT_ONCE:
        each = docs.select("doc_id", "text").crossJoin(F.broadcast(words.agg(F.sort_array(F.collect_set("qid")).alias("qids"))))
        return scored_sentences(each, words, vectors, vocabulary).where(F.col("sentence").rlike(r"[\p{L}\p{Nd}]")).select("qid", "doc_id", "sid", "score")
    terms = np.concatenate([matrices[q][0] for q in qids if q in matrices])
    n_words, dims = terms.shape
    weights = [matrices[q][1] if q in matrices else np.zeros(0) for q in qids]
    ends = np.cumsum([len(w) for w in weights])

    words_of = _Words(spark, vectors, vocabulary, dims)
    head = words_of.head

    def best_of(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each of neighbouring runs of words the best cosine with each question word; -1 in an empty one."""
        found, full = np.full((len(lengths), n_words), -1.0), np.flatnonzero(lengths)
        begins = np.cumsum(lengths) - lengths
        for a, z in _runs(lengths[full], 8 * TOGETHER):
            many = full[a:z]
            some, place = np.unique(numbers[begins[many[0]] : begins[many[-1]] + lengths[many[-1]]], return_inverse=True)
            cosines = _units(head.value[1][some].astype(float)) @ terms.T
            for b, y in _runs(lengths[many], TOGETHER):
                at, before = many[b:y], begins[many[0]]
                found[at] = np.maximum.reduceat(cosines[place[begins[at[0]] - before : begins[at[-1]] + lengths[at[-1]] - before]], begins[at] - begins[at[0]], axis=0)
        return found

    def scores_of(best: np.ndarray) -> pa.Array:
        found = np.zeros((len(best), len(qids)), np.float32)
        for k, (end, w) in enumerate(zip(ends, weights, strict=True)):
            above, below = np.maximum(best[:, end - len(w) : end], -1.0) @ w, w.sum()
            if below > 0:
                found[:, k] = np.where(above > 0, above / below, 0.0)
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(qids)).cast(pa.list_(pa.float32()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sids, near, lengths, left, far in words_of.numbered(batches):
            yield pa.RecordBatch.from_arrays([ids, sids, scores_of(best_of(near, lengths)), left, far], ["doc_id", "sid", "scores", "near", "far"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_best = None, np.zeros((0, n_words))  # the last sentence, which may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            is_far = pc.is_valid(b["embedding"]).to_numpy(zero_copy_only=False)
            best = np.empty((len(b), n_words))
            if is_far.any():
                best[is_far] = _units(_rows_of(b["embedding"].filter(pa.array(is_far)), dims).astype(float)) @ terms.T
            near = b["near"].filter(pa.array(~is_far)).to_pylist()
            best[~is_far] = best_of(np.frombuffer(b"".join(near), np.int32), np.array([len(n) // 4 for n in near], np.int64))
            table = pa.Table.from_batches([b]).select(["row", "doc_id", "sid"])
            table, best = (table, best) if held is None else (pa.concat_tables([held, table]), np.concatenate([held_best, best]))
            rows = table["row"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            first, best = table.take(pa.array(begins)), np.maximum.reduceat(best, begins, axis=0)
            held, held_best = first.slice(len(first) - 1), best[-1:]
            if len(first) > 1:
                yield finished(first.slice(0, len(first) - 1), best[:-1])
        if held is not None:
            yield finished(held, held_best)

    def finished(sentences: pa.Table, best: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([sentences["doc_id"].combine_chunks(), sentences["sid"].combine_chunks(), scores_of(best)], ["doc_id", "sid", "scores"])

    doc, qid = docs.schema["doc_id"].dataType.simpleString(), words.schema["qid"].dataType.simpleString()
    seen = _spoken(docs).mapInArrow(score, f"doc_id {doc}, sid int, scores array<float>, near binary, far array<string>").withColumn("row", F.monotonically_increasing_id()).checkpoint()
    merged = words_of.joined(seen.where("near is not null")).mapInArrow(merge, f"doc_id {doc}, sid int, scores array<float>")
    scored = seen.where("near is null").select("doc_id", "sid", "scores").unionByName(merged)
    names = F.array(*(F.lit(q) for q in qids)).cast(f"array<{qid}>")
    return scored.select("doc_id", "sid", F.explode(F.arrays_zip(names.alias("qid"), F.col("scores").alias("score"))).alias("s")).select("s.qid", "doc_id", "sid", "s.score")


def best_sentences(docs: DataFrame, words: DataFrame, vectors: SharedVectors, vocabulary: DataFrame, most: int, digits: int = 4) -> DataFrame:
    """(qid, doc_id, sid, score): for each question (qid, term) at least the ``most`` best of the sentences that :func:`all_sentence_scores` scores, their scores rounded; of equal ones the first.

    Texts are dealt into parts of bounded size, since comparing them is most of the work; sentences move as there, once for each quarter of ``QUESTIONS_AT_ONCE`` questions. In a task a run of sentences meets each different word of the questions once, and of a question's sentences only the
    ``most`` best leave the task.
    """
    spark = docs.sparkSession
    ready_to_checkpoint(spark)
    words = words.where("qid is not null").select("qid", "term").distinct()
    blocks, found = words.select("qid").distinct().count() // max(QUESTIONS_AT_ONCE // 4, 1) + 1, None
    for n in range(blocks):
        some = _best_of_block(docs, words.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n), vectors, vocabulary, most, digits)
        found = some if found is None else found.unionByName(some)
    return found


def _best_of_block(docs: DataFrame, words: DataFrame, vectors: SharedVectors, vocabulary: DataFrame, most: int, digits: int) -> DataFrame:
    matrices = _question_matrices(words, vectors, vocabulary)
    if not matrices:
        return all_sentence_scores(docs, words, vectors, vocabulary).withColumn("score", F.round(F.col("score").cast("double"), digits))
    qids = sorted(r.qid for r in words.select("qid").distinct().collect())
    instances = np.concatenate([matrices[q][0] for q in qids if q in matrices])
    terms, place = np.unique(instances, axis=0, return_inverse=True)
    ends = np.cumsum([len(matrices[q][1]) if q in matrices else 0 for q in qids])
    asked = [(place.ravel()[end - len(w) : end], w) for end, w in ((end, matrices[q][1] if q in matrices else np.zeros(0)) for q, end in zip(qids, ends.tolist(), strict=True))]
    n_words, dims = terms.shape
    words_of = _Words(docs.sparkSession, vectors, vocabulary, dims)
    doc, qid = docs.schema["doc_id"].dataType.simpleString(), words.schema["qid"].dataType.simpleString()
    doc_type, qid_type = to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(words.schema["qid"].dataType)

    def bests(numbers: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, best cosine with each question word) of runs of the sentences that have words."""
        full = np.flatnonzero(lengths)
        begins = np.cumsum(lengths) - lengths
        for a, z in _runs(lengths[full], 4 * TOGETHER):
            many = full[a:z]
            some, place = np.unique(numbers[begins[many[0]] : begins[many[-1]] + lengths[many[-1]]], return_inverse=True)
            units, before = _units(words_of.head.value[1][some].astype(float)), begins[many[0]]
            found, parts = np.empty((len(many), n_words)), _runs(lengths[many], TOGETHER)
            for t in range(0, n_words, WORDS_TOGETHER):
                cosines = units @ terms[t : t + WORDS_TOGETHER].T
                for b, y in parts:
                    at = many[b:y]
                    found[b:y, t : t + WORDS_TOGETHER] = np.maximum.reduceat(cosines[place[begins[at[0]] - before : begins[at[-1]] + lengths[at[-1]] - before]], begins[at] - begins[at[0]], axis=0)
            yield many, found

    def offer(best: Best, found: np.ndarray, docs: pa.Array, sids: np.ndarray) -> None:
        scores = np.zeros((len(asked), len(found)), np.float32)
        for k, (at, w) in enumerate(asked):
            if (below := w.sum()) > 0:
                above = np.maximum(found[:, at], -1.0) @ w
                scores[k] = np.where(above > 0, above / below, 0.0)
        values = np.floor(scores.astype(float) * 10**digits + 0.5) / 10**digits
        i, j = best.hits(np.arange(len(asked)), values)
        places, back = np.unique(j, return_inverse=True)
        keys = np.empty(len(places), object)
        keys[:] = [(d is not None, d, s) for d, s in zip(docs.take(pa.array(places)).to_pylist(), sids[places].tolist(), strict=True)]
        best.offer(i, keys[back], values[i, j])

    def rows_of(best: Best) -> list[pa.Array]:
        i, keys, values = best.found()
        _, docs, sids = zip(*keys.tolist(), strict=True) if len(keys) else ((), (), ())
        return [pa.array([qids[k] for k in i.tolist()], qid_type), pa.array(docs, doc_type), pa.array(sids, pa.int32()), pa.array(values, pa.float64())]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, names = Best(len(asked), most), ["qid", "doc_id", "sid", "score", "near", "far"]
        for ids, sids, near, lengths, left, far in words_of.numbered(batches):
            whole = pc.is_null(left).to_numpy(zero_copy_only=False)
            for many, found in bests(near[np.repeat(whole, lengths)], lengths[whole]):
                at = np.flatnonzero(whole)[many]
                offer(best, found, ids.take(pa.array(at)), sids.to_numpy()[at])
            rest = pa.array(~whole)
            open_ones = [x.filter(rest) for x in (ids, sids, left, far)]
            n = len(open_ones[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, qid_type), *open_ones[:2], pa.nulls(n, pa.float64()), *open_ones[2:]], names)
        done = rows_of(best)
        yield pa.RecordBatch.from_arrays([*done, pa.nulls(len(done[0]), pa.binary()), pa.nulls(len(done[0]), far_type)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, held_best = Best(len(asked), most), None, np.zeros((0, n_words))  # the last sentence, which may go on in the next batch
        for b in _parts(batches, max(1, NUMBERS // 8 // n_words)):
            if not len(b):
                continue
            is_far = pc.is_valid(b["embedding"]).to_numpy(zero_copy_only=False)
            found = np.full((len(b), n_words), -1.0)
            if is_far.any():
                found[is_far] = _units(_rows_of(b["embedding"].filter(pa.array(is_far)), dims).astype(float)) @ terms.T
            near, at = b["near"].filter(pa.array(~is_far)).to_pylist(), np.flatnonzero(~is_far)
            for many, some in bests(np.frombuffer(b"".join(near), np.int32), np.array([len(x) // 4 for x in near], np.int64)):
                found[at[many]] = some
            table = pa.Table.from_batches([b]).select(["row", "doc_id", "sid"])
            table, found = (table, found) if held is None else (pa.concat_tables([held, table]), np.concatenate([held_best, found]))
            rows = table["row"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            first, found = table.take(pa.array(begins)), np.maximum.reduceat(found, begins, axis=0)
            held, held_best = first.slice(len(first) - 1), found[-1:]
            if len(first) > 1:
                offer(best, found[:-1], first["doc_id"].slice(0, len(first) - 1).combine_chunks(), first["sid"].to_numpy()[:-1])
        if held is not None:
            offer(best, held_best, held["doc_id"].combine_chunks(), held["sid"].to_numpy())
        yield pa.RecordBatch.from_arrays(rows_of(best), ["qid", "doc_id", "sid", "score"])

    far_type = pa.list_(pa.string())
    result = f"qid {qid}, doc_id {doc}, sid int, score double"
    seen = _spoken(in_parts(docs.select("doc_id", "text"), "text", TEXT_OF_TASK)).mapInArrow(score, f"{result}, near binary, far array<string>").withColumn("row", F.monotonically_increasing_id()).checkpoint()
    merged = words_of.joined(seen.where("near is not null")).mapInArrow(merge, result)
    return seen.where("near is null").select("qid", "doc_id", "sid", "score").unionByName(merged)


def _rows_of(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _runs(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of neighbours whose lengths are ``most`` together or little more, as (begin, end)."""
    if not len(lengths):
        return []
    part = (np.cumsum(lengths) - lengths) // most
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


# Answers -----------------------------------------------------------------------------------------------------------


def routed(scored: DataFrame, plans: DataFrame, dictionary: DataFrame, most: int) -> DataFrame:
    """(qid, doc_id, sid, sentence, score, rank): definition questions by pattern where a sentence has it, questions with a typed focus by entities, all others by similarity."""
    routes = plans.select("qid", "definition", "types", "named")
    rows = scored.join(F.broadcast(routes), "qid").checkpoint()
    result = ["qid", "doc_id", "sid", "sentence", "score"]
    defining = rows.where(F.col("definition").isNotNull()).where(A.defines(F.col("sentence"), F.col("definition")))
    defined = A.top_per_question(defining.withColumn("score", F.lit(1.0).cast("float")), most).select(*result, "rank")
    rest = rows.join(F.broadcast(defined.select("qid").distinct()), "qid", "left_anti")
    typed = E.tagged(rest.where(F.size("types") > 0), dictionary)
    focused = A.combined(A.focus_scores(typed, F.col("named"), F.col("types")), key=["qid"]).withColumn("score", F.col("score").cast("float"))
    others = rest.where(F.size("types") == 0).select(*result).unionByName(focused.select(*result))
    return defined.unionByName(A.top_per_question(A.deduplicated(others, key=["qid"]), most).select(*result, "rank"))


def ask_all(docs: DataFrame, questions: DataFrame, vocabulary: DataFrame, vectors: DataFrame | SharedVectors, dictionary: DataFrame, most: int = 10, mode: str = "baseline", scorer: S.PairScorer | None = None) -> DataFrame:
    """(qid, doc_id, sid, sentence, score, rank): the answers that :class:`quaero.plans.engine.Engine` gives to each question (qid, question), for all of them at once.

    With a ``scorer`` each question's first 100 answers are put in its order before the best ``most`` are taken.
    """
    ready_to_checkpoint(docs.sparkSession)
    plans = understood(questions, vocabulary, dictionary, mode).checkpoint()
    blocks = plans.count() // QUESTIONS_AT_ONCE + 1
    docs, answers = docs.select("doc_id", "text"), None
    for k in range(blocks):
        block = plans.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
        names, asks = [], []
        for r in block.select("qid", "asks").collect():
            for place, a in enumerate(r.asks):
                names.append((r.qid, place))
                asks.append(Ask(tuple(map(tuple, a.parts)), tuple(map(tuple, a.weights)), tuple(a.every), tuple(map(tuple, a.rungs)), a.ladder))
        chosen = _united(retrieved(docs, asks), names, plans.schema["qid"].dataType.simpleString()).checkpoint()
        wanted = S.MOST_RERANKED if scorer else most
        routes = block.select("qid", "definition", F.size("types").alias("n")).collect()
        keep = Keep(wanted, frozenset(r.qid for r in routes if r.n), {r.qid: r.definition.lower() for r in routes if r.definition})
        scored = sentence_scores(docs, chosen, block.select("qid", F.explode("words").alias("term")), vectors, vocabulary, keep)
        found = routed(scored, block, dictionary, wanted)
        answers = found if answers is None else answers.unionByName(found)
    if scorer:
        spoken = answers.join(questions.select("qid", "question"), "qid")
        answers = S.reranked(spoken, scorer).where(F.col("rank") <= most).drop("question")
    return answers
