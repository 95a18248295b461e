"""Dictionary and ontology entities: typing of terms, tagging of sentences, hierarchy closures."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import text as T
from quaero.functions.lexing import tokens
from quaero.sources.shared import ready_to_checkpoint

#: Entity types in the order in which they are listed.
TYPE_ORDER = ("neurotransmitter", "gene", "enzyme", "protein", "disease", "drug", "molecular entity", "organism", "anatomical entity", "cellular component")
#: Class nouns, which name a type and no entity.
GENERIC_NOUNS = (
    "gene", "genes", "disease", "disorder", "enzyme", "protein", "proteins", "syndrome", "syndromes", "disorders", "enzymes", "neurotransmitter", "neurotransmitters",
)
#: Class nouns that a question's focus may be.
FOCUS_NOUNS = {n + s: n for n in ("neurotransmitter", "disease", "gene", "protein", "drug", "enzyme") for s in ("", "s")}
#: Words that always have a type, and types that a word never has.
ALWAYS = (("disease", "disease"), ("disorder", "disease"), ("histone", "protein"), ("kinase", "protein"), ("ligase", "protein"), ("enzyme", "protein"),
          ("protein", "protein"), ("gene", "gene"), ("oncogene", "gene"), ("oncogenes", "gene"))
NEVER = (("fda", "protein"), ("fda", "molecular entity"), ("triad", "cellular component"), ("antibody", "cellular component"), ("cancer", "organism"))
UNTYPED = ("finding", "top")


def _type_rank(entity_type: Column) -> Column:
    rank = F.lit(len(TYPE_ORDER))
    for k, name in enumerate(TYPE_ORDER):
        rank = F.when(entity_type == name, k).otherwise(rank)
    return rank


def dictionary(*tables: tuple[DataFrame, str, str, str | None]) -> DataFrame:
    """(term, entity_type), lower-cased and distinct, from (table, column, type, separator of several names or None)."""
    found = None
    for table, column, entity_type, separator in tables:
        names = F.explode(F.split(F.lower(column), rf"\s*{separator}\s*")) if separator else F.lower(column)
        one = table.select(names.alias("term"), F.lit(entity_type).alias("entity_type"))
        found = one if found is None else found.unionByName(one)
    return found.where(F.length(F.trim("term")) > 0).select(F.trim("term").alias("term"), "entity_type").distinct()


def typed(terms: DataFrame, known: DataFrame, stop: DataFrame | None = None, column: str = "term") -> DataFrame:
    """``terms`` with ``types``: an ordered array of entity types, empty for unknown, blank and untyped terms. ``stop`` (term, entity_type) takes types away."""
    spark = terms.sparkSession
    always = spark.createDataFrame(ALWAYS, "term string, entity_type string")
    never = spark.createDataFrame(NEVER, "term string, entity_type string")
    pairs = known.select(F.lower("term").alias("term"), "entity_type").unionByName(always).distinct()
    pairs = pairs.join(F.broadcast(never if stop is None else never.unionByName(stop.select(F.lower("term").alias("term"), "entity_type"))), ["term", "entity_type"], "left_anti")
    grouped = pairs.groupBy("term").agg(F.transform(F.array_sort(F.collect_set(F.struct(_type_rank(F.col("entity_type")).alias("rank"), "entity_type"))), lambda t: t["entity_type"]).alias("__types"))
    joined = terms.withColumn("__key", F.lower(F.trim(column))).join(grouped.withColumnRenamed("term", "__key"), "__key", "left")
    none = F.array().cast("array<string>")
    kept = F.when(F.col("__key").isin(*UNTYPED) | (F.col("__key") == ""), none).otherwise(F.coalesce("__types", none))
    upper = F.filter(kept, lambda t: (t != "anatomical entity") | ~T.is_all_capital(F.col(column)))
    return joined.withColumn("types", upper).drop("__key", "__types")


def focus_types(types: Column, term: Column) -> Column:
    """The types of a focus term, with the class that it names itself."""
    own = F.lit(None).cast("string")
    for noun, name in FOCUS_NOUNS.items():
        own = F.when(F.lower(term) == noun, name).otherwise(own)
    return F.array_union(types, F.when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>")))


def tag_text(text: str, known: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Entities of a sentence, greedily left to right: from each token grow while the phrase has types, keep the longest; of spellings that differ in case the first stays, class nouns go at the end."""

    def types(phrase: str) -> tuple[str, ...]:
        low = phrase.lower()
        if low.startswith("protein") and " " in low:
            rest = low.split(" ", 1)[1]
            return known.get(rest) or (("protein",) if " " not in rest else ())
        return known.get(low, ())

    words = [t for t, _, _ in tokens(text)]
    found: dict[str, tuple[str, ...]] = {}
    seen: set[str] = set()
    i = 0
    while i < len(words):
        if not any(c.isalnum() for c in words[i]) or words[i].lower() in T.STOP_WORDS:
            i += 1
            continue
        best, j = 0, i
        while j < len(words) and types(" ".join(words[i : j + 1])):
            j += 1
            best = j - i
        if best:
            phrase = " ".join(words[i : i + best])
            if phrase.lower() not in seen:
                seen.add(phrase.lower())
                found[phrase] = types(phrase)
        i += max(best, 1)
    return {p: t for p, t in found.items() if p.lower() not in GENERIC_NOUNS}


ENTITIES = "array<struct<phrase:string,types:array<string>>>"


def _in_order(types: Iterable[str]) -> tuple[str, ...]:
    return tuple(sorted(types, key=lambda t: TYPE_ORDER.index(t) if t in TYPE_ORDER else 99))


def _entities(text: str | None, known: dict[str, tuple[str, ...]]) -> list[dict]:
    return [{"phrase": p, "types": list(k)} for p, k in tag_text(text or "", known).items()]


_RUN = re.compile(r"[^\W_]+")


def first_runs(known: Iterable[str]) -> frozenset[str]:
    """The first run of letters and digits of each term that an entity can begin with: a token, so without white space, and no stop word."""
    return frozenset(m[0] for t in known if t not in T.STOP_WORDS and len(t.split()) == 1 and (m := _RUN.search(t.replace("\u03c2", "\u03c3"))))


def may_have_entity(text: str | None, firsts: frozenset[str]) -> bool:
    """Whether a text has one of these runs. Tokens end beside whole runs, so a text without one has no entity and need not be split into tokens. Both forms of a small sigma are one here, since
    lower-casing chooses between them by what stands around."""
    return bool(text) and not firsts.isdisjoint(_RUN.findall(text.lower().replace("\u03c2", "\u03c3")))


def asked_phrases(text: str, most: int) -> list[str]:
    """Every phrase of up to ``most`` words that :func:`tag_text` may look up in a sentence, whatever the dictionary has."""
    words = [t for t, _, _ in tokens(text)]
    found = {" ".join(words[i:j]).lower() for i in range(len(words)) for j in range(i + 1, min(i + most, len(words)) + 1)}
    return sorted(found | {p.split(" ", 1)[1] for p in found if p.startswith("protein") and " " in p})


def tagged(sentences: DataFrame, known: DataFrame, column: str = "sentence", most_terms: int = 500_000) -> DataFrame:
    """``sentences`` with ``entities``: array of (phrase, types). The dictionary travels with the function, so its size is checked first; beyond
    ``most_terms`` :func:`tagged_by_join` gives the same entities."""
    rows = known.groupBy(F.lower("term").alias("term")).agg(F.array_sort(F.collect_set("entity_type")).alias("types")).limit(most_terms + 1).collect()
    if len(rows) > most_terms:
        return tagged_by_join(sentences, known, column)
    terms = {r.term: _in_order(r.types) for r in rows if r.term is not None}
    table = sentences.sparkSession.sparkContext.broadcast((terms, first_runs(terms)))

    @F.pandas_udf(ENTITIES)
    def run(texts: pd.Series) -> pd.Series:
        known, firsts = table.value
        return texts.map(lambda t: _entities(t, known) if may_have_entity(t, firsts) else [])

    return sentences.withColumn("entities", run(F.col(column)))


#: Words that type a phrase by standing at its end or, for ``protein``, at its start.
LAST_WORDS = {"disease": "disease", "disorder": "disease", "syndrome": "disease", "protein": "protein", "gene": "gene"}


def query_types(term: str, known: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The types of a query term: those of the dictionary, else by its last or first word."""
    low = term.lower()
    if low in UNTYPED or low in GENERIC_NOUNS:
        return ()
    words = low.split()
    by_rule = LAST_WORDS.get(words[-1]) if len(words) > 1 else None
    if by_rule is None and len(words) > 1 and words[0] == "protein":
        by_rule = "protein"
    return known.get(low) or ((by_rule,) if by_rule else ())


def spans(sentences: DataFrame, key: list[str], column: str, most: int = 4) -> DataFrame:
    """(key, start, size, phrase): all word runs of a sentence up to ``most`` words."""
    words = sentences.select(*key, T.ws_tokens(F.regexp_replace(F.lower(column), r"[^\p{L}\p{Nd}\s-]", " ")).alias("w"))
    cut = lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("start"), F.lit(n).alias("size"), F.array_join(F.slice("w", i, n), " ").alias("phrase")))
    return words.select(*key, F.inline(F.concat(*(cut(n) for n in range(1, most + 1)))))


def tagged_by_join(sentences: DataFrame, known: DataFrame, column: str = "sentence") -> DataFrame:
    """Tagging against a dictionary of any size: all phrases that a sentence may ask for, an equi-join, and :func:`tag_text` with the terms that were found."""

    longest = known.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 0

    @F.pandas_udf("array<string>")
    def phrases(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: asked_phrases(t or "", longest + 1))  # one more for ``protein`` before a term

    @F.pandas_udf(ENTITIES)
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_entities(t, {} if k is None else {e["phrase"]: _in_order(e["types"]) for e in k}) for t, k in zip(texts, found, strict=True)], dtype=object)

    keyed = sentences.withColumn("__key", F.xxhash64(column))
    asked = keyed.select("__key", column).distinct().select("__key", F.explode(phrases(F.col(column))).alias("phrase"))
    typed_terms = known.groupBy(F.lower("term").alias("phrase")).agg(F.collect_set("entity_type").alias("types"))
    found = asked.join(typed_terms, "phrase").groupBy("__key").agg(F.collect_list(F.struct("phrase", "types")).alias("__found"))
    return keyed.join(found, "__key", "left").withColumn("entities", run(F.col(column), F.col("__found"))).drop("__key", "__found")


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent", first_only: bool = False, most: int | None = None) -> DataFrame:
    """(node, ancestor, depth): the closure of a hierarchy, each pair at its least depth, so cycles end by themselves; ``most`` bounds the steps. With ``first_only`` a node follows its least parent only."""
    pairs = edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("node is not null and up is not null")
    pairs = pairs.groupBy("node").agg(F.min("up").alias("up")) if first_only else pairs.distinct()
    ready_to_checkpoint(edges.sparkSession)
    pairs = pairs.checkpoint()
    closure = frontier = pairs.select("node", F.col("up").alias("ancestor"), F.lit(1).alias("depth"))
    for depth in range(2, most + 1) if most else count(2):
        step = frontier.join(pairs.select(F.col("node").alias("ancestor"), "up"), "ancestor").select("node", F.col("up").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        frontier = step.join(closure, ["node", "ancestor"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        closure = closure.unionByName(frontier)
        closure = closure.checkpoint() if depth % 16 == 0 else closure  # a plan of few parts, however deep the hierarchy
    return closure


def is_a(nodes: DataFrame, labels: DataFrame, closure: DataFrame, label: str) -> DataFrame:
    """Nodes that are, or descend from, a node with this label (case-insensitive). ``labels`` is (node, label)."""
    roots = labels.where(F.lower("label") == label.lower()).select(F.col("node").alias("ancestor"))
    below = closure.join(F.broadcast(roots), "ancestor", "left_semi").select("node").unionByName(roots.withColumnRenamed("ancestor", "node")).distinct()
    return nodes.join(below, "node", "left_semi")


def longest_match(phrases: DataFrame, labels: DataFrame, column: str = "phrase", least: int = 3) -> DataFrame:
    """(phrase, matched, node): the whole phrase, else its longest suffix, else its longest prefix, of ``least`` characters or more, that is a label."""
    words = T.ws_tokens(F.lower(column))
    options = F.concat(F.array(F.array_join(words, " ")), T.suffixes(words), T.prefixes(words))
    each = phrases.select(column, F.posexplode(options).alias("prio", "matched")).where(F.length("matched") >= least)
    hits = each.join(labels.select(F.lower("label").alias("matched"), "node"), "matched")
    return hits.groupBy(column).agg(F.min(F.struct("prio", "matched", "node")).alias("best")).select(column, "best.matched", "best.node")


def concept_is(categories: Column, curie: Column, kind: str) -> Column:
    """Whether a concept record is of a kind, by category or by the prefix of its id."""
    prefix = {"disease": "DOID:", "gene": "NCBIGene:", "anatomical entity": "UBERON:", "organism": "NCBITaxon:", "cellular component": "GO:", "molecular entity": "CHEBI:", "protein": "PR:"}[kind]
    return F.coalesce(F.exists(categories, lambda c: F.lower(c) == kind), F.lit(False)) | F.startswith(curie, F.lit(prefix))


def acronym_expansions(acronyms: DataFrame) -> DataFrame:
    """(acronym, cluster_id, total, expansions by falling frequency) from (acronym, expansion, freq, cluster_id)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("n"), "expansion"))), lambda e: e["expansion"])
    return acronyms.groupBy("acronym", "cluster_id").agg(F.sum("freq").alias("total"), ordered.alias("expansions"))


def acronym_of(expansions: DataFrame, acronyms: DataFrame, column: str = "expansion") -> DataFrame:
    best = acronyms.groupBy("expansion").agg(F.max_by("acronym", F.struct("freq", "acronym")).alias("acronym"))
    return expansions.join(best.withColumnRenamed("expansion", column), column, "left")


def acronym_in_ngrams(questions: DataFrame, acronyms: DataFrame, key: str = "question_id", column: str = "question", most: int = 6) -> DataFrame:
    """(key, ngram, acronym): the last n-gram, of two words to ``most``, that is a known expansion."""
    grams = spans(questions, [key], column, most).where("size >= 2")
    best = acronyms.groupBy(F.lower("expansion").alias("phrase")).agg(F.max_by("acronym", F.struct("freq", "acronym")).alias("acronym"))
    hits = grams.join(best, "phrase")
    last = hits.groupBy(key).agg(F.max(F.struct("start", "size", "phrase", "acronym")).alias("x"))
    return last.select(key, F.col("x.phrase").alias("ngram"), "x.acronym")


def lemmas(words: DataFrame, morphology: DataFrame, column: str = "term") -> DataFrame:
    """``words`` with ``lemma``: the first base form in (term, pos, base, ord), else the word without a final s, else the word."""
    first = morphology.groupBy("term").agg(F.min_by("base", "ord").alias("__base"))
    joined = words.join(first.withColumnRenamed("term", column), column, "left")
    cut = F.when(F.col(column).rlike("[^s]s$") & (F.length(column) > 3), F.substring(F.col(column), F.lit(1), F.length(column) - 1)).otherwise(F.col(column))
    return joined.withColumn("lemma", F.coalesce("__base", cut)).drop("__base")


def conjugations(verbs: DataFrame, irregular: DataFrame, column: str = "verb") -> DataFrame:
    """``verbs`` with third person, past, participle and gerund; ``irregular`` is (verb, past, participle)."""
    v = F.col(column)
    stem = F.when(v.rlike("[^eo]e$"), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v)
    ies = v.rlike("[^aeiou]y$")
    cut = F.substring(v, F.lit(1), F.length(v) - 1)
    third = F.when(ies, F.concat(cut, F.lit("ies"))).when(v.rlike("(s|x|z|ch|sh|o)$"), F.concat(v, F.lit("es"))).otherwise(F.concat(v, F.lit("s")))
    past = F.when(ies, F.concat(cut, F.lit("ied"))).when(v.rlike("e$"), F.concat(v, F.lit("d"))).otherwise(F.concat(v, F.lit("ed")))
    joined = verbs.join(F.broadcast(irregular.select(F.col("verb").alias(column), F.col("past").alias("__past"), F.col("participle").alias("__part"))), column, "left")
    return joined.withColumns({"third": third, "past": F.coalesce("__past", past), "participle": F.coalesce("__part", past), "gerund": F.concat(stem, F.lit("ing"))}).drop("__past", "__part")
