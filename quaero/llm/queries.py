"""The queries of the training-data operators over whole tables, with the digests that their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm import chat_template, collocations, decontaminate, edit_join, lpf_dedup, merkle_audit, mixing, ngram_join, oracle, ordinal_grades, ring_shards, rule_lists, secret_scan, turn_repair


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lpf_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards.shard_documents(_table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica in which one page in 97 has another body and one in 389 is missing."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("~"), F.substring(F.col("html"), F.lit(2), F.length("html")))).otherwise(F.col("html"))
    replica = pages.where(F.col("page_id").isNull() | (F.col("page_id") % 389 != 7)).select("page_id", "url", damaged.alias("html"))
    return merkle_audit.audit(pages, replica)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op5_rule_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = rule_lists.fit(docs, _table(spark, sf_dir, "labels"))
    return rule_lists.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    digests = [chat_template.digests(chat_template.format_conversations(x)) for x in (rows, probe)]  # apart, as the table may have the probe's number
    return digests[0].unionByName(digests[1])


def op7_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_join.removed_lines(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_ordinal_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ordinal_grades.grade(docs, ordinal_grades.fit(docs, _table(spark, sf_dir, "labels")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report(_table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lpf_dedup": op1_lpf_dedup,
    "op2_ring_shards": op2_ring_shards,
    "op3_merkle_audit": op3_merkle_audit,
    "op4_decontaminate": op4_decontaminate,
    "op5_rule_lists": op5_rule_lists,
    "op6_chat_template": op6_chat_template,
    "op7_edit_join": op7_edit_join,
    "op8_ngram_join": op8_ngram_join,
    "op9_ordinal_grades": op9_ordinal_grades,
    "op10_mix_sources": op10_mix_sources,
    "op11_turn_repair": op11_turn_repair,
    "op12_collocations": op12_collocations,
    "op13_secret_scan": op13_secret_scan,
}

#: The others depend on hashes (op2, op10), on what was learned (op5, op9), take SQL too long on whole tables (op7), or decode nested layers (op13); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_lpf_dedup": oracle.LPF_DEDUP,
    "op3_merkle_audit": oracle.MERKLE_AUDIT,
    "op4_decontaminate": oracle.DECONTAMINATE,
    "op6_chat_template": oracle.CHAT_TEMPLATE,
    "op8_ngram_join": oracle.NGRAM_JOIN,
    "op11_turn_repair": oracle.TURN_REPAIR,
    "op12_collocations": oracle.COLLOCATIONS,
}
