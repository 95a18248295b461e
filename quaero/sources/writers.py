"""Writers: every sink is a partitioned Spark write; caches are tables keyed by a query's hash."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frequencies(table: DataFrame, path: str) -> None:
    """``term<TAB>freq`` in order of the terms."""
    table.orderBy("term").select("term", "freq").write.mode("overwrite").option("sep", "\t").csv(path)


def by_frequency(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("freq"), "term")


def folds(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("fold").option("sep", "\t").option("header", True).csv(path)


def triples(rows: DataFrame, path: str) -> None:
    """Label, question, candidate with a header."""
    rows.select("label", "question", "answer_candidate").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def two_lines(rows: DataFrame, path: str, second: str = "labels") -> None:
    """Tokens and labels as alternating lines, one row's pair in one record."""
    rows.select(F.concat_ws("\n", F.array_join("tokens", " "), F.array_join(F.transform(second, lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(path)


def table_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def table_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def table_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def table_xml(rows: DataFrame, path: str, row: str = "dr", root: str = "records") -> None:
    rows.write.format("xml").mode("overwrite").option("rowTag", row).option("rootTag", root).save(path)


def answer_log(answers: DataFrame, path: str) -> None:
    """``i) sentence [score] PMID:id`` lines in rank order, a block for each question."""
    line = F.format_string("%d) %s [%.4f] PMID:%s", "rank", "sentence", F.col("score").cast("double"), F.col("doc_id").cast("string"))
    blocks = answers.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("l"))
    blocks.select(F.concat_ws("\n", F.concat(F.lit("Question:"), "question"), "l", F.lit("=" * 40)).alias("value")).write.mode("overwrite").text(path)


class TableCache:
    """Results as parquet folders under the hash of their key: shared by all executors, and there after a restart."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, key: str) -> str:
        import hashlib

        return f"{self.folder}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def put(self, key: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(key))
        return self.spark.read.parquet(self.path(key))

    def get(self, key: str) -> DataFrame | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key) + "/_SUCCESS")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self.path(key)) if fs.exists(fs_path) else None


class AnswerCache:
    """Collected answers by question, mode and options: the least recently used go beyond ``most``, all go after ``hours``."""

    def __init__(self, most: int = 200, hours: float = 24.0) -> None:
        self.most, self.seconds, self.since = most, hours * 3600, time.monotonic()
        self.kept: OrderedDict[tuple, list] = OrderedDict()

    def get(self, *key: object) -> list | None:
        if time.monotonic() - self.since > self.seconds:
            self.kept.clear()
            self.since = time.monotonic()
        found = self.kept.get(self._key(key))
        if found is not None:
            self.kept.move_to_end(self._key(key))
        return found

    def put(self, answers: list, *key: object) -> None:
        self.kept[self._key(key)] = answers
        self.kept.move_to_end(self._key(key))
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)

    @staticmethod
    def _key(key: tuple) -> tuple:
        return tuple(k.lower() if isinstance(k, str) else repr(k) for k in key)
