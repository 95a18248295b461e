"""Merkle fixity audit of archived records.

Pages become archive records; a manifest of the primary copy gives each a place: archive file, number, byte offset and length. The
digests of 16 neighbouring records, or ranges of records, make the digest of the range above, up to one root for each archive and one
for all archives. A replica is hashed into the same places. The audit compares the roots and goes down into ranges that
differ, so equal branches cost one comparison at their top.

An archive is a range of ids, so records never move between archives and an archive is a bounded group as long as ids are few
times repeated; what a record's number is, its offset and its digest are windows and aggregates over one archive.

Defined results: null url or body count as empty; null ids make an archive of their own, last; records that share an id are
ordered by url, then digest; a record that the replica lacks, or has beyond the primary, differs; extra columns are ignored; with both sides
empty there are no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.llm.common import ready_to_checkpoint

FANOUT = 16
RECORDS_PER_ARCHIVE = 256


def record(page_id: Column, url: Column, body: Column) -> Column:
    """One WARC record as a string."""
    text = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, text, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame) -> DataFrame:
    """(archive, seq, page_id, offset, length, digest): the place and digest of every record."""
    made = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    archive = F.coalesce(F.floor(F.col("page_id") / RECORDS_PER_ARCHIVE), F.lit((1 << 55) - 1)).cast("long")
    hashed = made.select("page_id", "url", archive.alias("archive"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    order = Window.partitionBy("archive").orderBy("page_id", "url", "digest")
    running = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return hashed.select("archive", (F.row_number().over(order) - 1).cast("long").alias("seq"), "page_id", F.coalesce(running, F.lit(0)).alias("offset"), "length", "digest")


def _level(below: DataFrame) -> DataFrame:
    """The ranges above: digests of FANOUT neighbours, in order, for both copies."""
    whole = lambda side: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", F.coalesce(side, F.lit("")).alias("d")))), lambda x: x["d"]), "\n"), 256)
    return below.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("up")).agg(whole("mine").alias("mine"), whole("theirs").alias("theirs")).withColumnRenamed("up", "node")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The primary's manifest, and what the replica has beyond it, with status ``ok``, ``corrupt``, ``missing`` or ``extra``."""
    ready_to_checkpoint(primary.sparkSession)
    a, b = manifest(primary), manifest(replica)
    # Places are the primary's: the n-th record of an id in one copy stands beside the n-th in the other.
    nth = Window.partitionBy("archive", "page_id").orderBy("seq")
    mine = a.withColumn("nth", F.row_number().over(nth)).withColumnRenamed("digest", "mine")
    theirs = b.withColumn("nth", F.row_number().over(nth)).select("archive", F.col("page_id").alias("id"), "nth", F.col("digest").alias("theirs"), F.col("length").alias("found"))
    beside = (F.col("page_id").eqNullSafe(F.col("id"))) & (F.col("x.archive") == F.col("y.archive")) & (F.col("x.nth") == F.col("y.nth"))
    both = mine.alias("x").join(theirs.alias("y"), beside, "full").select(
        F.coalesce("x.archive", "y.archive").alias("archive"), F.coalesce("x.page_id", "id").alias("page_id"), F.coalesce("x.nth", "y.nth").alias("nth"), "seq", "offset", F.coalesce("length", "found").alias("length"), "mine", "theirs"
    )
    place = Window.partitionBy("archive").orderBy(F.col("seq").isNull(), "seq", "page_id", "nth")
    leaves = both.withColumn("node", (F.row_number().over(place) - 1).cast("long")).checkpoint()
    size = leaves.agg(F.max("node").alias("node"), F.max("archive").alias("archive")).first()
    if size.node is None:
        return leaves.select("page_id", "archive", "seq", "offset", "length", F.col("mine").alias("digest"), F.lit("ok").alias("status"))
    levels = [leaves.select("archive", "node", "mine", "theirs")]
    top = size.node
    while top > 0:
        levels.append(_level(levels[-1]))
        top //= FANOUT
    # The tree over archives: their roots are the leaves of one tree more.
    roots = levels[-1].select(F.lit(0).alias("archive"), F.col("archive").alias("node"), "mine", "theirs")
    over = [roots]
    top = roots.agg(F.count(F.lit(1)).alias("n")).first().n
    while top > 1:
        over.append(_level(over[-1]))
        top = -(-top // FANOUT) if top > FANOUT else 1
    suspects = over[-1].where("mine <> theirs").select("archive", "node")
    differ = ~F.col("mine").eqNullSafe(F.col("theirs"))
    descend = lambda found, level: level.withColumn("up", F.floor(F.col("node") / FANOUT)).join(found.select("archive", F.col("node").alias("up")), ["archive", "up"], "left_semi").where(differ).select("archive", "node")
    suspects = reduce(descend, reversed(over[:-1]), suspects)
    suspects = suspects.select(F.col("node").alias("archive"), F.lit(0).cast("long").alias("node"))
    suspects = reduce(descend, reversed(levels[:-1]), suspects).withColumn("differs", F.lit(True))
    status = F.when(F.col("differs").isNull(), "ok").when(F.col("theirs").isNull(), "missing").when(F.col("mine").isNull(), "extra").otherwise("corrupt")
    return leaves.join(suspects, ["archive", "node"], "left").select("page_id", "archive", "seq", "offset", "length", F.col("mine").alias("digest"), status.alias("status"))
