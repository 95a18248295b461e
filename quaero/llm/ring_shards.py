"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of slots, each owned by the next virtual node clockwise. A document hashes to
a slot; its preferences are the distinct shards met clockwise from there. Every shard has a capacity; documents that
find it full go on to their next preference. Which documents go on is decided by their place on the ring, so the
whole allocation follows from the number of documents in each slot: that table has a fixed size, is computed by one
map-side aggregation over the ids, and is the only thing the driver sees. Ranks inside a slot are a window over
that slot alone, so no task ever holds a shard, and slots hold equal shares whatever the ids look like.

Capacities are floor(n / shards), and one more for the first n mod shards, so the row counts of any two shards differ by
one at most (law ``rows``). Adding a shard moves the documents whose slot it takes over and the small overflow.

Defined results: null text has size 1 and checksum 0; null ids hash like any other value; rows equal in
id and text are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: 2^14 slots: a bound of the driver's table, of the broadcast plan (at most SLOTS * shards rows) and of nothing else.
SLOT_BITS = 14
VIRTUAL_NODES = 96


def preferences(n_shards: int, virtual_nodes: int = VIRTUAL_NODES, slot_bits: int = SLOT_BITS) -> list[list[int]]:
    """For each slot of the ring, all shards in the order met clockwise."""
    slots = 1 << slot_bits
    owners: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            at = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % slots
            owners.setdefault(at, shard)
    for shard in range(n_shards):  # a shard all of whose virtual nodes fell on taken slots gets the next free one
        if shard not in owners.values():
            owners[next(s for s in range(slots) if s not in owners)] = shard
    ring = sorted(owners.items())
    order: list[list[int]] = []
    following = 0
    for slot in range(slots):
        while following < len(ring) and ring[following][0] < slot:
            following += 1
        if order and slot - 1 not in owners:
            order.append(order[-1])
        else:
            order.append(list(dict.fromkeys(ring[(following + i) % len(ring)][1] for i in range(len(ring)))))
    return order


def allocate(counts: dict[int, int], order: list[list[int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, end rank, shard, place of the first in the shard): runs of a slot's documents.

    Round r offers every document still without a place to the r-th preference of its slot, in ring order; a shard
    takes them while it has room.
    """
    load = [0] * len(capacity)
    waiting = [(slot, 0) for slot in sorted(counts)]
    runs = []
    for r in range(len(capacity)):
        left = []
        for slot, start in waiting:
            shard = order[slot][r]
            took = min(counts[slot] - start, capacity[shard] - load[shard])
            if took:
                runs.append((slot, start, start + took, shard, load[shard]))
                load[shard] += took
            if start + took < counts[slot]:
                left.append((slot, start + took))
        waiting = left
    assert not waiting, "capacities must hold all documents"
    return runs


def shard_documents(docs: DataFrame, n_shards: int = 8, virtual_nodes: int = VIRTUAL_NODES, capacity_slack: float = 0.0) -> DataFrame:
    """Adds nothing to ``docs``; returns (doc_id, size, text_crc32, shard, slot) for every row.

    ``capacity_slack`` 0 gives exactly balanced row counts; a larger share leaves more documents at home.
    """
    spark = docs.sparkSession
    ring = F.xxhash64("doc_id")
    counts = {r.at: r.n for r in docs.groupBy(F.shiftrightunsigned(ring, 64 - SLOT_BITS).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    capacity = [int((n // n_shards + (s < n % n_shards)) * (1 + capacity_slack)) for s in range(n_shards)]
    runs = allocate(counts, preferences(n_shards, virtual_nodes), capacity)
    plan = spark.createDataFrame(runs or [(-1, 0, 0, 0, 0)], "at long, start long, end long, shard int, base long")
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        ring.alias("position"),
        F.shiftrightunsigned(ring, 64 - SLOT_BITS).alias("at"),
    )
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy("position", "doc_id", "text_crc32", "size")) - 1)
    placed = ranked.join(F.broadcast(plan), (ranked["at"] == plan["at"]) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("start")).cast("long").alias("slot"))
