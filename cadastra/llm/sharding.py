"""Shards of near equal bytes by Karmarkar-Karp differencing over indivisible groups.

A partial partition is a tuple of ``shards`` sums. Differencing takes the two partial partitions of
largest spread and adds them in opposite order, largest sums to smallest, until one is left. Groups
are dealt by hash to buckets, each bucket is differenced in its own task, and the partial partitions
that the buckets leave, one small tuple for each, are differenced in the same way on the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ranked, renamed, shuffle_width, utf8_length


def difference(partials: Sequence[Sequence[int]]) -> tuple[list[int], np.ndarray]:
    """Sums of the last partial partition, and slots[i, j]: where slot j of partial partition i ended.

    Ties of spread go to the earlier, so the result follows from the order given.
    """
    shards = len(partials[0])
    slots = np.tile(np.arange(shards), (len(partials), 1))
    held: dict[int, list[int]] = {i: [i] for i in range(len(partials))}
    sums = {i: list(map(int, p)) for i, p in enumerate(partials)}
    heap = [(min(s) - max(s), i) for i, s in sums.items()]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        if len(held[a]) < len(held[b]):
            a, b = b, a
        up = sorted(range(shards), key=lambda j: (sums[a][j], j))
        down = sorted(range(shards), key=lambda j: (-sums[b][j], j))
        to = np.empty(shards, dtype=np.int64)
        to[down] = up
        for j in range(shards):
            sums[a][to[j]] += sums[b][j]
        mine = held.pop(b)
        slots[mine] = to[slots[mine]]
        held[a] += mine
        del sums[b]
        heapq.heappush(heap, (min(sums[a]) - max(sums[a]), a))
    last = heap[0][1]
    return sums[last], slots


def differenced(sizes: Sequence[int], shards: int) -> np.ndarray:
    """The shard of each group of ``sizes``; larger groups first, then as given."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    _, slots = difference([[int(sizes[i])] + [0] * (shards - 1) for i in order])
    out = np.empty(len(sizes), dtype=np.int64)
    out[order] = slots[:, 0]
    return out


def shard(df: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, size (UTF-8 bytes and 1), text_crc32, shard (int) and slot (long, gapless from 0 in a shard).

    Rows of equal texts form a group and share a shard; null texts form a group of their own, of size 1
    a row. Rows with null or repeated ids each count and get a slot. Other columns are ignored.
    A group's rows are summed before they meet, and no task sees more than its bucket's groups.
    """
    spark = df.sparkSession
    source = renamed(df, [id_column, text_column])
    text = F.col(f"in_{text_column}")
    rows = durable(
        source.select(
            F.col(f"in_{id_column}"),
            (utf8_length(text) + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("_key"),
        )
    )
    groups = rows.groupBy("_key").agg(F.sum("size").alias("bytes")).withColumn("bucket", F.pmod(F.xxhash64("_key"), F.lit(shuffle_width(spark))).cast("int"))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable").reset_index(drop=True)
        pdf["part"] = differenced(pdf["bytes"].to_numpy(), shards).astype("int32")
        return pdf

    parts = durable(groups.groupBy("bucket").applyInPandas(within, "_key binary, bytes long, bucket int, part int"))
    sums: dict[int, list[int]] = {}
    for bucket, part, n in parts.groupBy("bucket", "part").agg(F.sum("bytes")).collect():  # shards for each bucket
        sums.setdefault(bucket, [0] * shards)[part] = n
    at = sorted(sums)
    slots = difference([sums[b] for b in at])[1] if at else []
    moves = spark.createDataFrame([(b, j, int(slots[i][j])) for i, b in enumerate(at) for j in range(shards)], "bucket int, part int, shard int")
    placed = parts.join(F.broadcast(moves), ["bucket", "part"]).select("_key", "shard")
    dealt = durable(rows.join(placed, "_key").select(f"in_{id_column}", "size", "text_crc32", "shard"))
    salts = max(32, shuffle_width(spark))
    out = ranked(dealt, ["shard"], [f"in_{id_column}", "text_crc32", "size"], "slot", salts)
    return out.withColumnRenamed(f"in_{id_column}", id_column)
