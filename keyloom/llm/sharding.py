"""Sharding by Karmarkar-Karp differencing.

Rows of equal text are a group that stays together. A group is a partial
partition whose one filled part is its size; over and over, the two partial
partitions of the largest spread are combined with their parts oppositely
ordered, largest with smallest. Groups are dealt by hash into blocks of bounded
size, each differenced by a task of its own; the blocks' partial partitions are
combined the same way, by FAN in a task, until the driver combines the last,
which is but the upper part of one tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

#: Bytes counted for a row besides its text.
ROW_BYTES = 16
#: Rows, about, whose groups one task differences.
BLOCK_ROWS = 100_000
#: Partial partitions that one task, or the driver, combines.
FAN = 1000


def difference(sizes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of each item, sum of each part) for items that are single sizes or rows of `parts` sums; parts come in descending order of their sums.

    For rows, the first result gives for each of a row's columns the part that it goes to.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros((0,) if sizes.ndim == 1 else (0, parts), np.int64), np.zeros(parts, np.int64)
    single = sizes.ndim == 1
    sums: list[np.ndarray | None] = [None] * n
    tree: list[tuple[int, int, np.ndarray]] = []
    orders = None
    if not single:
        orders = np.argsort(-sizes, axis=1, kind="stable")
        for i in range(n):
            sums[i] = sizes[i][orders[i]]
    spread = sizes if single else sizes.max(axis=1) - sizes.min(axis=1)
    heap = [(-int(s), i) for i, s in enumerate(spread)]
    heapq.heapify(heap)

    def load(i: int) -> np.ndarray:
        if sums[i] is None:
            row = np.zeros(parts, dtype=np.int64)
            row[0] = sizes[i]
            return row
        return sums[i]

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = load(a) + load(b)[::-1]
        order = np.argsort(-both, kind="stable")
        sums[a] = sums[b] = None
        sums.append(both[order])
        tree.append((a, b, order.astype(np.int16)))
        heapq.heappush(heap, (int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    last = len(sums) - 1
    total = load(last)
    out = np.zeros(n, np.int64) if single else np.zeros((n, parts), np.int64)
    places = {last: np.arange(parts)}  # of each part of a node, the final part
    for k in range(len(tree) - 1, -1, -1):
        a, b, order = tree[k]
        final = np.empty(parts, dtype=np.int64)
        final[order] = places.pop(n + k)
        for node, own in ((a, final), (b, final[::-1])):
            if node >= n:
                places[node] = own
            elif single:
                out[node] = own[0]
            else:
                out[node][orders[node]] = own
    if n == 1 and not single:
        out[0][orders[0]] = np.arange(parts)
    return out, total


def _facts(docs: DataFrame, text: str) -> DataFrame:
    """docs (without their text) with size, text_crc32 and a 128-bit hash of the text; a null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {"size": F.octet_length(body).cast("long") + ROW_BYTES, "text_crc32": F.crc32(body.cast("binary")), "_kl_h": F.xxhash64(body), "_kl_g": F.xxhash64(F.lit("second"), body)}
    ).drop(text)


def assign(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """docs, without text, with size, text_crc32, law, shard, slot and grown_shard; shards get nearly equal bytes.

    Equal texts, null counting as empty, stay in one shard. Slots run from 0 in
    each shard in ascending order of key, nulls first; among rows of one key in
    order of their text's hash, and among equal rows in any order. Columns of
    docs with those names are replaced; `_`-names of this operator are reserved.

    A text with many copies is one group, whose rows are summed before they are
    shuffled; only groups travel to the differencing, and at most `fan` times
    `shards` sums reach the driver. No task sorts a whole shard: rows
    are numbered within key ranges, and a shard's ranges are offset by counts.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    facts = C.written(_facts(docs, text), "facts")
    blocks = max(1, -(-facts.count() // block_rows))
    groups = facts.groupBy("_kl_h", "_kl_g").agg(F.sum("size").alias("bytes")).withColumn("block", F.pmod(F.xxhash64("_kl_h", F.lit("block")), F.lit(blocks)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for x in batches if len(x)]
        if not rows:
            return
        rows = pd.concat(rows)
        for block, own in rows.groupby("block"):
            own = own.sort_values(["bytes", "_kl_h", "_kl_g"], ascending=False)
            part, sums = difference(own["bytes"].to_numpy(), shards)
            yield pd.DataFrame({"_kl_h": own["_kl_h"], "_kl_g": own["_kl_g"], "block": block, "part": part, "bytes": own["bytes"]})

    parts = C.written(groups.repartition(blocks, "block").mapInPandas(work, "_kl_h long, _kl_g long, block long, part int, bytes long"), "parts")
    homes = parts.select("_kl_h", "_kl_g", "block", "part")
    sums, made = parts.groupBy("block", "part").agg(F.sum("bytes").alias("bytes")), [parts]
    while blocks > fan:
        blocks = -(-blocks // fan)
        step = C.written(_combined(sums, shards, blocks), "combined")
        made.append(step)
        homes = homes.join(step.select("block", "part", "above", "to"), ["block", "part"]).select("_kl_h", "_kl_g", F.col("above").alias("block"), F.col("to").alias("part"))
        sums = step.groupBy(F.col("above").alias("block"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
    found = sums.toArrow().to_pandas()
    own, final = _places(found, shards)
    places = [(int(b), p, int(final[i, p])) for i, b in enumerate(own) for p in range(shards)]
    homes = homes.join(C.local_table(spark, places, "block long, part int, shard int"), ["block", "part"]).select("_kl_h", "_kl_g", "shard")
    rows = C.written(facts.join(homes, ["_kl_h", "_kl_g"]), "placed")
    C.discard(facts, *made)

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _slots(rows, key, ranges).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")).drop("_kl_h", "_kl_g")


def _places(sums: pd.DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, for each of them and each of its parts the part that it goes to) from rows block, part, bytes."""
    own, at = np.unique(sums["block"].to_numpy(), return_inverse=True)
    table = np.zeros((len(own), shards), dtype=np.int64)
    table[at, sums["part"].to_numpy()] = sums["bytes"].to_numpy()
    return own, difference(table, shards)[0]


def _combined(sums: DataFrame, shards: int, above: int) -> DataFrame:
    """(block, part, above, to, bytes): blocks of partial partitions combined into `above` blocks."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        own, final = _places(rows, shards)
        rows["to"] = final[np.searchsorted(own, rows["block"].to_numpy()), rows["part"].to_numpy()]
        return rows[["block", "part", "above", "to", "bytes"]]

    return sums.withColumn("above", F.col("block") % above).groupBy("above").applyInPandas(work, "block long, part int, above long, to int, bytes long")


def _slots(rows: DataFrame, key: str, ranges: int) -> DataFrame:
    """rows with slot: the count of rows of the shard before it."""
    dealt = C.written(rows.repartitionByRange(ranges, F.col(key).asc_nulls_first()).withColumn("_kl_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("shard").orderBy("_kl_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_kl_range").agg(F.count("*").alias("n")).withColumn("_kl_first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "_kl_range").orderBy(F.col(key).asc_nulls_first(), "_kl_h")
    return dealt.withColumn("_kl_at", F.row_number().over(within) - 1).join(counts, ["shard", "_kl_range"]).withColumn("slot", (F.col("_kl_first") + F.col("_kl_at")).cast("long")).drop("_kl_first", "_kl_at", "_kl_range")

