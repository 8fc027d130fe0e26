"""Minimax contiguous partition of atomic groups into shards.

Groups (equal texts) are ordered: those larger than an even share of what
comes after them first, each a shard of its own, the others by content hash.
The smallest feasible shard
capacity is found by binary search, each trial checked greedily, over a
summary of bounded size: hash-prefix cells with their byte totals. Only cells
in which a cut can fall are then split by further digits, until each of them
is a single group, so that the capacity and the cuts are exact although no
list of all groups ever reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import stage, text_or_empty

#: Hex digits of the first summary (at most 16**4 cells) and of each split.
FIRST_DIGITS, MORE_DIGITS = 4, 2
#: Aimed-at rows of a numbering bucket, and the most buckets of a shard.
BUCKET_ROWS, MAX_BUCKETS = 4096, 8192


def _greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """First cell of each shard after the first, or None if it takes more."""
    cuts, at, start = [], 0, 0
    while at < len(ends):
        stop = bisect_right(ends, start + capacity)
        if stop == at:
            return None
        at, start = stop, ends[stop - 1]
        if at < len(ends):
            cuts.append(at)
            if len(cuts) == shards:
                return None
    return cuts


def _least_capacity(ends: list[int], shards: int, low: int) -> int:
    """Smallest capacity at which the greedy check passes, at least ``low``."""
    high = max(ends[-1], low)
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(capacity, hash at which each later shard begins) of ``groups(h, size)``.

    ``h`` is a hex digest. The driver holds at most 16**4 cells and the split
    cells around the cuts.
    """
    def cells(digits: int, within: list[str] | None = None) -> list[tuple]:
        part = groups if within is None else groups.filter(F.substring("h", 1, len(within[0])).isin(within))
        return [
            tuple(r)
            for r in part.groupBy(F.substring("h", 1, digits).alias("p"))
            .agg(F.sum("size").alias("s"), F.max("size"), F.count(F.lit(1)), F.min("h"))
            .collect()
        ]

    known = sorted(cells(FIRST_DIGITS))
    if not known:
        return 0, []
    total, largest = sum(c[1] for c in known), max(c[2] for c in known)
    low = max(-(-total // shards), largest)
    while True:
        ends = list(accumulate(c[1] for c in known))
        high = _least_capacity(ends, shards, low)
        split, first, last = set(), 0, 0
        for _ in range(shards - 1):
            a = min(bisect_right(ends, first + low), len(known) - 1)
            b = min(bisect_right(ends, last + high), len(known) - 1)
            split.update(i for i in range(a, b + 1) if known[i][3] > 1)
            first, last = (ends[a - 1] if a else 0), ends[b]
        if not split or high == low:
            return high, [known[i][4] for i in _greedy(ends, high, shards)]
        finer = []
        for digits in sorted({len(known[i][0]) for i in split}):
            finer += cells(digits + MORE_DIGITS, [known[i][0] for i in split if len(known[i][0]) == digits])
        known = sorted([c for i, c in enumerate(known) if i not in split] + finer)


def giant_groups(groups: DataFrame, shards: int) -> list[str]:
    """Groups of ``groups(h, size)`` that exceed an even share, largest first.

    Each is measured against an even share of the bytes and shards that the
    larger ones leave, so there are fewer than ``shards`` while others remain.
    """
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    largest = groups.orderBy(F.desc("size"), "h").limit(shards).collect()
    found: list[str] = []
    for r in largest:
        if len(found) == shards or r["size"] * (shards - len(found)) <= total:
            break
        found.append(r["h"])
        total -= r["size"]
    return found


def shard_by_bytes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 8
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: the largest shard is as small as contiguous runs of atomic
    groups of equal texts allow, in the order of the module's docstring, and
    the shards beside a group larger than an even share are as near equal as
    if it were not there. A null text has no bytes
    (size 1, CRC of nothing) and shares its group with empty texts. Slots
    number each shard's rows from 0 without gaps; among repeated rows the
    numbers are dealt arbitrarily but once each. Null ids are rows like any
    other. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    rows = stage(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("h"),
        ),
        "shard-rows",
    )
    groups = stage(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    giants = giant_groups(groups, shards)
    _, cuts = minimax_cuts(groups.filter(~F.col("h").isin(giants)), shards - len(giants))
    shard = sum(((F.col("h") >= F.lit(c)).cast("int") for c in cuts), F.lit(len(giants)))
    for i, h in enumerate(giants):
        shard = F.when(F.col("h") == h, i).otherwise(shard)
    buckets = max(1, min(MAX_BUCKETS, rows.count() // BUCKET_ROWS))
    placed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        shard.alias("shard"),
        F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("n", F.row_number().over(inside))
        # at most shards * MAX_BUCKETS rows
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("offset") + F.col("n") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
