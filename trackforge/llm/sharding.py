"""Sharding by minimax contiguous partition of atomic groups.

Groups are rows of equal text, in the order of their text's SHA-256. The smallest shard capacity for which a greedy
fill needs no more than the wanted number of shards is found by binary search, and the shards are cut there.

Group sizes never reach the driver as a whole. The driver keeps sums over ranges of the order: 4,096 at first, then
another 4,096 within each of the few ranges in which a cut can still fall, until no sum is left open that could
change the capacity. Each refinement is one scan with partial aggregation, so that a group of a third of all rows
costs a task no more than any other rows; their number grows with the logarithm of the number of groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackforge.llm.durable import materialise

STEP = 3  # hexadecimal digits by which a range is refined
DIGITS = 64


@dataclass(frozen=True)
class Range:
    """A contiguous range of groups: all those whose digest begins with prefix; whole if it is a single group."""

    prefix: str
    size: int
    whole: bool


def _fill(ranges: list[Range], capacity: int, split: bool) -> list[int] | None:
    """Greedy fill: numbers of the ranges at which a new shard begins; None if a range alone is too large.

    split: a range of several groups may be cut anywhere, so the fill needs at most as many shards as the truth;
    else it is moved as one, so it needs at least as many.
    """
    cuts, room = [], capacity
    for i, r in enumerate(ranges):
        if split and not r.whole:
            left = r.size - room
            while left > 0:
                cuts.append(i)
                left -= capacity
            room = -left if r.size > room else room - r.size
        else:
            if r.size > capacity:
                if not split:
                    return None
                return [i] * (10**6 if len(ranges) else 0)
            if r.size > room:
                cuts.append(i)
                room = capacity
            room -= r.size
    return cuts


def _smallest(ranges: list[Range], shards: int, split: bool) -> int:
    """Smallest capacity with which the greedy fill needs at most so many shards."""
    total = sum(r.size for r in ranges)
    low, high = max(0, (total - 1) // shards), max(total, 1)  # low isn't enough, high is
    while high - low > 1:
        middle = (low + high) // 2
        cuts = _fill(ranges, middle, split)
        low, high = (low, middle) if cuts is not None and len(cuts) < shards else (middle, high)
    return high


def _open(ranges: list[Range], least: int, most: int, shards: int) -> list[str]:
    """Prefixes of the ranges in which a cut can fall for a capacity from least to most, if they have several groups."""
    early, late = _fill_from(ranges, least), _fill(ranges, most, True) or []
    found = {r.prefix for r in ranges if not r.whole and r.size > least}
    for k in range(shards):
        a = early[k] if k < len(early) else len(ranges) - 1
        b = late[k] if k < len(late) else len(ranges) - 1
        found |= {r.prefix for r in ranges[max(0, min(a, b) - 1) : max(a, b) + 1] if not r.whole}
    return sorted(found)


def _fill_from(ranges: list[Range], capacity: int) -> list[int]:
    """The fill that moves ranges as one, with those that are too large on their own getting a shard each."""
    cuts, room = [], capacity
    for i, r in enumerate(ranges):
        if r.size > room and room < capacity:
            cuts.append(i)
            room = capacity
        room = max(0, room - r.size)
    return cuts


def cut_points(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and the digest prefixes at which shards 1, 2, ... begin. groups: digest, size."""

    def summed(depth: int, within: list[str] | None) -> list[Range]:
        rows = groups
        if within is not None:
            rows = rows.where(F.substring("digest", 1, depth - STEP).isin(within))
        rows = rows.groupBy(F.substring("digest", 1, depth).alias("prefix")).agg(F.sum("size").alias("size"), F.min("digest").alias("a"), F.max("digest").alias("b"))
        return sorted((Range(r.prefix, r.size, r.a == r.b) for r in rows.collect()), key=lambda r: r.prefix)

    ranges = summed(STEP, None)
    while ranges:
        least, most = _smallest(ranges, shards, True), _smallest(ranges, shards, False)
        if least >= most:
            break
        within = _open(ranges, least, most, shards)
        if not within:
            break
        finer: dict[str, list[Range]] = {}
        for depth in sorted({len(p) for p in within}):
            for r in summed(depth + STEP, [p for p in within if len(p) == depth]):
                finer.setdefault(r.prefix[:depth], []).append(r)
        ranges = [x for r in ranges for x in (finer[r.prefix] if r.prefix in finer and not r.whole else [r])]
    if not ranges:
        return 0, []
    capacity = _smallest(ranges, shards, False)
    return capacity, [ranges[i].prefix for i in _fill(ranges, capacity, False)]


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its shard, from 0, and its slot there, gapless from 0 in the order of digest and id.

    size: bytes of the text in UTF-8 plus 1. A null text has size 1, no checksum, and forms a group with the other
    null texts; an empty text is a group of its own. Rows that repeat an id are kept, each with its own slot. Equal
    texts are never parted, so a group larger than an even share makes its shard larger. An empty table gives no rows;
    with fewer groups than shards some shards stay empty. Columns other than id and text aren't read.
    """
    text = F.col(text_col)
    base = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("0" * DIGITS)).alias("digest"),
        )
    )
    _, cuts = cut_points(base, shards)
    number = sum((F.when(F.col("digest") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = materialise(
        base.repartitionByRange("digest", "doc_id")
        .sortWithinPartitions("digest", "doc_id")
        .select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    )
    # One row for each partition and shard: both are bounded by the cluster, not by the data.
    counts = sorted(placed.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect(), key=lambda r: (r.shard, r.part))
    shifts, filled = [], {}
    for r in counts:
        shifts.append((r.part, r.shard, filled.get(r.shard, 0) - r.first))
        filled[r.shard] = filled.get(r.shard, 0) + r.n
    shifts = docs.sparkSession.createDataFrame(shifts, "part int, shard int, shift long")
    return placed.join(F.broadcast(shifts), ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot"))
