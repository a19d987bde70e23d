"""Sharding by the smallest feasible capacity over contiguous groups; DataFrame functions only.

Equal texts form one atomic group. Groups are ordered by the 64-bit hash of their text, and a shard is a run of that order. The
smallest capacity for which a greedy fill needs at most `shards` runs is found by binary search over prefix sums. The sums come
from Spark as totals of hash ranges: at most `RANGES` of them reach the driver at a time, whatever the number of rows. A range
counts as divisible for the lower bound of the capacity and as one block for the upper bound; ranges in which a cut can fall are
split again until both bounds and all cuts agree, so the capacity is exact.

Rows: null text counts as the empty text (0 bytes, crc 0) and shares its group; null doc_id stays a row; repeated rows are rows of
their own with slots of their own; an empty table gives no rows; texts of any length count by their bytes only. Further columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherflow.llm.common import checkpoint, pieces

RANGES = 1 << 16          # hash ranges whose totals the driver holds at once
WINDOW_ROWS = 20_000      # rows numbered together by one window group, on average


@dataclass(frozen=True)
class Cuts:
    capacity: int
    starts: list[int]     # hash at which each shard after the first begins


def _greedy(ends: list[int], capacity: int, shards: int, whole: list[bool], fluid: bool) -> list[int]:
    """Positions in bytes where greedy shards end. In the fluid reading a divisible range may be cut anywhere."""
    out, at, total = [], 0, ends[-1]
    while at < total and len(out) < shards:
        j = bisect.bisect_right(ends, at + capacity)
        reach = ends[j - 1] if j else 0
        if fluid and j < len(ends) and not whole[j]:
            reach = at + capacity
        if reach <= at:
            break
        out.append(reach)
        at = reach
    return out


def _smallest(ends, whole, shards, fluid, low, high):
    """Smallest capacity in (low, high] that `shards` runs can hold; high is known to do."""
    while high - low > 1:
        mid = (low + high) // 2
        cut = _greedy(ends, mid, shards, whole, fluid)
        if cut and cut[-1] == ends[-1]:
            high = mid
        else:
            low = mid
    return high


def _totals(rows: DataFrame, bits: int):
    prefix = F.shiftright("h", 64 - bits) if bits < 64 else F.col("h")
    got = rows.groupBy(prefix.alias("p")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi")).collect()
    return sorted((r["lo"], r["s"], r["lo"] == r["hi"], r["p"], bits) for r in got)


def minimax_cuts(rows: DataFrame, shards: int, ranges: int = RANGES) -> Cuts:
    """Exact smallest capacity and its cuts for rows (h long: order and group, size long)."""
    bits = min(64, max(1, ranges.bit_length() - 1))
    parts = _totals(rows, bits)
    if not parts:
        return Cuts(0, [])
    while True:
        ends, run = [], 0
        for part in parts:
            run += part[1]
            ends.append(run)
        whole = [part[2] for part in parts]
        low = _smallest(ends, whole, shards, True, 0, ends[-1])
        high = _smallest(ends, whole, shards, False, low - 1, ends[-1])
        early, late = _greedy(ends, low, shards, whole, False), _greedy(ends, high, shards, whole, True)
        open_parts: set[int] = set()
        for i, to in enumerate(late[:-1] if late and late[-1] == ends[-1] else late):
            a = early[i] if i < len(early) else (early[-1] if early else 0)
            first, last = bisect.bisect_right(ends, a), bisect.bisect_left(ends, to)
            if to > a or low < high:
                open_parts.update(j for j in range(max(0, first - 1), min(last + 1, len(parts))) if not whole[j])
        if low == high and not open_parts:
            return Cuts(high, _even(parts, ends, high, shards))
        if not open_parts:
            open_parts = {j for j in range(len(parts)) if not whole[j]}
        by_bits: dict[int, list[int]] = {}
        for j in open_parts:
            by_bits.setdefault(parts[j][4], []).append(j)
        fresh = []
        for was, members in by_bits.items():
            more = max(1, (ranges // len(members)).bit_length() - 1)
            inside = F.shiftright("h", 64 - was).isin([parts[j][3] for j in members])
            fresh += _totals(rows.where(inside), min(64, was + more))
        parts = sorted([p for j, p in enumerate(parts) if j not in open_parts] + fresh)


def _even(parts, ends, capacity, shards) -> list[int]:
    """Cuts of that capacity, each moved as near to an equal share as it allows, so that no shard stays empty without need."""
    total, floors, at = ends[-1], [], ends[-1]
    for _ in range(shards):            # smallest end of each earlier shard from which the rest still fits
        j = bisect.bisect_left(ends, at - capacity)
        at = 0 if at <= capacity else ends[j]
        floors.append(at)
    floors = floors[::-1][1:]
    starts, at = [], 0
    for i, floor in enumerate(floors, 1):
        j = bisect.bisect_right(ends, min(at + capacity, total * i // shards))
        at = max(floor, ends[j - 1] if j else 0, at)
        nxt = bisect.bisect_right(ends, at)
        starts.append(parts[nxt][0] if nxt < len(parts) else None)
    return [s for s in starts if s is not None]


def with_hash(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, bytes of the text plus 8 (size), its crc (text_crc32) and its order and group (h)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))


def shard(docs: DataFrame, shards: int = 24, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot (gapless from 0 in each shard), grown_shard (null under this law)."""
    rows = checkpoint(with_hash(docs, ["doc_id"]).withColumn("row", F.monotonically_increasing_id()))
    return slots(rows, minimax_cuts(rows, shards, ranges), shards)


def slots(rows: DataFrame, cuts: Cuts, shards: int) -> DataFrame:
    """Number the rows of each shard. A shard is split by its rows' stored number, so neither equal texts nor repeated rows pile up."""
    at = F.lit(0)
    for start in cuts.starts:
        at = at + (F.col("h") >= F.lit(start)).cast("int")
    salts = pieces(rows.count(), WINDOW_ROWS)
    salted = rows.withColumns({"shard": at.cast("int"), "salt": F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")})
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("shard", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("h", "doc_id", "row")) - 1
    numbered = salted.withColumn("local", local).join(sums, ["shard", "salt"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("local")).cast("long").alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
