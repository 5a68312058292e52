"""Minimax contiguous sharding by bytes (operator 6).

Groups of equal texts are atomic and ordered by a 64-bit hash of the text. The smallest shard capacity for which
a greedy sweep needs no more than the wanted shards is found by binary search, and the sweep's cuts
are the shards' bounds. The groups are too many for the driver, so it sees intervals of the hash space: first
2**first_bits equal ones, then, again and again, only those near a cut, split finer, until those hold single groups. So the
binary search has the result that it would have over all groups.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.llm.common import discard, materialise, table

TOP = 1 << 64


def sweep(ends: list[int], capacity: int, most: int) -> list[int]:
    """Greedy cuts, at most `most`: each shard takes groups while they fit. A group above the capacity stands alone."""
    at, cuts = 0, []
    while len(cuts) < most:
        at = max(at + 1, bisect_right(ends, ends[at] + capacity) - 1)
        if at >= len(ends) - 1:
            break
        cuts.append(at)
    return cuts


def running(sizes: list[int]) -> list[int]:
    return [0, *accumulate(sizes)]


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The least capacity for which `sizes`, in order, fill at most `shards` shards; and where the greedy sweep cuts.

    A group larger than an even share gets a shard of its own and doesn't raise the others' capacity.
    The cuts are the positions at which a new shard starts, without 0.
    """
    ends = running(sizes)
    low, high = 0, ends[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if len(sweep(ends, mid, shards)) < shards else (mid + 1, high)
    return low, sweep(ends, low, shards)


def least_capacity(total: int, sizes: list[int], shards: int) -> int:
    """No sweep can do with less: an even share of what stays when the largest stand alone. sizes: of intervals, each of which might be one group."""
    rest, left = total, shards
    for size in sorted(sizes, reverse=True):
        if left < 2 or size * left <= rest:
            break
        rest, left = rest - size, left - 1
    return -(-rest // left)


def near(ends: list[int], least: int, capacity: int, shards: int) -> set[int]:
    """Positions of intervals in which a cut can lie, for any capacity from `least` to `capacity`, and of those that might hold a group above it."""
    found, last, high = {k for k in range(len(ends) - 1) if ends[k + 1] - ends[k] > least}, len(ends) - 2, 0
    for cut in [*sweep(ends, least, shards), last]:
        high = max(high + capacity, ends[cut])
        found |= set(range(cut - 1, min(last, bisect_right(ends, high)) + 1))
    return {k for k in found if 0 <= k <= last}


def split(groups: DataFrame, known: dict[int, tuple[int, int, bool]], starts: list[int], step_bits: int) -> dict[int, tuple[int, int, bool]]:
    """The given intervals cut into 2**step_bits each (as far as 64 bits go); they may differ in width."""
    spans = [(64 - (known[s][0] - s).bit_length() + 1, s) for s in starts]
    # (bits, the interval's leading bits); no two intervals overlap, so a group is in one at most
    tops = groups.sparkSession.createDataFrame([(bits, s >> (64 - bits), min(64, bits + step_bits)) for bits, s in spans], "bits int, top bigint, then int")
    wide = [F.struct(F.lit(bits).alias("bits"), F.shiftrightunsigned("h", 64 - bits).alias("top")) for bits in sorted({bits for bits, _ in spans})]
    inside = groups.select("h", "size", F.explode(F.array(*wide)).alias("x")).select("h", "size", "x.*").join(F.broadcast(tops), ["bits", "top"])
    found = inside.groupBy("then", F.expr("if(then < 64, shiftrightunsigned(h, 64 - then), h)").alias("k")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
    out = {}
    for r in found.collect():
        width = TOP >> r["then"]
        start = r["k"] % TOP * width
        out[start] = (start + width, r["size"], r["low"] == r["high"])
    return out


def minimax_bounds(groups: DataFrame, shards: int, first_bits: int = 14, step_bits: int = 4, at_once: int = 20_000) -> list[int]:
    """Hash values (0 to 2**64) at which shards 1, 2, ... start; groups: (h bigint: its bits are the hash, size bigint), better a written table.

    Rows of one hash are one group. Intervals near a cut are split until only single groups are, so the bounds are those of a sweep over
    all groups. At most at_once intervals are split in a pass, those at the present cuts first; the others wait for the next.
    """
    width = TOP >> first_bits
    known: dict[int, tuple[int, int, bool]] = {}  # start -> end, size, is one group
    for r in groups.groupBy(F.shiftrightunsigned("h", 64 - first_bits).alias("k")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")).collect():
        known[r["k"] * width] = (r["k"] * width + width, r["size"], r["low"] == r["high"])
    while known:
        starts = sorted(known)
        sizes = [known[s][1] for s in starts]
        ends = running(sizes)
        capacity, cuts = smallest_capacity(sizes, shards)
        least = least_capacity(ends[-1], sizes, shards)
        open_ = [k for k in near(ends, least, capacity, shards) if not known[starts[k]][2]]
        if not open_:
            return [starts[c] for c in cuts]
        at = sorted([0, *cuts, *sweep(ends, least, shards)])
        open_.sort(key=lambda k: (sizes[k] <= least, min(abs(k - at[i]) for i in (bisect_right(at, k) - 1, min(bisect_right(at, k), len(at) - 1)))))
        some = [starts[k] for k in open_[:at_once]]
        finer = split(groups, known, some, step_bits)
        for s in some:
            del known[s]
        known |= finer
    return []


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Every row of docs to a shard: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law `bytes`).

    size: UTF-8 bytes of the text and `overhead`. Equal texts (null and empty are equal) share a shard; rows repeated whole
    get a slot each. Slots are gapless from 0 in a shard. An empty table gives an empty result. All texts equal: one shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(docs.select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    groups = materialise(rows.groupBy("h").agg(F.sum("size").alias("size")))
    bounds = minimax_bounds(groups, shards)
    discard(groups)
    # signed hashes order as unsigned ones once the top bit is flipped
    signed = F.array(*[F.lit(b - (TOP >> 1)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    flipped = F.col("h").bitwiseXOR(F.lit(-(TOP >> 1)))
    placed = rows.withColumn("shard", F.size(F.filter(signed, lambda b: b <= flipped)).cast("int"))
    # rows lie in one order within a partition; a shard's slots run through the partitions, in their order
    placed = placed.sortWithinPartitions("shard", "doc_id", "h", "size").withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    runs = placed.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.withColumn("part", part).join(runs, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
