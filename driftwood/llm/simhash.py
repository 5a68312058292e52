"""SimHash near-duplicates by deletion-variant signatures (operator 3).

Two 64-bit fingerprints that differ in at most 2 bits agree in one of their two 32-bit segments but for at most one
bit. Each distinct fingerprint is indexed by its segments as they are and by their variants with one bit taken out;
equality joins find the pairs, each is verified. A variant joins those that have the bit to those that lack it, so no pair comes
twice for one variant. Segments that many fingerprints share use keys that also hold part of the other segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.common import as_bytes, as_row, chunks, discard, materialise, table, text_of, with_text

SEED, WORDS, BITS = 42, 3, 64


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned; 0 for a text without words. Fewer than `words` words: all of them are the one shingle."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], ">u8")
    # in blocks, so that the unpacked bits of a very long text stay small
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (doc_id) and fp: the fingerprint's bits as a bigint. Null text has no words; other columns are not read."""
    keep = keep or ["doc_id"]

    def run(batches):
        for batch in chunks(batches):
            values = np.array([fingerprint(t, words) for t in as_bytes(text_of(batch, keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values)], [*keep, "fp"])

    return with_text(docs, keep).mapInArrow(run, docs.select(*keep).schema.add("fp", "long"))


def _keys(fps: DataFrame) -> DataFrame:
    """(fp, key, place, bit): 33 rows for each of two segments; place 32 is the segment as it is."""
    cut = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("segment")).select("fp", "segment", F.expr("shiftrightunsigned(fp, 32 * segment) & 4294967295L").alias("value"))
    at = cut.select("fp", "segment", "value", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("place"))
    return at.select(
        "fp",
        F.expr("shiftleft(cast(segment as bigint), 38) | shiftleft(cast(place as bigint), 32) | (value & ~(if(place < 32, shiftleft(1L, place), 0L)))").alias("key"),
        "place",
        F.expr("if(place < 32, shiftright(value, place) & 1L, 0L)").alias("bit"),
    )


def _other(fp: str = "fp", key: str = "key") -> Column:
    """The segment that a key is not about."""
    return F.expr(f"shiftrightunsigned({fp}, if(shiftright({key}, 38) = 0, 32, 0)) & 4294967295L")


def _pairs(keys: DataFrame, extra: list[str], most: int) -> DataFrame:
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    side = lambda name, where: keys.where(where).select("key", *extra, F.col("fp").alias(name))
    on = ["key", *extra]

    def joined(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
        r = right.select(*[F.col(c).alias(f"r_{c}") for c in on], "b")
        match = near
        for c in on:
            match = match & (F.col(c) == F.col(f"r_{c}"))
        # keys are many times the fingerprints that Spark sizes them by: never to be sent to all tasks
        return left.join(r.hint("merge"), match & (F.col("a") < F.col("b")) if ordered else match).select("a", "b")

    equal = joined(side("a", "place = 32"), side("b", "place = 32"), True)
    return equal.unionByName(joined(side("a", "place < 32 and bit = 0"), side("b", "place < 32 and bit = 1"), False))


def near_pairs(fps: DataFrame, crowded: int = 1000) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints in fps (fp bigint, no repeats) that differ in 1 or 2 bits; may repeat.

    Keys of segments that more than `crowded` fingerprints share are refined: for equal segments the other one is cut in two again (one half
    differs by at most one bit); for segments that differ by a bit, the other one's halves are joined as they are
    (one is equal). A refined key leaves 17 bits open, so it holds a bounded number of fingerprints however many there are.
    """
    segments = fps.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), F.expr("fp & 4294967295L").alias("v")), F.struct(F.lit(1).alias("s"), F.expr("shiftrightunsigned(fp, 32)").alias("v")))).alias("x"), F.lit(1).alias("one"))
    full = materialise(segments.groupBy("x.s", "x.v").agg(F.count("one").alias("n")).where(F.col("n") > crowded))
    keys = _keys(fps)
    if full.isEmpty():
        return _pairs(keys, [], 2)
    # a fingerprint that stands for each crowded segment has all of that segment's keys
    stand_in = full.select(F.expr("shiftleft(v, 32 * s)").alias("fp"), "s")
    refined = _keys(stand_in.select("fp")).join(stand_in, "fp").where(F.shiftright("key", 38) == F.col("s")).select("key").distinct()
    flagged = keys.join(refined.withColumn("refined", F.lit(True)), "key", "left")
    plain, crowd = flagged.where("refined is null"), flagged.where("refined").withColumn("rest", _other())
    halves = crowd.select("fp", "key", "place", "bit", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"), "rest").withColumn("value", F.expr("shiftright(rest, 16 * half) & 65535L"))
    # place 32: 17 variants of the half, as it is and with one bit taken out; a variant's own bit decides the side
    equal = halves.where("place = 32").select("fp", "key", "half", "value", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("inner"))
    equal = equal.select("fp", "key", F.expr("shiftleft(cast(half as bigint), 40) | shiftleft(cast(inner as bigint), 32) | (value & ~(if(inner < 16, shiftleft(1L, inner), 0L)))").alias("sub"), F.expr("if(inner < 16, 0, 32)").alias("place"), F.expr("if(inner < 16, shiftright(value, inner) & 1L, 0L)").alias("bit"))
    apart = halves.where("place < 32").select("fp", "key", F.expr("shiftleft(cast(half as bigint), 40) | value").alias("sub"), "place", "bit")
    return _pairs(plain, [], 2).unionByName(_pairs(equal, ["sub"], 2)).unionByName(_pairs(apart, ["sub"], 2))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b bigint), root the least of the component: stars, large and small in turn."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, edges = edges, materialise(small.where("u <> v").distinct())
        discard(old)
        now = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def near_duplicates(docs: DataFrame, words: int = WORDS, crowded: int = 1000) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id: the smallest doc_id that links reach.

    Links join fingerprints at 2 or fewer differing bits, so texts without words are one component. Null doc_ids
    don't name a component: one of only such rows has component_id null. Repeated rows stay; an empty table gives an empty result.
    """
    linked = link(materialise(fingerprints(docs, words)), crowded)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def link(rows: DataFrame, crowded: int = 1000, often: int = 1000) -> DataFrame:
    """rows (doc_id, fp, ...; a written table) with component_id.

    Fingerprints that more than one in `often` rows have, less than `often` of them whatever the input, are sent to every task, so
    that their rows stay where they are; the others' rows are dealt by fingerprint.
    """
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    rooted = materialise(components(near_pairs(fps.select("fp"), crowded)))
    named = rooted.join(fps, rooted["node"] == fps["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    linked = rooted.join(named, "root").select(F.col("node").alias("fp"), "component")
    ids = materialise(fps.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n"))
    discard(rooted, fps)
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = F.broadcast(ids.where(F.col("n") > total // often).select("fp", "component_id"))
    # no side of these joins is bounded, so they are merge joins at every size
    few = rows.join(many.select("fp"), "fp", "left_anti").join(ids.where(F.col("n") <= total // often).select("fp", "component_id").hint("merge"), "fp")
    return rows.join(many, "fp").unionByName(few)


def keep_one(docs: DataFrame, words: int = WORDS, crowded: int = 1000) -> DataFrame:
    """One row of docs, all its columns, for each component: that of its smallest doc_id (of repeated ones, any).

    Rows without doc_id are kept only if their component has no others; then one of each fingerprint's.
    """
    tagged = materialise(fingerprints(as_row(docs, "doc_id"), words, ["row", "doc_id"]).withColumn("row_id", F.monotonically_increasing_id()))
    linked = link(tagged.select("row_id", "doc_id", "fp"), crowded)
    # the components of rows without any doc_id are told apart by fingerprint
    chosen = linked.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(F.min_by("row_id", F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("row_id"))
    return tagged.join(chosen.select("row_id").hint("merge"), "row_id", "left_semi").select("row.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
