"""Language-model scores by context-tree weighting (operator 10).

A byte is eight binary decisions, each with a context tree of its own over the bytes before it, up to DEPTH of them. Every node mixes its
own Krichevsky-Trofimov estimate with what its children say, in proportion to how well either would have coded the
training texts. The training counts are frozen when texts are scored, so that the probability of a byte depends on its
n-gram alone. Beside it, the add-one unigram score over words. Each batch of texts sends its distinct words, as hashes, and its
distinct n-grams to their buckets for counting, and gets counts and log probabilities back: a bucket has all n-grams below the contexts of
ROOT bytes that fall to it, so it works out their trees alone, but for the shortest contexts, which are summed from all buckets.
Counts are merged few batches at a time, answers are given batch by batch as they stream by, and there are the more buckets the more text there
is. No n-gram is left out, and none but those shortest contexts' sums are ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.common import CodeTable, Tally, as_bytes, block_sums, chunks, crc_fold, discard, joined, materialise, ngram_codes, packed, rows_at_once, run_lengths, table, training_codes, unpacked

DEPTH = 5
ROOT = 2
END = b""  # the end of a text, as a word


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8."""
    y = x + 8
    down = np.ones_like(x)
    for i in range(8):
        down *= x + i
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - np.log(down)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << (8 * n_bytes)) - 1)


def key(codes: np.ndarray, j: int) -> np.ndarray:
    """The node that decides on bit j (7 - j zeros behind it): the context's bytes, the newest lowest, then a byte that holds a one and the bits already known."""
    byte = codes & np.uint64(255)
    return (codes - byte) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))


def climb(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, deep: int, high: int):
    """Levels high to deep of (keys, estimate, weight of the own estimate, place in the level above), and what level high - 1 gets: (keys, zeros, ones, below).

    keys: all nodes at depth deep, in order; below: what their children say together (none: they are leaves).
    """
    levels = []
    for d in range(deep, high - 1, -1):
        block = kt_block(zeros, ones)
        own = np.ones(len(keys)) if below is None else 1 / (1 + np.exp(np.clip(below - block, -700, 700)))
        weighted = block if below is None else np.logaddexp(block, below) - math.log(2)
        parents, up = np.unique(keys & mask(d), return_inverse=True)
        levels.append((keys, (ones + 0.5) / (zeros + ones + 1), own, up))
        keys, zeros, ones, below = parents, *(np.bincount(up, x, len(parents)) for x in (zeros, ones, weighted))
    return levels[::-1], (keys, zeros, ones, below)


def spread(levels: list, carried=None):
    """Of each level (keys, probability of a one), and what the nodes of the last one hand down.

    The probability is what the root mixes if the path to it ends at this node; above a half it is held as minus its complement, which
    float32 keeps exact. carried: what the level above hands down to each node of the first one (none: that is the root's).
    """
    n = len(levels[0][0])
    mixed, mixed_zero, left = carried or (np.zeros(n), np.zeros(n), np.ones(n))
    nodes = []
    for i, (keys, estimate, own, up) in enumerate(levels):
        if i:
            mixed, mixed_zero, left = mixed[up], mixed_zero[up], left[up]
        one, zero = mixed + left * estimate, mixed_zero + left * (1 - estimate)
        nodes.append((keys, np.where(one <= zero, one, -zero).astype(np.float32)))
        share = left * own
        mixed, mixed_zero, left = mixed + share * estimate, mixed_zero + share * (1 - estimate), left * (1 - own)
    return nodes, (mixed, mixed_zero, left)


def leaves(codes: np.ndarray, n: np.ndarray, j: int):
    """The deepest nodes for bit j: keys, zeros, ones, and the node of each n-gram. codes: sorted."""
    keys = key(codes, j)
    new = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
    at = np.cumsum(new) - 1
    bit = ((codes >> np.uint64(7 - j)) & np.uint64(1)).astype(np.float64)
    kinds = int(new.sum())
    return keys[new], np.bincount(at, n * (1 - bit), kinds), np.bincount(at, n * bit, kinds), at


def roots_say(codes: np.ndarray, n: np.ndarray, depth: int, root: int):
    """What the trees below contexts of root bytes tell the nodes one byte higher: (keys, zeros, ones, below), of all eight bits."""
    up = [climb(*leaves(codes, n, j)[:3], None, depth, root)[1] for j in range(8)]
    return tuple(np.concatenate(x) for x in zip(*up, strict=True))


class Top:
    """The nodes of fewer than root bytes of context (at most 255 and 65,280 of them, whatever the input), of all eight bits."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, root: int):
        self.root, self.keys = root, keys
        self.nodes, self.handed = spread(climb(keys, zeros, ones, below, root - 1, 0)[0]) if root else ([], None)

    def to(self, keys: np.ndarray):
        """What is handed down to these nodes at depth root."""
        if not self.root:
            return None
        up = np.searchsorted(self.keys, keys & mask(self.root))
        return tuple(x[up] for x in self.handed)


def log10_probabilities(codes: np.ndarray, n: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """Of the newest byte of each n-gram after the others. codes: sorted and distinct, all that occur in training below the contexts of
    root bytes that they have, with how often they do; those with 0 are only asked for."""
    total, known = np.zeros(len(codes)), n > 0
    learned, new = codes[known], codes[~known]
    for j in range(8):
        keys, zeros, ones, at = leaves(learned, n[known].astype(np.float64), j)
        levels = climb(keys, zeros, ones, None, depth, top.root)[0]
        nodes = [*top.nodes, *spread(levels, top.to(levels[0][0]))[0]]
        p = np.full(len(codes), 0.5)
        p[known] = nodes[-1][1][at]
        want, open_ = key(new, j), np.flatnonzero(~known)
        for d in range(depth, -1, -1):
            keys, probability = nodes[d]
            if not len(open_):
                break
            if len(keys):
                asked = want & mask(d + 1)
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[at] == asked
                p[open_[hit]] = probability[at[hit]]
                open_, want = open_[~hit], want[~hit]
        one = ((codes >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        total += np.log10(np.where(one == (p >= 0), np.abs(p), 1 - np.abs(p)))
    return total


PARTS = "batch bigint, bucket int, hashes binary, counts binary, codes binary, learned binary, places binary, doc_ids binary, held binary, lengths binary, data binary"
WHOLE = -1
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def word_refs(texts: Iterable[bytes]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """The distinct words of lower-cased texts, numbered as they come; the words of all texts by number; and how many each text has."""
    seen: dict[bytes, int] = {END: 0}
    refs, tokens = [], []
    for text in texts:
        words = text.split()
        words.append(END)
        refs.append(np.array([seen.setdefault(w, len(seen)) for w in words], np.uint32))
        tokens.append(len(words))
    return seen, np.concatenate(refs), np.array(tokens, np.int64)


def score_parts(docs: DataFrame, depth: int, root: int, buckets: int) -> DataFrame:
    """One pass over (doc_id, text, held). Each batch of texts gives a row with its texts; and for each bucket a row with the hashes of that bucket's distinct words and its distinct n-grams,
    and how often each occurs in the batch's training texts. The n-grams of a bucket share the newest root bytes of context."""
    null_id = -(1 << 63)

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, 8 << 20):
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            tally = Tally()
            for part in chunks([batch], 1 << 20):
                tally.add(training_codes(part.column(1).filter(pc.invert(part.column(2))), depth, 1))
                codes, n = run_lengths(training_codes(part.column(1).filter(part.column(2)), depth, 1))
                tally.put(codes, n * 0)
            codes, learned = tally.total()
            codes = codes.astype(np.uint64)
            seen, refs, tokens = word_refs(text.lower() for text in as_bytes(batch.column(1)))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
            counts = np.bincount(refs[np.repeat(~held, tokens)], minlength=len(seen)).astype(np.int64)
            # refs count words as they came; places lead from that to their buckets' order
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((hashes, bucket))
            places = np.empty(len(order), np.uint32)
            places[order] = np.arange(len(order), dtype=np.uint32)
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            hashes, counts = hashes[order], counts[order]
            context = (codes >> np.uint64(8)) & mask(root)
            bucket = ((context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            code_bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            codes, learned = codes[order], learned[order].astype(np.int64)
            batch_key = (task << 24) + number
            number += 1
            ids = np.array([null_id if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            data, _, lengths = joined(batch.column(1), depth, 1)
            rows = [(batch_key, WHOLE, *[None] * 4, packed(places), ids.tobytes(), held.tobytes(), lengths.tobytes(), packed(data))]
            for b, (i, j, k, m) in enumerate(zip(bounds, bounds[1:], code_bounds, code_bounds[1:], strict=False)):
                if i < j or k < m:
                    rows.append((batch_key, b, stepped(hashes[i:j]), packed(counts[i:j]), stepped(codes[k:m]), packed(learned[k:m]), *[None] * 5))
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 9]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PARTS.split(", ")])

    return docs.select("doc_id", "text", "held").mapInArrow(run, PARTS)


COUNTED = "batch bigint, bucket int, hashes binary, counts binary, codes binary, learned binary"


def stepped(values: np.ndarray) -> bytes:
    """Sorted integers, packed by their differences."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def unstepped(steps: bytes) -> np.ndarray:
    return np.cumsum(unpacked(steps, np.uint64), dtype=np.uint64)


def bucket_models(parts: DataFrame, batches: int, depth: int, root: int, fan_in: int = 32) -> DataFrame:
    """One row a bucket: COUNTED of all batches, and what roots_say() of its n-grams.

    About fan_in rows are merged at a time, in rounds, so none holds a row of every batch. The last round also gives the reports: a second Python step in its tasks would
    need workers of its own.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words, grams = Tally(), Tally()
        for hashes, counts, steps, learned in zip(frame["hashes"], frame["counts"], frame["codes"], frame["learned"], strict=True):
            words.put(unstepped(hashes), unpacked(counts, np.int64))
            grams.put(unstepped(steps), unpacked(learned, np.int64))
        (hashes, counts), (codes, learned) = words.total(), grams.total()
        return pd.DataFrame([(frame["batch"].iloc[0], frame["bucket"].iloc[0], stepped(hashes), packed(counts), stepped(codes), packed(learned))], columns=["batch", "bucket", "hashes", "counts", "codes", "learned"])

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        row = run(frame)
        codes, n = unstepped(row["codes"].iloc[0]), unpacked(row["learned"].iloc[0], np.int64)
        keys, zeros, ones, below = roots_say(codes[n > 0], n[n > 0].astype(np.float64), depth, root)
        return row.assign(keys=packed(keys), zeros=zeros.tobytes(), ones=ones.tobytes(), below=below.tobytes())

    groups, place = max(1, -(-batches // fan_in)), None
    while groups > 1:
        place = F.pmod(F.xxhash64("batch"), F.lit(groups)) if place is None else F.expr(f"batch div {fan_in}")
        parts = parts.withColumn("batch", place).groupBy("bucket", "batch").applyInPandas(run, COUNTED)
        groups = -(-groups // fan_in)
    return parts.withColumn("batch", F.lit(0).cast("bigint")).groupBy("bucket").applyInPandas(last, COUNTED + ", keys binary, zeros binary, ones binary, below binary")


def top_of(models: DataFrame, root: int) -> Top:
    """What the buckets say to the shortest contexts, summed by key in Spark; at most 65,280 rows come to the driver."""

    def run(batches):
        for batch in batches:
            for keys, *values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(keys, np.uint64).astype(np.int64)), *(pa.array(np.frombuffer(v)) for v in values)], ["key", "zeros", "ones", "below"])

    said = models.select("keys", "zeros", "ones", "below").mapInArrow(run, "key bigint, zeros double, ones double, below double")
    below = F.aggregate(F.array_sort(F.collect_list("below")), F.lit(0.0), lambda a, x: a + x)  # in order: the same sum each time
    got = said.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), below.alias("below")).orderBy("key").toArrow()
    return Top(got["key"].to_numpy().astype(np.uint64), *(got[c].to_numpy() for c in ("zeros", "ones", "below")), root)


def buckets_for(n_bytes: int, least: int = 256, each: int = 64 << 20) -> int:
    """How many buckets so much text is dealt to: a power of two, at most one for each of the contexts of ROOT bytes."""
    return min(1 << 8 * ROOT, max(least, 1 << (-(-n_bytes // each) - 1).bit_length()))


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    """By bucket, a bucket's own row first, then its batches in order. As many partitions as the session sets, or one a bucket if those are more than the least number."""
    spread_ = df.repartition("bucket") if buckets <= 256 else df.repartition(buckets, "bucket")
    return spread_.sortWithinPartitions("bucket", F.col("batch").asc_nulls_first())


def lm_scores(docs: DataFrame, held, depth: int = DEPTH, buckets: int | None = None, fan_in: int = 32) -> DataFrame:
    """SCORES for every row of docs; held: a boolean Column, true for rows that are not learned from (null: true).

    Null texts are empty: one token, the end. Words are told apart by 64-bit hashes. Repeated rows stay and, outside the held-out
    ones, count each time; nothing to learn from gives counts of 0 and even bits. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(True)).alias("held"))
    root = min(ROOT, depth)
    if buckets is None:
        buckets = buckets_for(int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]))
    with rows_at_once(docs.sparkSession, 4000):
        parts = materialise(score_parts(rows, depth, root, buckets))
    asked = parts.where(F.col("bucket") != WHOLE).select("batch", "bucket", "hashes", "counts", "codes", "learned")
    models = materialise(bucket_models(asked, parts.where(F.col("bucket") == WHOLE).count(), depth, root, fan_in))
    spark = docs.sparkSession
    top = spark.sparkContext.broadcast(top_of(models, root))

    def answer(batches):
        """Row by row: a bucket's model, then for each batch that asked the training count of each word and the log probability of each n-gram. The bucket's totals go with the model's row."""
        names = ["batch", "bucket", "counts", "codes", "logs", "n", "kinds"]
        kinds_ = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 2]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                number, bucket, hashes, counts, codes, learned = (batch.column(k)[i].as_py() for k in range(6))
                if number is None:
                    words, total = unstepped(hashes), unpacked(counts, np.int64)
                    grams = unstepped(codes)
                    logs = log10_probabilities(grams, unpacked(learned, np.int64), depth, top.value).astype(np.float32)
                    out.append((None, bucket, None, None, None, int(total.sum()), int((total > 0).sum())))
                else:
                    out.append((number, bucket, packed(total[np.searchsorted(words, unstepped(hashes))]), codes, packed(logs[np.searchsorted(grams, unstepped(codes))]), 0, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_, strict=True)], names)

    none = F.lit(None).cast("binary")
    with_models = asked.unionByName(models.select(F.lit(None).cast("bigint").alias("batch"), *asked.columns[1:]))
    with rows_at_once(spark, 200):
        replies = materialise(dealt(with_models, buckets).mapInArrow(answer, "batch bigint, bucket int, counts binary, codes binary, logs binary, n bigint, kinds bigint"))
    discard(models)
    n, kinds = replies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    unit = math.log10(n + kinds + 1)
    null_id = -(1 << 63)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        whole = frame[frame["bucket"] == WHOLE].iloc[0]
        asked = frame[frame["bucket"] != WHOLE].sort_values("bucket")
        counts = np.concatenate([unpacked(c, np.int64) for c in asked["counts"]])[unpacked(whole["places"], np.uint32)]
        data, lengths = unpacked(whole["data"], np.uint8), np.frombuffer(whole["lengths"], np.int64)
        text_starts = np.cumsum(lengths + depth + 1) - lengths - 1
        _, refs, tokens = word_refs(data[i : i + k].tobytes() for i, k in zip(text_starts, lengths, strict=True))
        starts = np.cumsum(tokens) - tokens
        logs, known = np.log10(counts + 1.0)[refs], (counts > 0)[refs].astype(np.int64)
        ids = pd.Series(np.frombuffer(whole["doc_ids"], np.int64)).astype("Int64")
        return pd.DataFrame({
            "doc_id": ids.mask(ids == null_id), "held_out": np.frombuffer(whole["held"], bool), "n_tokens": tokens, "n_known": np.add.reduceat(known, starts), "train_tokens": int(n),
            "base_score": np.add.reduceat(logs, starts) - tokens * unit, "score": byte_scores(data, text_starts, lengths, asked, depth),
        })

    texts = parts.where(F.col("bucket") == WHOLE).select("batch", "bucket", *[none.alias(c) for c in ("counts", "codes", "logs")], *TEXTS)
    return texts.unionByName(replies.where("batch is not null").select("batch", "bucket", "counts", "codes", "logs", *[none.alias(c) for c in TEXTS])).groupBy("batch").applyInPandas(finish, SCORES)


TEXTS = ("places", "doc_ids", "held", "lengths", "data")


def byte_scores(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, asked: pd.DataFrame, depth: int) -> np.ndarray:
    """Log10 probability of each text of a batch (A-Z lower-cased, from depth zero bytes on) and a zero byte that ends it."""
    codes = np.concatenate([unstepped(c) for c in asked["codes"]])
    order = np.argsort(codes)
    codes, logs = codes[order], np.append(np.concatenate([unpacked(x, np.float32) for x in asked["logs"]])[order], np.float32(0))
    # the commonest are found fastest; where they are told by the first of the text
    some, n = run_lengths(ngram_codes(data[: 1 << 20], depth).astype(np.uint64))
    often, at = np.zeros(len(codes), np.int64), np.minimum(np.searchsorted(codes, some), len(codes) - 1)
    often[at] = np.where(codes[at] == some, n, often[at])
    table_ = CodeTable(codes, often)
    return block_sums(data, depth, starts, lengths + 1, lambda x: logs[table_.find(x)])  # -1: between texts, in no sum


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs, crc_fold(F.col("doc_id"), 7) == 2)
