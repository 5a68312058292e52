"""Target-distribution importance resampling (operator 12).

A text's features are its runs of one to three words, hashed into buckets. What a bucket is worth is the log of its share in the
target over its share in the corpus; a text's weight is the sum over its features, looked up in one array. Adding Gumbel noise
and taking the highest scores draws without replacement in proportion to the weights.

The draw is an external merge: each partition's eligible rows are a sorted run. Regular samples of the runs cut the keys into
ranges whose exact sizes are counted; a range's slices of all runs are merged by a tournament tree in one task, which knows its
first rank from the sizes before it. Ranges behind the last draw are never moved.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from driftwood.llm.common import as_bytes, chunks, materialise, table

BUCKETS = 10_000
#: What each byte becomes: digits, lower-case letters and all beyond ASCII stay, A-Z are lower-cased, the rest parts words.
FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
RUN = 3
#: Rows sampled of all runs (and one more a partition at most), and rows of a range that one task merges, about.
SAMPLES, MERGED = 1 << 15, 1 << 17
SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
KEPT = ("doc_id", "n_features", "weight", "score")


def _appended(basis: np.ndarray) -> np.ndarray:
    """A linear map on crc32 states, given by what it makes of the 32 single bits, as four tables of 256."""
    byte = np.arange(256)
    out = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(byte >> bit & 1, basis[8 * k + bit], 0).astype(np.uint32)
    return out


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][state >> 8 & 255] ^ tables[2][state >> 16 & 255] ^ tables[3][state >> 24]


class Crc:
    """crc32 of joined strings from the crc32 of each: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""

    SHORT = 64

    def __init__(self):
        one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        step = (bits >> 8) ^ one[bits & 255]
        basis, short = bits, []
        for _ in range(self.SHORT):
            short.append(_appended(basis))
            basis = _apply(_appended(step), basis)
        self.short = np.stack(short)
        self.powers = [_appended(basis)]  # of SHORT * 2 ** k zero bytes
        for _ in range(40):
            basis = _apply(self.powers[-1], basis)
            self.powers.append(_appended(basis))

    def shifted(self, state: np.ndarray, length: np.ndarray) -> np.ndarray:
        low, high = length % self.SHORT, length // self.SHORT
        out = self.short[low, 0, state & 255] ^ self.short[low, 1, state >> 8 & 255] ^ self.short[low, 2, state >> 16 & 255] ^ self.short[low, 3, state >> 24]
        for k in range(int(high.max()).bit_length() if len(high) else 0):
            some = np.flatnonzero(high >> k & 1)
            out[some] = _apply(self.powers[k], out[some])
        return out


def features(texts: Iterator[bytes], crc: Crc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, buckets of all features, the text of each)."""
    words, sizes = [], []
    for t in texts:
        mine = t.translate(FOLD).split()
        words += mine
        sizes.append(len(mine))
    sizes = np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    alone, behind = np.array([zlib.crc32(w) for w in distinct], np.uint32), np.array([zlib.crc32(b" " + w) for w in distinct], np.uint32)
    length = np.array([len(w) + 1 for w in distinct], np.int64)
    state, found, owners = alone[code] if len(code) else np.zeros(0, np.uint32), [], []
    for k in range(RUN):
        if k:  # one word more behind each run, where the text has one
            state = crc.shifted(state[:-1], length[code[k:]]) ^ behind[code[k:]] if len(state) > 1 else state[:0]
        same = owner[: len(state)] == owner[k:] if len(state) else np.zeros(0, bool)
        found.append(state[same] % BUCKETS)
        owners.append(owner[: len(state)][same])
    return sizes, np.concatenate(found).astype(np.int64), np.concatenate(owners)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket; a task sends a row a bucket at most, the driver gets BUCKETS rows at most."""

    def run(batches):
        crc, total = Crc(), np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches):
            total += np.bincount(features(as_bytes(batch.column(0)), crc)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    ahead, behind = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * ahead / (float(s + 1) * behind))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, by the id alone."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """SCORED for each row of docs, against the texts of target. Null texts have no words; a null id counts as an empty one."""
    gain = gains(bucket_counts(docs), bucket_counts(target))

    def run(batches):
        crc = Crc()
        for batch in chunks(batches):
            n_words, bucket, owner = features(as_bytes(batch.column(1)), crc)
            n = np.bincount(owner, minlength=len(n_words))
            weight = np.zeros(len(n_words), np.int64)
            np.add.at(weight, owner, gain[bucket])
            score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n, weight, score))], [c.split()[0] for c in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCORED)


class Tournament:
    """A tree of losers over sorted runs: the least head is drawn, then only the matches on its path are played again."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        won = [None] * self.size + [k if k < len(runs) else None for k in range(self.size)]
        self.lost: list[int | None] = [None] * self.size
        for node in range(self.size - 1, 0, -1):
            won[node], self.lost[node] = self._match(won[2 * node], won[2 * node + 1])
        self.best = won[1] if self.size > 1 else won[-1]

    def _head(self, k: int | None) -> tuple | None:
        return self.runs[k][self.at[k]] if k is not None and self.at[k] < len(self.runs[k]) else None

    def _match(self, a: int | None, b: int | None) -> tuple[int | None, int | None]:
        x, y = self._head(a), self._head(b)
        return (b, a) if x is None or (y is not None and y < x) else (a, b)

    def __iter__(self) -> Iterator[tuple]:
        while (head := self._head(self.best)) is not None:
            yield head
            k = self.best
            self.at[k] += 1
            node = (self.size + k) // 2
            while node:
                k, self.lost[node] = self._match(k, self.lost[node])
                node //= 2
            self.best = k


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """Sort keys: the highest score first, of equal ones the smallest id (null last), then the run."""
    score, ids, run = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("score", "doc_id", "run"))
    return [(-s, i is None, i or 0, r) for s, i, r in zip(score, ids, run, strict=True)]


def _ranged(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """runs with the range of each row's key: how many cuts aren't behind it."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(cuts, k) for k in _keys(batch)], pa.int32())], [*batch.schema.names, "range"])

    return runs.mapInArrow(run, StructType([*runs.schema.fields, StructField("range", IntegerType())]))


def draw(scored: DataFrame, percent: int = 5, least_words: int = 20, samples: int = SAMPLES, merged: int = MERGED) -> DataFrame:
    """doc_id, n_features, weight, score of each row of scored, and rank: 1, 2, 3 ... for the drawn ones, else null.

    Of the N rows with least_words words or more, percent * N / 100 (rounded down) are drawn. Rows of one id and score are as good as one
    another. The driver gets `samples` keys and one a partition, then a count for each range.
    """
    runs = materialise(scored.withColumn("run", F.spark_partition_id()))
    fields = [*KEPT, "run"]
    eligible = runs.where(F.col("n_words") >= least_words).select(*fields)
    n = eligible.count()
    wanted, step = percent * n // 100, max(1, n // samples)
    ordered = eligible.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "run")

    def sample(batches):
        at = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange((step // 2 - at) % step, batch.num_rows, step)))
            at += batch.num_rows

    cuts = []
    if wanted:
        seen = sorted(k for r in ordered.mapInArrow(sample, eligible.schema).toArrow().to_batches() for k in _keys(r))
        cuts = sorted(set(seen[max(1, merged // step) :: max(1, merged // step)]))
    sizes = dict(_ranged(eligible, cuts).groupBy("range").count().collect()) if wanted else {}
    first, total, last = {}, 0, -1
    while total < wanted:
        last += 1
        first[last] = total
        total += sizes.get(last, 0)

    def slices(batches):
        for batch in batches:
            if batch.num_rows:
                dealt_to = batch.column("range").to_numpy()
                edges = pa.array(np.concatenate(([0], np.flatnonzero(np.diff(dealt_to)) + 1, [len(dealt_to)])), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("range").take(edges[:-1]), *(pa.ListArray.from_arrays(edges, batch.column(c)) for c in fields)], ["range", *fields])

    def merge(found: pa.Table) -> pa.Table:
        """One range: a run of each slice, drawn in order."""
        rank = first[found["range"][0].as_py()]
        rows = [list(zip(_keys(pa.RecordBatch.from_arrays([pa.array(part[c], pa.int64()) for c in fields], fields)), *(part[c] for c in KEPT), strict=True)) for part in found.select(fields).to_pylist()]
        out = [row[1:] for row in Tournament(rows)]
        ranks = [rank + k if rank + k <= wanted else None for k in range(1, len(out) + 1)]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(KEPT)
        return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array(ranks, pa.int64())], [*KEPT, "rank"])

    result = "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint"
    rest = runs.where(F.col("n_words") < least_words).select(*fields)
    if last < 0:
        return runs.select(*KEPT, F.lit(None).cast("bigint").alias("rank"))
    dealt = _ranged(ordered, cuts).where(F.col("range") <= last)
    kinds = ", ".join(f"{c} array<{'int' if c == 'run' else 'bigint'}>" for c in fields)
    drawn = dealt.mapInArrow(slices, f"range int, {kinds}").groupBy("range").applyInArrow(merge, result)
    behind = _ranged(eligible, cuts).where(F.col("range") > last).select(*fields)
    return drawn.unionByName(rest.unionByName(behind).select(*KEPT, F.lit(None).cast("bigint").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
