"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, as in tests, it is a temporary one, but only where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        name = spark.sparkContext.applicationId
        if name not in _folders:
            _folders[name] = tempfile.mkdtemp(prefix="driftwood-")
        found = _folders[name]
    return found


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage is cut, lost executors lose nothing.

    The table goes by discard(), or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more, results still to be computed included."""
    for df in tables:
        files, where = _hadoop_path(df.sparkSession, df.written_to)
        files.delete(where, True)


@contextmanager
def rows_at_once(spark: SparkSession, most: int) -> Iterator[None]:
    """For actions inside: at most so many rows in a batch that goes to a Python worker, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before))) if int(before) > 0 else str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null ids count as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, empty for null, without building a str."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in binary:
        yield value.as_py() or b""


def text_of(batch: pa.RecordBatch, keep: list[str]) -> pa.Array:
    """The texts: those in the struct `row`, if that is what is kept, else the column behind the kept ones."""
    return pc.struct_field(batch.column(keep.index("row")), "text") if "row" in keep else batch.column(len(keep))


def with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    """What text_of() reads: no text is sent twice."""
    return docs.select(*keep, *([] if "row" in keep else [F.col("text").alias("its_text")]))


def as_row(docs: DataFrame, *more: Column) -> DataFrame:
    """Every column of docs in one struct, `row`, so that no name clashes, and more columns beside it."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *more)


def chunks(batches: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut at rows so that each holds about most_bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def joined(column: pa.Array, before: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts of a column, A-Z lower-cased, in one uint8 array; each with `before` zero bytes ahead and `after` behind.

    Returns (bytes, starts, lengths): text i is at starts[i] and has lengths[i] bytes.
    """
    texts = [t.lower() for t in as_bytes(column)]
    gap, tail = b"\0" * before, b"\0" * after
    data = np.frombuffer(b"".join(gap + t + tail for t in texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + before + after) - lengths - after
    return data, starts, lengths


def ngram_codes(data: np.ndarray, order: int) -> np.ndarray:
    """code[i]: the order bytes before i and byte i, the newest in the low bits; i counts from `order`."""
    n = len(data) - order
    if n <= 0:
        return np.zeros(0, np.uint64)
    kind = np.uint32 if order < 4 else np.uint64
    wide = data.astype(kind)
    code = wide[order:].copy()
    for back in range(1, order + 1):
        code |= wide[order - back : order - back + n] << kind(8 * back)
    return code


def training_codes(column: pa.Array, order: int, after: int = 0) -> np.ndarray:
    """The n-grams that end in the texts' bytes, or in the `after` zero bytes behind each."""
    data, starts, _ = joined(column, order, after)
    inside = np.ones(len(data), bool)
    inside[(starts[:, None] - np.arange(1, order + 1)).ravel()] = False
    return ngram_codes(data, order)[inside[order:]]


class Tally:
    """Counts of codes, merged as they come: once what waits outgrows what is merged."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray) -> None:
        self.put(*run_lengths(codes))

    def put(self, codes: np.ndarray, n: np.ndarray) -> None:
        """Codes with their counts; a count may be 0."""
        self.parts.append((codes, n))
        if len(self.parts) > 1 and sum(len(c) for c, _ in self.parts[1:]) > len(self.parts[0][0]):
            self.parts = [self.total()]

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in self.parts])
        n = np.concatenate([n for _, n in self.parts])
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        return codes[edges], np.add.reduceat(n, edges) if len(edges) else n


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] to starts[i] + lengths[i], for all i."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    ordered = np.sort(values)
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[edges], np.diff(np.append(edges, len(ordered)))


class CodeTable:
    """Code -> position in a sorted array: one hashed probe, and a binary search for what it leaves.

    The most frequent codes are put in last, so they win their slot.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes = codes
        bits = max(8, int(len(codes) * 2).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        order = np.argsort(counts, kind="stable")
        self.slots[self._slot(codes[order])] = order
        self.keys = np.where(self.slots >= 0, codes[self.slots] if len(codes) else 0, 0)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Positions in the sorted array; -1 where a code is not in it."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        slot = self._slot(codes)
        found = self.slots[slot]
        left = np.flatnonzero((self.keys[slot] != codes) | (found < 0))
        if len(left):
            want = codes[left]
            at = np.minimum(np.searchsorted(self.codes, want), len(self.codes) - 1)
            found[left] = np.where(self.codes[at] == want, at, -1)
        return found


class Recent:
    """A table of two generations: what was looked up since the last turn, and what the one before held. Rare keys go, common ones stay.

    It never holds more than 2 * most keys and those that one call asks for.
    """

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def lacking(self, keys: set[str]) -> list[str]:
        """Puts the known ones of keys into the young generation; returns the others, which the caller must put there."""
        if len(self.young) + len(keys) > self.most:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for key in keys.difference(young):
            value = old.get(key)
            if value is None:
                new.append(key)
            else:
                young[key] = value
        return new


def block_sums(data: np.ndarray, order: int, starts: np.ndarray, lengths: np.ndarray, cost, block: int = 1 << 20) -> np.ndarray:
    """Sums of cost(n-grams), a row for each, over the bytes of each text; texts as joined() lays them out.

    The n-grams are worked out block by block, so that a long text needs no more than a block's memory beside its bytes.
    """
    first, ends = starts - order, starts - order + lengths
    total = None
    for at in range(0, max(1, len(data) - order), block):
        codes = ngram_codes(data[at : at + block + order], order).astype(np.uint64)
        value = cost(codes)
        if total is None:
            total = np.zeros((len(starts), *value.shape[1:]))
        low, high = np.searchsorted(ends, at, "right"), np.searchsorted(first, at + len(codes), "left")
        begin, end = np.maximum(first[low:high], at) - at, np.minimum(ends[low:high], at + len(codes)) - at
        some = np.flatnonzero(end > begin)
        if len(some):
            padded = np.concatenate((value, np.zeros((1, *value.shape[1:]), value.dtype)))
            total[low + some] += np.add.reduceat(padded, np.stack((begin[some], end[some]), axis=1).ravel(), axis=0, dtype=np.float64)[::2]
    return total


def packed(values: np.ndarray) -> bytes:
    """An array of integers as bytes: all first bytes, all second ones and so on, compressed; small numbers cost little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


_tables: dict[tuple[str, str], object] = {}


def digest_of(*texts: str | bytes) -> str:
    return hashlib.sha256(b"\0".join(t if isinstance(t, bytes) else t.encode() for t in texts)).hexdigest()


def kept_table(kind: str, digest: str, build: Callable[[], object], most: int = 2):
    """build(), kept in this Python worker from task to task under the digest of what it is built from; the `most` newest are kept.

    Functions that tasks run must reach this by its module: what they hold themselves is built anew in each task.
    """
    key = (kind, digest)
    if key in _tables:
        _tables[key] = _tables.pop(key)
    else:
        while len(_tables) >= most:
            _tables.pop(next(iter(_tables)))
        _tables[key] = build()
    return _tables[key]


def crc32_of(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
