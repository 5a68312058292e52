"""Byte-level BPE over whole texts, with segment trees (operator 7).

For a piece (a match of the split pattern) a segment tree over byte positions holds the rank of each live pair; its root gives
the lowest rank, the descent to the left first the leftmost pair that has it. A merge updates three leaves, at logarithmic cost:
the merged position, its live left neighbour and the position that dies. Short pieces are merged many at a time, with numpy,
one row of a matrix a tree; long ones one by one. Equal pieces are merged once and kept in a bounded table.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from driftwood.llm.common import CodeTable, Recent, as_bytes, chunks, digest_of, kept_table, ragged, table

NONE = np.int32(2**31 - 1)
LONG = 256


class Ranks:
    """A rank file: token bytes by id, and the rank of each pair of tokens whose bytes together are a token."""

    def __init__(self, file_text: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file_text.splitlines() if line)}
        self.token = {b: a for a, b in self.rank.items()}
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        codes = np.array(sorted(pairs), np.uint64)
        self.pair = pairs
        self.pair_ranks = np.array([pairs[int(c)] for c in codes], np.int32)
        self.table = CodeTable(codes, -self.pair_ranks)
        self.byte_ids = self.last_ids = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def start(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of single bytes; the last of a piece may have its own."""
        ids, last = self.byte_ids[data], np.cumsum(lengths) - 1
        ids[last] = self.last_ids[data[last]]
        return ids

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.table.find(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(at >= 0, self.pair_ranks[at], NONE)


class WordRanks(Ranks):
    """The merges of a tokenizer file whose words end in a marked token; ids are in the order of the merges."""

    def __init__(self, tokenizer_json: str, end: str = "</w>"):
        model = json.loads(tokenizer_json)["model"]
        ids, symbols = model["vocab"], byte_symbols()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = {ids[a] << 32 | ids[b]: ids[a + b] for a, b in merges}
        if list(pairs.values()) != sorted(pairs.values()):
            raise ValueError("ids are not in the order of the merges")
        codes = np.array(sorted(pairs), np.uint64)
        self.pair = pairs
        self.pair_ranks = np.array([pairs[int(c)] for c in codes], np.int32)
        self.table = CodeTable(codes, -self.pair_ranks)
        self.byte_ids = np.array([ids[c] for c in symbols], np.int32)
        self.last_ids = np.array([ids[c + end] for c in symbols], np.int32)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level files: its own if that can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(0x100 + hidden.index(b)) for b in range(256)]


def merge_many(data: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after another, and how many each has; none is empty. data: the bytes of all. One segment tree a row, as wide as the longest piece needs."""
    n = len(lengths)
    width = 1 << int(lengths.max() - 1).bit_length()
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # column width is a sentinel: no token, so no pair
    token = np.full((n, width + 1), -1, np.int32)
    first = ranks.start(data, lengths)
    token[row, column] = first
    token = token.ravel()
    after = np.tile(np.minimum(np.arange(1, width + 2), width).astype(np.int32), (n, 1)).ravel()
    before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1)).ravel()
    tree = np.full((n, 2 * width), NONE, np.int32)
    paired = column < np.repeat(lengths, lengths) - 1
    at = np.flatnonzero(paired)
    tree[row[at], width + column[at]] = ranks.of_pairs(first[at], first[at + 1])
    level = width >> 1
    while level:
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        level >>= 1
    tree = tree.ravel()
    live = np.arange(n)
    while True:
        root = tree[live * (2 * width) + 1]
        keep = root != NONE
        live, root = live[keep], root[keep]
        if not len(live):
            break
        trees, cells = live * (2 * width), live * (width + 1)
        node = np.ones(len(live), np.int64)
        for _ in range(width.bit_length() - 1):
            node <<= 1
            node += tree[trees + node] != root
        here = node - width
        there = after[cells + here]
        beyond = after[cells + there]
        token[cells + here] = root
        token[cells + there] = -1
        after[cells + here] = beyond
        before[cells + beyond] = here
        left = before[cells + here]
        # a pair needs two tokens: the sentinel behind the last one is none, nor is what lies behind a shorter piece
        next_ = token[cells + beyond]
        right_rank = np.full(len(live), NONE, np.int32)
        some = np.flatnonzero((next_ >= 0) & (beyond < width))
        right_rank[some] = ranks.of_pairs(root[some], next_[some])
        tree[trees + width + here] = right_rank
        tree[trees + width + there] = NONE
        some = np.flatnonzero(left >= 0)
        tree[trees[some] + width + left[some]] = ranks.of_pairs(token[cells[some] + left[some]], root[some])
        for place, base in ((here, trees), (there, trees), (left[some], trees[some])):
            node = (place + width) >> 1
            for _ in range(width.bit_length() - 1):
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
                node >>= 1
    token = token.reshape(n, width + 1)
    return token[token >= 0], (token >= 0).sum(axis=1)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """The same for one long piece."""
    n, none = len(piece), int(NONE)
    width = 1 << (n - 1).bit_length()
    token = [*ranks.start(np.frombuffer(piece, np.uint8), np.array([n])).tolist(), -1]
    after, before = list(range(1, n + 1)) + [n], list(range(-1, n))
    tree = [none] * (2 * width)
    get = ranks.pair.get
    for i in range(n - 1):
        tree[width + i] = get(token[i] << 32 | token[i + 1], none)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    while (best := tree[1]) != none:
        i = 1
        while i < width:
            i = 2 * i if tree[2 * i] == best else 2 * i + 1
        here = i - width
        there = after[here]
        beyond = after[there]
        token[here], token[there], after[here], before[beyond] = best, -1, beyond, here
        put(there, none)
        put(here, get(best << 32 | token[beyond], none) if beyond < n else none)
        if (left := before[here]) >= 0:
            put(left, get(token[left] << 32 | best, none))
    return [t for t in token if t >= 0]


def merge_flat(data: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """As merge_many(), for pieces of any lengths; those of like length are merged together, those longer than LONG one by one."""
    if not len(lengths):
        return np.zeros(0, np.int32), lengths
    starts, counts = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
    bits = np.where(lengths > LONG, -1, np.ceil(np.log2(lengths))).astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for width in np.unique(bits).tolist():
        some = np.flatnonzero(bits == width)
        step = 1 if width < 0 else max(1, (1 << 20) >> width)
        for at in range(0, len(some), step):
            part = some[at : at + step]
            if width < 0:
                i = int(part[0])
                ids = np.array(merge_one(data[starts[i] : starts[i] + lengths[i]].tobytes(), ranks), np.int32)
                counts[i] = len(ids)
            else:
                ids, counts[part] = merge_many(data[ragged(starts[part], lengths[part])], lengths[part], ranks)
            done.append((part, ids))
    out, begin = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
    for part, ids in done:
        out[ragged(begin[part], counts[part])] = ids
    return out, counts


def merge_all(pieces: list[tuple[str, bytes]], ranks: Ranks, into: dict[str, bytes]) -> None:
    """Puts the ids of each piece (little-endian uint32) into a dict under its name."""
    data = np.frombuffer(b"".join(d for _, d in pieces), np.uint8)
    ids, counts = merge_flat(data, np.fromiter((len(d) for _, d in pieces), np.int64, len(pieces)), ranks)
    flat, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    into.update(zip([p for p, _ in pieces], map(flat.__getitem__, map(slice, [0, *ends], ends)), strict=False))


class PieceIds:
    """Piece (str) -> the bytes of its ids, little-endian uint32; common pieces are kept from call to call."""

    def __init__(self, file_text: bytes, pattern: str, most: int = 160_000):
        self.ranks, self.pattern, self.kept = Ranks(file_text), regex.compile(pattern), Recent(most)
        size = max(self.ranks.token) + 1
        self.tokens = [self.ranks.token.get(k, b"") for k in range(size)]
        self.decimals = [b"%d" % k for k in range(size)]

    def learn(self, new: list[str]) -> None:
        rest, known = [], self.kept.young
        for piece in new:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.rank.get(data)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            else:
                rest.append((piece, data))
        merge_all(rest, self.ranks, known)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [self.pattern.findall(t) for t in texts]
        self.learn(self.kept.lacking(set().union(*split)))
        known = self.kept.young
        for found in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, found)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>"
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _run(docs: DataFrame, file_text: bytes, pattern: str, schema: str, rows) -> DataFrame:
    shared, digest = docs.sparkSession.sparkContext.broadcast(file_text), digest_of(file_text, pattern)
    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names, kinds = zip(*((c.split()[0], arrow[c.split()[1]]) for c in schema.split(", ")), strict=True)

    def run(batches):
        bpe = kept_table("pieces", digest, lambda: PieceIds(shared.value, pattern))
        for batch in chunks(batches, 3 << 20):
            texts = [t.decode("utf-8", "replace") for t in as_bytes(batch.column(1))]
            out = [rows(bpe, doc_id, ids) for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.encode(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, file_text: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each whole text, without special tokens; null text: no ids.

    Rows are independent: repeated ones are kept, other columns are not read, an empty table gives an empty result.
    """
    return _run(docs, file_text, pattern, ENCODED, lambda bpe, doc_id, ids: (doc_id, len(ids), ids.astype(np.int32)))


def encode_digest(docs: DataFrame, file_text: bytes, pattern: str) -> DataFrame:
    """As encode(), but the digests of the ids and of the bytes that they decode to, computed where the ids are."""

    def row(bpe, doc_id, ids):
        decimals = b" ".join(map(bpe.decimals.__getitem__, ids.tolist()))
        return doc_id, len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _run(docs, file_text, pattern, DIGEST, row)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return encode_digest(table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)
