"""Best-fit packing of tokenised documents into fixed-size sequences (operator 1).

Hierarchical residual packing. Pieces are dealt at random to partitions; each partition packs its own by
best fit, longest first, and emits every bin. Nearly full bins are done. Of the rest, only bins that can still
take part in a merge travel up a tree of ever fewer nodes, where they are items of further best-fit rounds:
after a best-fit round at most one bin of a node is at most half full, and only such a bin can be put
into another one, so a node sends up its small bins and the emptiest others as hosts for those of other nodes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.bpe import WordRanks, merge_flat
from driftwood.llm.common import Recent, as_bytes, chunks, crc32_of, digest_of, discard, kept_table, materialise, ragged, table

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", bin bigint, offset bigint, node int, bin_fill bigint"
NODE = "node int, bin bigint, fill bigint, members array<struct<bin:bigint,offset:bigint>>"
BIN_BITS = 40


# str.split() also splits at these, which the tokenizer keeps as text
ODD_SPACE = re.compile(b"[\x1c-\x1f]")
SPACE = regex.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# beyond Latin letters and general punctuation, libraries differ in what they hold for a letter or a mark, and characters compose
BEYOND = re.compile("[^\0-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e]")
#: Of each character that is not beyond: 0 space, 1 letter, 2 number (a word of its own), 3 anything else.
KINDS = np.array([0 if c.isspace() else 1 if c.isalpha() else 2 if regex.match(r"\p{N}", c) else 3 for c in map(chr, range(0x2060))], np.uint8)
#: Whether the tokenizer leaves it as it is.
AS_IS = np.array([c == c.lower() and (c.isascii() or c.isalpha()) for c in map(chr, range(0x2060))])
QUOTE, ALONE, PAIRED = ord("'"), [ord(c) for c in "stmd"], [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
STEP = 0x9E3779B97F4A7C15


def plain(low: bytes) -> str | None:
    """The text, if its words can be told by kinds of characters: Latin, without dotted capital I and combining marks."""
    if ODD_SPACE.search(low):
        return None
    t = low.decode("utf-8", "replace")
    return t if t.isascii() or not BEYOND.search(t) else None


def parts(low: bytes) -> list[str]:
    """Pieces of any text whose token ids, one after another, are the text's. A-Z is lower-cased already."""
    t = low.decode("utf-8", "replace")
    return SPACE.split(t.strip(" \t\n\r")) if ODD_SPACE.search(low) else t.split()


def word_starts(letters: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where words start: runs of letters, single numbers, runs of marks; and contractions, a quote that no mark is before with the letters that belong to it."""
    new = kind > 0
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    quotes = np.flatnonzero(new & (letters == QUOTE))
    if len(quotes):
        behind = np.append(letters, np.zeros(2, letters.dtype))
        one, two = behind[quotes + 1], behind[quotes + 2]
        size = np.isin(one, ALONE) + 2 * np.logical_or.reduce([(one == a) & (two == b) for a, b in PAIRED])
        quotes, size = quotes[size > 0], size[size > 0]
        new[quotes + 1] = False
        rest = quotes + 1 + size
        rest = rest[rest < len(new)]
        new[rest] = kind[rest] > 0
    return np.flatnonzero(new)


def plain_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of plain texts (characters of all, and each one's length), the words of all texts by number, and how many each text has.

    Words are told apart by a 64-bit hash, and each is then compared with the first one of its hash.
    """
    letters = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    kind = KINDS[letters]
    starts = word_starts(letters, kind)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))
    if not len(starts):
        return letters[:0], starts, starts, counts
    spoken = kind > 0
    first = (np.cumsum(spoken) - 1)[starts]
    letters = letters[spoken]
    lengths = np.diff(np.append(first, len(letters)))
    powers = np.cumprod(np.full(int(lengths.max()), STEP, np.uint64))
    hashes = np.add.reduceat((letters + np.uint64(1)) * powers[ragged(np.zeros_like(first), lengths)], first)
    coded = pa.array(hashes).dictionary_encode()
    refs = coded.indices.to_numpy().astype(np.int64)
    firsts = np.empty(len(coded.dictionary), np.int64)
    firsts[refs[::-1]] = np.arange(len(refs))[::-1]
    model = firsts[refs]
    if (lengths[model] != lengths).any() or (letters[ragged(first[model], lengths)] != letters).any():
        raise ArithmeticError("two words of one hash")
    return letters[ragged(first[firsts], lengths[firsts])], lengths[firsts], refs, counts


def added_tokens(model: dict) -> dict[bytes, int]:
    """The tokens that the tokenizer finds in a text as it stands, before it lower-cases or composes anything, and their ids."""
    found = {}
    for t in model.get("added_tokens") or []:
        if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token of another kind: {t['content']}")
        found[t["content"].encode()] = t["id"]
    return found


class PartIds:
    """Part -> the bytes of its token ids (little-endian uint32), filled by ids(); common parts are kept from call to call.

    A text is first split at added tokens, whose ids stand for themselves. Words of Latin texts go straight to the tokenizer's merges,
    all distinct ones of a call at a time; all else through the library, which no longer knows the added tokens: lower-cased text is none.
    """

    def __init__(self, tokenizer_json: str, most: int = 50_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = json.loads(tokenizer_json)
        self.added = {name: np.array([id_], "<u4").tobytes() for name, id_ in added_tokens(model).items()}
        # the longest first: of two that start at one place it is found
        self.split = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or b"(?!)")
        self.tokenizer = Tokenizer.from_str(json.dumps(model | {"added_tokens": []}))
        self.ranks, self.kept = WordRanks(tokenizer_json), Recent(most)

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each whole text."""
        pieces, ends, between = [], [], []
        for t in texts:
            at = 0
            for m in self.split.finditer(t):
                pieces.append(t[at : m.start()])
                between.append(self.added[m[0]])
                at = m.end()
            pieces.append(t[at:] if at else t)
            between.append(b"")
            ends.append(len(pieces))
        found = self.ids_between(pieces)
        at = 0
        for end in ends:
            if end == at + 1:
                yield next(found)
            else:
                yield b"".join(next(found) + between[k] for k in range(at, end))
            at = end

    def ids_of_words(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        if not len(lengths):
            return np.zeros(0, "<u4"), lengths
        first = np.cumsum(lengths) - lengths
        simple = np.logical_and.reduceat(AS_IS[letters], first)
        other = np.flatnonzero(~simple)
        words = letters[ragged(first[other], lengths[other])].tobytes().decode("utf-32-le")
        bounds = np.concatenate(([0], np.cumsum(lengths[other]))).tolist()
        by_library = self.by_library([words[i:j] for i, j in zip(bounds, bounds[1:], strict=False)])
        inside = np.repeat(simple, lengths)
        data = np.frombuffer(letters[inside].tobytes().decode("utf-32-le").encode(), np.uint8)
        wide = 1 + (letters >= 0x80).astype(np.int64) + (letters >= 0x800)
        ids, counts = merge_flat(data, np.add.reduceat(wide, first)[simple], self.ranks)
        every = np.zeros(len(lengths), np.int64)
        every[simple], every[other] = counts, [len(x) for x in by_library]
        out = np.empty(int(every.sum()), "<u4")
        begin = np.cumsum(every) - every
        out[ragged(begin[simple], counts)] = ids
        out[ragged(begin[other], every[other])] = [i for x in by_library for i in x]
        return out, every

    def by_library(self, words: list[str]) -> list[list[int]]:
        found = []
        for at in range(0, len(words), 20_000):
            found += [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False)]
        return found

    def ids_between(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of texts without added tokens."""
        lows = [t.lower() for t in texts]
        told = [plain(t) for t in lows]
        try:
            letters, lengths, refs, counts = plain_words([t for t in told if t is not None])
        except ArithmeticError:
            told, (letters, lengths, refs, counts) = [None] * len(texts), plain_words([])
        flat, sizes = self.ids_of_words(letters, lengths)
        each = sizes[refs]
        ids = flat[ragged((np.cumsum(sizes) - sizes)[refs], each)].tobytes()
        ends = np.concatenate(([0], np.cumsum(each)))
        bounds = iter((4 * ends[np.concatenate(([0], np.cumsum(counts)))]).tolist())
        odd = {i: parts(lows[i]) for i, t in enumerate(told) if t is None}
        new = self.kept.lacking(set().union(*odd.values()))
        known = self.kept.young
        known.update(zip(new, (np.array(x, "<u4").tobytes() for x in self.by_library(new)), strict=True))
        at = next(bounds)
        for i in range(len(texts)):
            if i in odd:
                yield b"".join(map(known.__getitem__, odd[i]))
            else:
                end = next(bounds)
                yield ids[at:end]
                at = end


def pieces(docs: DataFrame, tokenizer_json: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of each document: its ids, then end_id; only longer documents are cut, every `size` ids.

    Null and empty texts give one piece with the end id alone; repeated rows each give their own pieces. Other
    columns of docs are not read. Columns: doc_id, piece, start, length, ids_crc32.
    """
    shared, digest = docs.sparkSession.sparkContext.broadcast(tokenizer_json), digest_of(tokenizer_json)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        words = kept_table("words", digest, lambda: PartIds(shared.value))
        for batch in chunks(batches, 2 << 20):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids(list(as_bytes(batch.column(1)))), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    out.append((doc_id, k // (4 * size), k // 4, len(part) // 4, crc32_of(part)))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest first: (bin of each item, offset in it, fill of each bin). Ties: the newest bin of the tightest room.

    Open bins are kept by their room, 0 to size; the set bits of one int tell which rooms occur.
    """
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, fills = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fit := rooms >> n:
            room = n + ((fit & -fit).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, fills


def pack(items: DataFrame, size: int = 4096, slack: int = 0, hosts: int = 256, fan_in: int = 16, group: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to items (rows of PIECES), each sequence at most `size` long and gapless from 0.

    A bin with at most `slack` room is nearly full and never travels. A node sends up at most one bin that is
    at most half full and its `hosts` emptiest others; all other bins are final as they stand, so nothing
    is dropped and no node grows beyond fan_in * (hosts + 1) bins. The first groups have about `group` items each, however many there are.
    Lengths must be 1 to size. An empty table gives an empty result.
    """
    items = materialise(items)
    n = max(1, -(-items.count() // group))

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, fills = best_fit(frame["length"].to_numpy(), size)
        node = int(frame["deal"].iloc[0])
        frame = frame.drop(columns="deal")
        frame["bin"], frame["offset"], frame["node"] = bins + (node << BIN_BITS), offsets, node
        frame["bin_fill"] = np.where(offsets == 0, np.array(fills)[bins], 0)
        return frame

    dealt = items.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    packed = materialise(dealt.groupBy("deal").applyInPandas(local, PACKED))
    discard(items)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """One node's bins as items of a best-fit round; gives the bins that result."""
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True])
        home, offset, fills = best_fit(frame["fill"].to_numpy(), size)
        rows: dict[int, list] = {}
        for b, at, name, members in zip(home.tolist(), offset.tolist(), frame["bin"].tolist(), frame["members"], strict=True):
            row = rows.setdefault(b, [name, []])
            row[1] += [(name, at)] * (at > 0) + [(m["bin"], m["offset"] + at) for m in members]
        out = [(int(frame["node"].iloc[0]), name, fills[b], [{"bin": x, "offset": o} for x, o in members]) for b, (name, members) in rows.items()]
        return pd.DataFrame(out, columns=["node", "bin", "fill", "members"])

    def travellers(frame: pd.DataFrame) -> pd.DataFrame:
        """The bins a node sends up: those at most half full, and the emptiest others."""
        frame = frame.sort_values(["fill", "bin"])
        small = frame["fill"] <= size // 2
        return pd.concat([frame[small], frame[~small].head(hosts)])

    bins = packed.where(F.col("bin_fill").between(1, size - slack - 1)).select("node", "bin", F.col("bin_fill").alias("fill"), F.expr("cast(array() as array<struct<bin:bigint,offset:bigint>>)").alias("members"))
    level, moved = n, []
    bins = materialise(bins.groupBy("node").applyInPandas(travellers, NODE))
    while level > 1:
        level = -(-level // fan_in)
        merged = materialise(bins.withColumn("node", (F.col("node") / fan_in).cast("int")).groupBy("node").applyInPandas(merge, NODE))
        discard(bins)
        moved.append(merged)
        bins = materialise(merged.groupBy("node").applyInPandas(travellers, NODE)) if level > 1 else merged
    if not moved:
        return packed.select(*_columns(items), F.col("bin").alias("sequence_id"), "offset")
    # a bin may be listed in several rounds: the last one says where it ended up
    shifts = moved[0].select(F.lit(0).alias("round"), "bin", "members")
    for k, m in enumerate(moved[1:], 1):
        shifts = shifts.unionByName(m.select(F.lit(k).alias("round"), "bin", "members"))
    shifts = shifts.select("round", F.col("bin").alias("home"), F.explode("members").alias("m")).groupBy(F.col("m.bin").alias("bin")).agg(F.max_by(F.struct("home", F.col("m.offset").alias("shift")), "round").alias("to"))
    return packed.join(shifts, "bin", "left").select(*_columns(items), F.coalesce("to.home", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("to.shift", F.lit(0))).alias("offset"))


def _columns(items: DataFrame) -> list[str]:
    return [c for c in items.columns if c in ("doc_id", "piece", "start", "length", "ids_crc32")]


def tokenizer_text(path: str) -> str:
    """The tokenizer's file, read on the driver and broadcast: under 2 MB whatever the input."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(pieces(docs, tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))))
