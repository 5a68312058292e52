"""What a line of code or a subject says. All are Column -> Column, of built-in functions but for bucket(); tokens are also counted by Arrow batches."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from driftwood.functions import fixed

#: Letters are A-Z, a-z and everything beyond ASCII; cuts, in order, between two captured parts.
LETTER = r"(?:[A-Za-z]|[^\x00-\x7F])"
CUTS = ["([a-z])([A-Z])", "([A-Z])([A-Z][a-z])", rf"([0-9])({LETTER})", rf"({LETTER})([0-9])"]
RUN = r"(?:[A-Za-z0-9]|[^\x00-\x7F])+"

COMMENT = r"^(?://|/\*|\* |\*$|\*/|'''|\"\"\"|--(?:[^-]|$)|<!--|% |;;|\"\"[^\"]|REM |rem )"
DIRECTIVES = r"^#(?:include|!|\[|define|if|endif|pragma|else|\{)"
IMPORT = r"^(?:import |require\(|use |#include|using |require \"|require '|require_relative|import\(|@import|export \* from|extern crate|package )|require\([\"']|^from .* import |^from import |^export \{.* from "


def trim(line: Column) -> Column:
    """Without white space at both ends. Most lines begin and end with a mark of ASCII, which two comparisons tell; the others are looked at by a pattern."""
    marks = F.ascii(F.substring(line, 1, 1)).between(33, 126) & F.ascii(F.substring(line, -1, 1)).between(33, 126)
    return F.when(marks, line).otherwise(F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))


def tokens(line: Column) -> Column:
    """Identifier parts, lower-cased: cut at marks, case changes and digits; digits are "0"; 2 to 24 bytes; 40 at most."""
    for cut in CUTS:
        line = F.regexp_replace(line, cut, "$1 $2")
    found = F.regexp_extract_all(line, F.lit(RUN), F.lit(0))
    named = F.transform(found, lambda t: F.when(t.rlike("^[0-9]+$"), "0").when(F.octet_length(t).between(2, 24), F.lower(t)))
    return F.slice(F.filter(named, lambda t: t.isNotNull()), 1, fixed.MAX_TOKENS)


def is_comment(trimmed: Column) -> Column:
    return (trimmed.startswith("#") & ~trimmed.rlike(DIRECTIVES)) | trimmed.rlike(COMMENT)


def shape(trimmed: Column) -> Column:
    """The first word of a trimmed line, at most 16 letters, or what its first mark stands for."""
    word = F.lower(F.regexp_extract(trimmed, "^[A-Za-z_@#$]+", 0))
    first = F.substring(trimmed, 1, 1)
    return (
        F.when(trimmed == "", "<empty>")
        .when(is_comment(trimmed), "<comment>")
        .when(word != "", F.substring(word, 1, 16))
        .when(first.isin(*"})]"), "<close>")
        .when(first.isin(*"{(["), "<open>")
        .when(first == "<", "<tag>")
        .when(first.isin(*"\"'`"), "<string>")
        .when(first == ".", "<dot>")
        .when(first.isin(*"*-+|=>/\\:;,?!&%^~"), "<punct>")
        .when(first.rlike("[0-9]"), "<num>")
        .otherwise("<other>")
    )


def is_import(trimmed: Column) -> Column:
    return trimmed.rlike(IMPORT)


def without_space(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\s", "")


def has_any(low: Column, words: list[str]) -> Column:
    """Whether it contains one of the words: each is looked for by its bytes, which is faster than a pattern of all."""
    return reduce(operator.or_, [low.contains(w) for w in words])


def has_test_word(low: Column) -> Column:
    return has_any(low, fixed.TEST_WORDS) | (low.contains("require.") & low.contains("(t,"))


def has_error_word(low: Column) -> Column:
    return has_any(low, fixed.ERROR_WORDS)


def has_null_word(low: Column) -> Column:
    return has_any(low, fixed.NULL_WORDS)


def has_log_word(low: Column) -> Column:
    return has_any(low, fixed.LOG_WORDS)


def has_type_word(low: Column) -> Column:
    return has_any(low, fixed.TYPE_WORDS)


def is_trivial(trimmed: Column) -> Column:
    return (trimmed == "") | ((F.octet_length(trimmed) <= 2) & ~trimmed.rlike("[A-Za-z0-9]"))


def is_version_line(low: Column) -> Column:
    return low.contains("version") & low.rlike("[0-9]")


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, null ones empty."""
    texts = pc.fill_null(texts, "")
    kept, offset, data = texts.buffers()[1], texts.offset, texts.buffers()[2]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(kept, np.int32)[offset : offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def fnv_low(texts: pa.Array) -> np.ndarray:
    """The low bits of FNV-1a/64 of each text: step by step over byte positions, all texts that reach that far at once."""
    data, at = packed(texts)
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    starts = at[:-1][order]
    h = np.full(len(texts), fixed.FNV_START, np.int64)
    reach = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), "right")
    for k, n in enumerate(reach.tolist()):
        h[:n] = ((h[:n] ^ data[starts[:n] + k]) * fixed.FNV_STEP) & ((1 << fixed.HASH_BITS) - 1)
    out = np.empty(len(texts), np.int64)
    out[order] = h
    return out


def bucket(feature: Column) -> Column:
    """The low 20 bits of FNV-1a/64 of the UTF-8 bytes: they depend on nothing above them. Null stays null.

    Built-in functions would fold over bytes one by one, interpreted; an Arrow batch's distinct names are hashed at once.
    """
    return _buckets(feature)


@F.arrow_udf(LongType())
def _buckets(names: pa.Array) -> pa.Array:
    told = names.dictionary_encode()
    return pa.array(fnv_low(told.dictionary)).take(told.indices)


#: Of a byte: no part of a token (0), a digit, A-Z, a-z, or part of a character beyond ASCII.
_KINDS = np.array([1 if chr(b).isdigit() else 2 if chr(b).isupper() else 3 if chr(b).islower() else 0 for b in range(128)] + [4] * 128, np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def split_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, names): tokens() of each text, all texts at once; row numbers the text, code the token's name. By bytes: no cut is within a character."""
    data, at = packed(texts)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    kind = _KINDS[data]
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[edge[:-1]], after[edge[1:]] = 0, 0
    starts = (kind > 0) & ((before == 0) | ((before == 1) != (kind == 1)) | ((kind == 2) & ((before == 3) | ((before == 2) & (after == 3)))))
    ends = (kind > 0) & (after == 0)
    ends[:-1] |= starts[1:] & (kind[:-1] > 0)
    first, size = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    size -= first
    number = kind[first] == 1
    fits = number | ((size >= 2) & (size <= 24))
    first, size, number = first[fits], np.where(number[fits], 1, size[fits]), number[fits]
    row = np.searchsorted(at, first, "right") - 1
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    early = rank < fixed.MAX_TOKENS
    first, size, number, row = first[early], size[early], number[early], row[early]
    ends_at = np.concatenate(([0], np.cumsum(size)))
    flat = _LOWER[data[np.repeat(first - ends_at[:-1], size) + np.arange(ends_at[-1])]]
    flat[ends_at[:-1][number]] = ord("0")
    told = pa.Array.from_buffers(pa.string(), len(row), [None, pa.py_buffer(ends_at.astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
    code, names = told.indices.to_numpy(), told.dictionary
    if (flat > 127).any():
        lower = pa.array([x.lower() for x in names.to_pylist()], pa.string()).dictionary_encode()
        code, names = lower.indices.to_numpy()[code], lower.dictionary
    return row, code, names


def counted_tokens(prefixes: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(commit_id, side, token, n, bucket) of batches (commit_id, side boolean, text): how often a batch's texts have each token, by commit and side.

    bucket is that of the token behind the prefix of its side, false or true; each of a batch's names is hashed once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, names = split_tokens(batch.column(2))
            commits = batch.column(0).dictionary_encode()
            key = (commits.indices.to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False))[row] * len(names) + code
            key, n = np.unique(key, return_counts=True)
            owner, name = np.divmod(key, max(1, len(names)))
            hashes = np.stack([fnv_low(pc.binary_join_element_wise(pa.scalar(p), names, "")) for p in prefixes])
            yield pa.RecordBatch.from_arrays([commits.dictionary.take(pa.array(owner // 2)), pa.array(owner % 2 == 1), names.take(pa.array(name)), pa.array(n.astype(np.int64)), pa.array(hashes[owner % 2, name])], ["commit_id", "side", "token", "n", "bucket"])

    return run


def distinct_pairs(prefixes: tuple[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(feature) of batches (side boolean, text): the names of tokens that follow each other in a text, each once a batch, behind the prefix of its side, false or true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, names = split_tokens(batch.column(1))
            both = np.flatnonzero(row[1:] == row[:-1])
            side = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row[both]]
            n = max(1, len(names))
            key = np.unique((side * n + code[both]) * n + code[both + 1])
            first, second = key // n, key % n
            side, first = first // n, first % n
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.array(prefixes).take(pa.array(side)), pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), "_"), "")], ["feature"])

    return run


def log_scale(n: Column, most: int) -> Column:
    return clamp(F.log1p(n.cast("double")) / F.log1p(F.lit(float(most))))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def cut(value: Column, most: int) -> Column:
    """At most `most` bytes of a text; a character that doesn't fit whole is left out."""
    held = F.substring(value.cast("binary"), 1, most).cast("string")
    return F.when(F.octet_length(value) <= most, value).when(F.is_valid_utf8(held), held).otherwise(F.regexp_replace(F.make_valid_utf8(held), "\ufffd$", ""))
