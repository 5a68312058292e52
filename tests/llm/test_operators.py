"""Each operator against brute force, on the odd cases of conftest and on an empty table."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.conftest import words  # noqa: E402
from driftwood.llm import bpe, chat, common, ctw, divergence, html, langid, media, packing, quality, resample, sharding, simhash, suffix  # noqa: E402


def crc(b: bytes) -> int:
    return zlib.crc32(b) & 0xFFFFFFFF


def by_id(found, key="doc_id"):
    out = defaultdict(list)
    for r in found:
        out[r[key]].append(r)
    return out


def same_multiset(found, expected):
    assert Counter(found) == Counter(expected)


# --- 1 packing


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_packing(docs, rows, no_docs, word_tokenizer):
    json_text = packing.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    size = 256
    found = packing.pack(packing.pieces(docs, json_text, size), size, hosts=2, fan_in=2, group=20).collect()
    expected = []
    for r in rows:
        ids = word_tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), size):
            part = np.array(ids[k : k + size], "<u4").tobytes()
            expected.append((r[0], k // size, k, len(part) // 4, crc(part)))
    same_multiset([tuple(r)[:5] for r in found], expected)
    bins = by_id(found, "sequence_id")
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    total = sum(e[3] for e in expected)
    assert len(bins) <= -(-total // size) * 1.05 + 1
    assert packing.pack(packing.pieces(no_docs, json_text)).count() == 0


@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", "'s", "'", " ", "\n", "A", "don't", "e\u0301", "\u0301", "\u0130", "x1", "\u4e2d", "\x1c"]) | st.text(max_size=5), max_size=9))
@settings(max_examples=200, deadline=None)
def test_ids_are_the_librarys(word_tokenizer, some):
    """Added tokens with and without quotes, glued to words, and in capitals; any text."""
    words = common.kept_table("test words", "", lambda: packing.PartIds(packing.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))))
    texts = ["".join(some), " ".join(some)]
    found = [np.frombuffer(x, "<u4").tolist() for x in words.ids([t.encode("utf-8", "replace") for t in texts])]
    assert found == [word_tokenizer.encode(t.encode("utf-8", "replace").decode(), add_special_tokens=False).ids for t in texts]


def test_kept_tables():
    """Tables are kept by what they are built from, so one file's never stand for another's; only the newest stay."""
    built = []
    make = lambda name: common.kept_table("kind", common.digest_of(name), lambda: built.append(name) or name)
    assert [make(x) for x in "abbaa"] == [*"abbaa"] and built == ["a", "b"]
    assert make("c") == "c" and make("b") == "b" and built == ["a", "b", "c", "b"]


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=50, deadline=None)
def test_best_fit(lengths):
    bins, offsets, fills = packing.best_fit(np.array(lengths, np.int64), 50)
    want, order = [], sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        fit = [b for b in range(len(want)) if want[b] + lengths[i] <= 50]
        if fit:
            want[max(fit, key=lambda b: want[b])] += lengths[i]
        else:
            want.append(lengths[i])
    assert sorted(want) == sorted(fills)


# --- 2 media


def test_media(docs, rows, no_docs):
    found = media.decode(media.encode(docs)).collect()
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        want.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), crc(p[-64:])))
    same_multiset([tuple(r)[:5] for r in found], want)
    forms = {(r.payload_sha256, r.n_bytes): (r.media_sha256, r.feature) for r in found}
    assert all(forms[r.payload_sha256, r.n_bytes] == (r.media_sha256, r.feature) for r in found)
    assert media.decode(media.encode(no_docs)).count() == 0


def slow_checksum(data: bytes) -> int:
    value = 0
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
    return value


@given(st.lists(st.binary(max_size=900), min_size=1, max_size=5), st.lists(st.binary(max_size=70_000), max_size=2))
@settings(max_examples=25, deadline=None)
def test_ogg_round_trip(a, b):
    streams = {7: [(x, i) for i, x in enumerate(a)], 9: [(x, i) for i, x in enumerate([b"head", *b])]}
    stored = media.mux(streams)
    found = media.demux(stored)
    assert {k: [p.data for p in s.packets] for k, s in found.items()} == {k: [x for x, _ in s] for k, s in streams.items()}
    spot = random.Random(len(stored)).randrange(len(stored))
    with pytest.raises(media.BadOgg):
        media.demux(stored[:spot] + bytes([stored[spot] ^ 1]) + stored[spot + 1 :])


def test_ogg_checksum_and_bad_media(spark):
    assert media.checksum(b"OggS some page") == slow_checksum(b"OggS some page")
    good = media.to_media(b"x" * 64, 3)
    found = media.decode(spark.createDataFrame([(1, good), (2, None), (3, b"junk"), (4, good[:-1])], "doc_id bigint, media binary")).collect()
    assert [r.payload_bytes for r in sorted(found, key=lambda r: r.doc_id)] == [64, None, None, None]


def test_ogg_times_come_from_granules(spark):
    times = lambda *packets: media.timed([media.Packet(b"x" * n, g) for n, g in packets], lambda p: len(p.data))
    assert times((2, -1), (1, 3)) == [(0, 2), (2, 3)]
    assert times((2, -1), (1, 103), (5, 110), (4, 112)) == [(100, 102), (102, 103), (105, 110), (110, 112)]  # starts late, has a gap, is cut at the end
    assert times((5, -1), (5, 7)) == [(0, 5), (5, 7)]
    for wrong in ([(2, 5), (3, 6), (1, 7)], [(2, 5), (3, 4)], [(2, -1)], [(9, 3), (1, 4)]):
        with pytest.raises(media.BadOgg):
            times(*wrong)
    late = media.to_media(b"s" * 300_000, 300_000, 16_000)
    spans = media.from_media(late)["spans"]
    assert spans == [(16_000 + k, 16_000 + min(300_000, k + media.BLOCK)) for k in range(0, 300_000, media.BLOCK)]
    row = media.decode(spark.createDataFrame([(1, late)], "doc_id bigint, media binary")).first()
    assert list(zip(row.packet_starts, row.packet_ends, strict=True)) == spans and row.feature.startswith("ms=37500.000;")


# --- 3 simhash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    some = sorted(parent)
    for i, x in enumerate(some):
        for y in some[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                parent[find(y)] = find(x)
    return {v: find(v) for v in some}


def test_simhash(docs, rows, no_docs):
    found = simhash.near_duplicates(docs).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    roots = components_of(set(fps))
    least = {}
    for r, fp in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[roots[fp]] = min(r[0], least.get(roots[fp], r[0]))
    same_multiset([tuple(r) for r in found], [(r[0], f"{fp:016x}", least.get(roots[fp])) for r, fp in zip(rows, fps, strict=True)])
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    tagged = common.materialise(simhash.fingerprints(docs))
    same_multiset([tuple(r) for r in simhash.link(tagged, often=10**9).select("doc_id", "component_id").collect()], [(r.doc_id, r.component_id) for r in found])
    named = {roots[f] for r, f in zip(rows, fps, strict=True)}
    assert kept.count() == len(named)


@pytest.mark.parametrize("crowded", [1000, 2])
def test_near_pairs_exact(spark, crowded):
    r = random.Random(5)
    centre = r.getrandbits(64)
    values = {r.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(250):
        v = centre
        for _ in range(r.randrange(4)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    found = {tuple(sorted((x.a % (1 << 64), x.b % (1 << 64)))) for x in simhash.near_pairs(df, crowded).collect()}
    some = sorted(values)
    assert found == {(x, y) for i, x in enumerate(some) for y in some[i + 1 :] if (x ^ y).bit_count() <= 2}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (200, 100)}


# --- 4 quality


def slow_counts(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows, spark, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.judge(docs, labels).collect()
    want = []
    for r in rows:
        c = slow_counts(r[1])
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        want.append((r[0], *c, failed, not failed, None))
    same_multiset([tuple(r) for r in found], want)
    assert quality.judge(no_docs, labels.limit(0)).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == sum(x[7] for x in want)


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.3), (3, 12, 0.1), (12, 12, 0.5), (5, 200, 0.02)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_certified_cutoffs_hold_the_risk(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        n = r.randrange(20, 90)
        text = " ".join(w + ("***" if bad and r.random() < 0.8 else "") for w in (f"w{r.randrange(10**6)}" for _ in range(n)))
        rows.append((i, text, "en" if i % 2 else "de"))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {x.doc_id: x for x in quality.judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert all(x.level is not None for x in found.values())
    good = [found[i].kept for i in range(3000) if i % 5]
    bad = [found[i].kept for i in range(0, 3000, 5)]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.05


def test_small_strata_share_cutoffs_and_no_value_is_clipped(spark):
    """Ten languages too small for cutoffs of their own; bad documents are told by words of 30 characters and more."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(2400):
        bad = i % 4 == 0
        rows.append((i, " ".join("x" * (r.randrange(30, 60) if bad else r.randrange(22, 28)) + str(r.randrange(10**6)) for _ in range(r.randrange(20, 40))), f"l{i % 10}"))
        labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {x.doc_id: x for x in quality.judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert all(x.level is not None for x in found.values())
    assert sum(found[i].kept for i in range(2400) if i % 4) > 0.98 * 1800 and sum(found[i].kept for i in range(0, 2400, 4)) < 0.05 * 600


def test_copies_add_no_evidence(spark):
    """Copies and near copies of a labelled table leave levels and cutoffs as they are; what is too little stays too little."""
    r = random.Random(5)

    def table_of(good, bad):
        rows = []
        for i in range(good + bad):
            n = r.randrange(30, 90)
            rows.append((i, " ".join(f"w{r.randrange(10**6)}" + ("***" if i >= good and r.random() < 0.8 else "") for _ in range(n)), int(i < good)))
        return rows

    def cutoffs(rows):
        docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id bigint, text string, lang string")
        labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
        measured = quality.measure(docs.select("doc_id", quality.strata(docs, "lang").alias("stratum"), "text"), ["doc_id", "stratum"], True)
        return sorted(map(tuple, quality.certified_cutoffs(measured, labels).collect()))

    small, large = table_of(300, 100), table_of(900, 300)
    once = cutoffs(small)
    assert [x[1] for x in once] == [None]
    assert cutoffs([(i + 10_000 * k, t, q) for k in range(3) for i, t, q in small]) == once
    once = cutoffs(large)
    assert any(x[1] is not None for x in once)
    assert cutoffs([(i + 10_000 * k, t, q) for k in range(3) for i, t, q in large]) == once


def test_the_risk_holds_over_many_draws():
    """Labels drawn again and again from rule values whose true rejections are known: at most `doubt` of the certified cutoffs lose more than `risk`."""
    r = np.random.default_rng(6)
    broken = certified = 0
    risk, doubt, n = 0.02, 0.05, 400
    for _ in range(300):
        good = r.geometric(0.02, (2, n))  # halves; P(value > v) = 0.98 ** v
        bad = r.geometric(0.004, (2, n // 4))
        values, counts = np.unique(np.concatenate((good[0], bad[0])), return_counts=True)
        frame = pd.DataFrame({"stratum": "s", "rule": "marks", "value": values, "good": [(good[0] == v).sum() for v in values]})
        frame["bad"] = counts - frame["good"]
        proposed = quality.propose(frame)
        cut = proposed["marks"].fillna(np.inf).to_numpy()
        tried = pd.DataFrame({"stratum": "s", "level": range(len(cut)), "good": n, "lost": [(good[1] > c).sum() for c in cut], "caught": [(bad[1] > c).sum() for c in cut]})
        best = quality.certify(tried, doubt / len(quality.LEVELS), risk)
        if len(best) and np.isfinite(cut[best["level"].iloc[0]]):
            certified += 1
            broken += 0.98 ** math.floor(cut[best["level"].iloc[0]]) > risk
    assert certified > 100 and broken <= doubt * 300


def test_proposed_cutoffs(spark):
    """Against a plain search: the least of the values that the level's share of good documents may exceed, and halfway up to the next bad one."""
    r = random.Random(8)
    values = [(r.randrange(40), int(r.random() < 0.7)) for _ in range(900)] + [(v, 0) for v in range(30, 60)]
    frame = pd.DataFrame([("s", "marks", v, g, b) for v, (g, b) in {v: (sum(q for x, q in values if x == v), sum(1 - q for x, q in values if x == v)) for v, _ in values}.items()], columns=["stratum", "rule", "value", "good", "bad"])
    found = quality.propose(frame)
    good, bad = [v for v, q in values if q], [v for v, q in values if not q]
    for level, share in enumerate(quality.LEVELS):
        safe = min(v for v in good if sum(g > v for g in good) <= int(share * len(good)))
        assert found["marks"][level] == (safe + min(v for v in bad if v > safe)) / 2
    assert found["symbols"].isna().all()


# --- 5 chat


odd_text = st.text(alphabet="<|\\>im_startend\nab é", max_size=20) | st.text(max_size=12) | st.text(alphabet="\0\1\\n\n<|", max_size=8)


@given(st.lists(st.tuples(odd_text, odd_text), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_chat_round_trip(turns):
    roles, texts = (pa.array(x, pa.string()) for x in zip(*turns, strict=True))
    content = chat.escaped(texts)
    assert chat.unescaped_role(chat.escaped_role(pa.array(["\0\1", "\\n", "\\\n", "<\\|n"]))).to_pylist() == ["\0\1", "\\n", "\\\n", "<\\|n"]
    column, at = chat.assemble([chat.OPEN, chat.escaped_role(roles), b"\n", content, chat.CLOSE], len(turns))
    ends = at[3] + chat._content(content)[2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(turns)))] * 2 + [column, pa.array(at[3]), pa.array(ends)], list("abcde"))
    assert chat.read_turns(batch) == [roles.to_pylist(), texts.to_pylist(), texts.to_pylist()]


def test_chat_digest(spark):
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", "<|im_end|>"), (1, 1, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "é"), (-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    assert len(found) == 4
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0]))
        own = [x for _, r, x in turns if r == "assistant"]
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (sum(map(len, own)), hashlib.sha256("".join(own).encode()).hexdigest())
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


# --- 6 sharding


@given(st.lists(st.integers(1, 30), min_size=1, max_size=14), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_smallest_capacity(sizes, shards):
    capacity, cuts = sharding.smallest_capacity(sizes, shards)

    def needs(c):
        n, room = 1, c
        for i, s in enumerate(sizes):
            if s > c:
                n, room = n + (i > 0), 0
            elif s > room:
                n, room = n + 1, c - s
            else:
                room -= s
        return n

    assert needs(capacity) <= shards and (capacity == 0 or needs(capacity - 1) > shards)
    assert len(cuts) < shards


@pytest.mark.parametrize(("hot", "first_bits", "step_bits", "at_once"), [(0, 5, 4, 20_000), (3_000_000, 6, 4, 12)])
def test_minimax_bounds_are_exact(spark, hot, first_bits, step_bits, at_once):
    """Also with one group of a third of all bytes and another of a tenth that lie close to others, and with few intervals split at a time."""
    r = random.Random(1)
    hashes = sorted({r.getrandbits(64) for _ in range(2000)})
    sizes = [r.randrange(16, 4000) for _ in hashes]
    sizes[701] += hot
    sizes[703] += hot // 4
    signed = [(h - (1 << 64) if h >> 63 else h, s) for h, s in zip(hashes, sizes, strict=True)]
    groups = spark.createDataFrame(signed, "h bigint, size bigint").cache()
    bounds = sharding.minimax_bounds(groups, 8, first_bits, step_bits, at_once)
    capacity, cuts = sharding.smallest_capacity(sizes, 8)
    cell = lambda b: sum(h < b for h in hashes)
    assert [cell(b) for b in bounds] == cuts
    groups.unpersist()


def test_shards(docs, rows, no_docs):
    found = sharding.shard_by_bytes(docs, 6).collect()
    same_multiset([tuple(r)[:3] for r in found], [(r[0], len((r[1] or "").encode()) + 16, crc((r[1] or "").encode())) for r in rows])
    for members in by_id(found, "shard").values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    assert all(len({r.shard for r in same}) == 1 for same in by_id(found, "text_crc32").values())
    assert sharding.shard_by_bytes(no_docs).count() == 0


# --- 7 byte BPE


@pytest.fixture(scope="module")
def rank_file():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def tiktoken_encoding(rank_file):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows, no_docs, rank_file, tiktoken_encoding):
    found = bpe.encode_digest(docs, rank_file, public_tokenizers.PATTERN).collect()
    want = []
    for r in rows:
        ids = tiktoken_encoding.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same_multiset([tuple(r) for r in found], want)
    assert bpe.encode(no_docs, rank_file, public_tokenizers.PATTERN).count() == 0


@given(st.lists(st.text(alphabet="theing é\n12'_", min_size=1, max_size=400), min_size=1, max_size=8))
@settings(max_examples=40, deadline=None)
def test_segment_tree_merges(rank_file, tiktoken_encoding, pieces):
    if not hasattr(test_segment_tree_merges, "ranks"):
        test_segment_tree_merges.ranks = bpe.Ranks(rank_file)
    into = {}
    bpe.merge_all([(p, p.encode()) for p in pieces], test_segment_tree_merges.ranks, into)
    for p in pieces:
        assert np.frombuffer(into[p], "<u4").tolist() == tiktoken_encoding._core_bpe.encode_single_piece(p.encode())


# --- 8 html


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body><nav><ul><li><a href=/a>home</a></li></ul></nav>
<div class="ad">Buy it now, really.</div><header><p>Site, name.</p></header><aside>About us, here.</aside><article><h1>A  title &amp; more</h1><p><b>First,<br> part&nbsp;one.<p>Second &lt;b&gt; part.</p>
<ul><li>item</li></ul><form><input value=1>Search, now</form><div class="comments"><p>I think, so.</p></div><!-- <p>no</p> --></article><footer>&copy; us</footer>"""


def test_html():
    assert html.main_text(PAGE) == "A title & more\nFirst, part one.\nSecond <b> part.\nitem"
    assert html.main_text("") == "" and html.main_text("<nav><a href=x>y</a></nav>") == ""
    assert html.main_text("plain, text &amp; <b>bold</b>") == "plain, text & bold"
    assert html.main_text("<p>unclosed <a href='x") != None  # noqa: E711


LEAD = "<h1>Head</h1><p>This is the first long paragraph, with some words. It goes on, and on, until it ends.</p>"


@pytest.mark.parametrize(
    "extra,lines",
    [
        ("<p title='a hidden gem'>Told anyway, here.</p>", ["Told anyway, here."]),
        ("<p data-note='display: none; aria-hidden=true'>Told as well, here.</p>", ["Told as well, here."]),
        ("<p>The sum <math><mi>a</mi><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup></math> is known.</p>", ["The sum a+b2 is known."]),
        ("<p>A drawing <svg><text>of axes</text></svg> and <video src=x>a film</video>.</p>", ["A drawing of axes and a film."]),
        ("<ul><li><a href='/r1'>Smith, 1999. On trees.</a></li><li><a href='/r2'>Jones, 2004. On leaves.</a></li></ul>", ["Smith, 1999. On trees.", "Jones, 2004. On leaves."]),
        ("<div class='a b c'><p>Kept, as it is said.</p></div><div class='a b c sidebar'><p>Gone, as it is said.</p></div>", ["Kept, as it is said."]),
        ("<div class='a b c sidebar'><p>Gone, as it is said.</p></div><div class='a b c'><p>Kept, as it is said.</p></div>", ["Kept, as it is said."]),
        ("<div title='class=sidebar' class=x><p>Kept, whatever a title says.</p></div>", ["Kept, whatever a title says."]),
    ],
)
def test_html_keeps_what_is_not_listed(extra, lines):
    first = ["Head", "This is the first long paragraph, with some words. It goes on, and on, until it ends."]
    assert html.main_text(f"<body><article>{LEAD}{extra}</article></body>").split("\n") == first + lines


QUOTED = st.sampled_from(["class", "id", "role", "title", "data-class", "hidden", "CLASS"])
VALUE = st.text(alphabet="ab -:='\"/><&;", max_size=12)


@given(st.lists(st.tuples(QUOTED, VALUE, st.sampled_from("\"'")), max_size=5))
@settings(max_examples=200, deadline=None)
def test_html_attributes_against_a_plain_reader(parts):
    from html.parser import HTMLParser

    text = " ".join(f"{name}={q}{value.replace(q, '')}{q}" for name, value, q in parts)
    found = {}

    class Plain(HTMLParser):
        def handle_starttag(self, tag, attrs):
            for k, v in attrs:
                found.setdefault(k, v or "")

    Plain().feed(f"<p {text}>")
    assert html.names(f" {text}") == " ".join(found.get(k, "") for k in ("class", "id", "role")).lower().split()


def slow_content(chunks: list[tuple[str, str, str]]) -> list[str]:
    """The content of (path, text, weight group) runs of an article page, plainly: ratios, a Gaussian over neighbours, product, share of the highest."""
    import re

    found = {}
    for path, text, group in chunks:
        chars, marks, n = found.get((path, group), (0, 0, 0))
        found[path, group] = (chars + len("".join(text.split())), marks + len(re.findall("[.,;:!?]", text)), n + 1)
    keys, fused = list(found), {}
    for key in keys:
        mine = [k for k in keys if k[1] == key[1]]
        at, total = mine.index(key), [0.0, 0.0, 0.0]
        for i, k in enumerate(mine):
            if abs(i - at) <= 3:
                w = math.exp(-((i - at) ** 2) / 2)
                c, m, n = found[k]
                total = [total[0] + w, total[1] + w * math.log2(1 + c / n), total[2] + w * math.log2(2 + m / n)]
        prose = key[0].split("/")[-1].split(".")[0] in ("p", "h1", "h2", "li")
        weight = {"in": 1.0, "out": 0.01, "named": 0.01, "both": 0.0001}[key[1]]
        fused[key] = total[1] / total[0] * total[2] / total[0] * weight * (3 if prose else 1)
    bar = 0.04 * max(fused.values())
    return [text for path, text, group in chunks if fused[path, group] >= bar]


def test_html_ratios_by_brute_force():
    r = random.Random(6)
    for _ in range(60):
        sentence = lambda most: "".join(r.choice(["word ", "more, ", "end. ", "x ", "why? "]) for _ in range(r.randrange(1, most)))
        parts, chunks = [], []
        for _ in range(r.randrange(1, 12)):
            kind = r.randrange(6)
            text = sentence(40)
            if kind == 0:
                parts.append(f"<div class=note{kind}>{text}</div>")
                chunks.append(("div.note", text, "in"))
            elif kind == 1:
                parts.append(f"<div class='comments'>{text}</div>")
                chunks.append(("div.comments", text, "named"))
            else:
                tag = ("h1", "p", "li", "h2")[kind - 2]
                parts.append(f"<{tag}>{text}</{tag}>")
                chunks.append((tag, text, "in"))
        before, after = sentence(9), sentence(60)
        page = f"<body><div class=ad>{before}</div><article>{''.join(parts)}</article><div>{after}</div></body>"
        chunks = [("div.ad", before, "both"), *chunks, ("div", after, "out")]
        assert html.main_text(page).split("\n") == [" ".join(x.split()) for x in slow_content(chunks)]


def test_html_names_only_weigh():
    long = "Long text, which goes on, and on. And more of it, then."
    assert html.main_text(f"<div class='page comments-enabled'><div class=content><p>{long}</p></div></div>") == long
    assert html.main_text(f"<body class=comments><div class='comment-list ad'><p>{long}</p></div></body>") == long
    assert html.main_text(f"<div class='social-sciences'><p>{long}</p></div>") == long
    assert html.main_text(f"<article><div class='section-header'><h2>Heading</h2></div><p>{long}</p></article>") == f"Heading\n{long}"
    assert html.main_text(f"<main><p>{long}</p><div class='related-work'><h2>Related</h2><p>Others, too.</p></div></main>") == f"{long}\nRelated\nOthers, too."
    assert html.main_text(f"<div><h1>Title</h1><p>{long}</p></div><div class='cookie-notice'>We use cookies, as all do. Fine?</div><div>Copyright 2020</div>") == f"Title\n{long}"
    assert "cookies" in html.main_text(f"<div><p>{long}</p></div><div class='cookie-notice'>We use cookies.</div>", share=0.0)


def test_html_of_deep_and_broken_pages():
    import tracemalloc

    tracemalloc.start()
    assert html.main_text("<div>" * 100_000 + "deep, text." + "</div>" * 100_000) == "deep, text."
    assert html.main_text("<b>" * 30_000 + "</i></p></x>" * 30_000 + "<p>x" * 30_000).count("x") == 30_000
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, "c"), (None, "u", "", None), (1, "u", PAGE, "c")], "page_id bigint, url string, html string, text string")
    found = html.extract(df).collect()
    assert sorted((r.n_chars for r in found)) == [0, 0, 53, 53] and {len(r.text) == r.n_chars for r in found} == {True}
    assert html.extract(df.limit(0)).count() == 0


# --- 9 language


def slow_cost(train: list[bytes], text: bytes, order: int) -> float:
    after = defaultdict(Counter)
    for t in train:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                after[t[i - k : i]][t[i]] += 1
    total, t = 0.0, b"\0" * order + text
    for i in range(order, len(t)):
        for k in range(order, -1, -1):
            c = after.get(t[i - k : i])
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if t[i] in c:
                total -= math.log(c[t[i]] / (n + q))
                break
            total -= math.log(q / (n + q))
        else:
            total += math.log(256)
    return total


def test_ppm_costs(spark):
    train = [("en", "The cat sat"), ("en", "a cat, the hat"), ("de", "die Katze saß"), ("de", "Der Hut"), (None, "zzz"), ("fr", None)]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id bigint, text string, lang string")
    trees = langid.learn(df, 3)
    assert trees.langs == ["de", "en"]
    probes = ["the cat", "Katze", "", "q", "die hat 中", "The cat sat"]
    costs, _ = trees.score(pa.array(probes))
    for i, x in enumerate(["de", "en"]):
        mine = [t.encode().lower() for lang, t in train if lang == x]
        assert costs[:, i] == pytest.approx([slow_cost(mine, p.encode().lower(), 3) for p in probes], rel=1e-5)


def test_trees_keep_small_languages(spark):
    """More rows than 2^20 of a large language, each more frequent than the rows of a small one."""
    many = spark.range((1 << 20) + 5).select(F.lit("en").alias("lang"), (F.col("id") + 1000).alias("code"), F.lit(3).cast("bigint").alias("n"))
    few = spark.createDataFrame([("de", 1, 1), ("de", 2, 2)], "lang string, code bigint, n bigint")
    trees = langid.collect_trees(many.unionByName(few))
    assert trees.langs == ["de", "en"] and len(trees.table.codes) == (1 << 20) + 7
    total = lambda k, i: sum(np.exp(-trees.costs(np.array([c], np.uint64))[0, i]) for c in k)
    assert total([1], 0) == pytest.approx(1 / 5) and total([2], 0) == pytest.approx(2 / 5)


def test_training_sample_and_score(spark):
    """A sample bounded in bytes, of each language; it tells languages as all texts do, and a text of two languages gets a lower score."""
    r = random.Random(2)
    make = lambda x: " ".join("".join(r.choice(x) for _ in range(r.randrange(2, 8))) for _ in range(60))
    rows = [(i, make("abcde" if i % 3 else "defgh"), "one" if i % 3 else "two") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    size = {x: sum(len(t) for _, t, y in rows if y == x) for x in ("one", "two")}
    bound = size["two"] // 4
    found = langid.training_sample(df, bound).collect()
    assert all(0.7 * bound < sum(len(x.text) for x in found if x.lang == y) < 1.3 * bound for y in ("one", "two"))
    assert langid.training_sample(df, 10**9).count() == 900
    trees = langid.learn(df, most_bytes=bound)
    told = {x.doc_id: x for x in langid.identify(df.unionByName(spark.createDataFrame([(-1, rows[0][1][:150] + " " + rows[1][1][:150], None)], df.schema)), trees).collect()}
    assert all(told[i].lang_pred == y and told[i].score > 0.9 for i, _, y in rows) and told[-1].score < min(told[i].score for i, _, _ in rows)


def test_identify(docs, rows, no_docs):
    trees = langid.learn(docs)
    found = langid.identify(docs, trees).collect()
    assert len(found) == len(rows)
    named = by_id(found)
    assert {r.lang_pred for i in (0, 1, 2, 3) for r in named[i]} == {"und"}
    assert all(0 <= r.score <= 1 and r.lang_pred in ("und", "en", "de") for r in found)
    none = langid.learn(no_docs)
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"} and langid.identify(no_docs, trees).count() == 0


# --- 10 language model


def slow_ctw(train: list[bytes], text: bytes, depth: int) -> float:
    """Log10 probability by the recursion over nodes, plainly."""
    counts = defaultdict(lambda: [0, 0])
    for t in train:
        t = b"\0" * depth + t + b"\0"
        for i in range(depth, len(t)):
            for j in range(8):
                for d in range(depth + 1):
                    counts[d, t[i - d : i], t[i] >> (8 - j) | 1 << j][t[i] >> (7 - j) & 1] += 1
    kids = defaultdict(list)
    for d, c, u in counts:
        if d:
            kids[d - 1, c[1:], u].append((d, c, u))
    block = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}
    for node in sorted(counts, key=lambda n: -n[0]):
        own = block(*counts[node])
        below = sum(weighted[k] for k in kids[node])
        weighted[node] = own if node[0] == depth else np.logaddexp(own, below) - math.log(2)
    total, t = 0.0, b"\0" * depth + text + b"\0"
    for i in range(depth, len(t)):
        for j in range(8):
            path = []
            for d in range(depth + 1):
                node = (d, t[i - d : i], t[i] >> (8 - j) | 1 << j)
                if node not in counts:
                    break
                path.append(node)
            p = 0.5
            for n, node in enumerate(reversed(path)):
                a, b = counts[node]
                estimate = (b + 0.5) / (a + b + 1)
                if n == 0:
                    p = estimate
                else:
                    beta = math.exp(block(a, b) - math.log(2) - weighted[node])
                    p = beta * estimate + (1 - beta) * p
            total += math.log10(p if t[i] >> (7 - j) & 1 else 1 - p)
    return total


def test_lm_scores(spark, docs, rows, no_docs):
    small = [(r[0], r[1][:3000] if r[1] else r[1]) for r in rows]
    df = spark.createDataFrame([(i, t, "x") for i, t in small], "doc_id bigint, text string, held string").repartition(3)
    held = F.col("doc_id") % 4 == 2
    found = ctw.lm_scores(df, held, depth=2, buckets=5, fan_in=2).collect()
    is_held = lambda i: i is None or i % 4 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in small if not is_held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    train = [(t or "").encode().lower() for i, t in small if not is_held(i)]
    want = []
    scores = {}
    for i, t in small:
        w = tokens(t)
        want.append((i, is_held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
        if t is None or len(t) < 60:
            scores[t] = slow_ctw(train, (t or "").encode().lower(), 2)
    same_multiset([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found], want)
    texts = {i: t for i, t in small if i is not None}
    for r in found:
        if r.doc_id is not None and texts[r.doc_id] in scores:
            assert r.score == pytest.approx(scores[texts[r.doc_id]], rel=1e-5)
    assert ctw.lm_scores(no_docs, F.lit(False)).count() == 0
    assert ctw.lm_scores(df, F.lit(True), depth=2).first().train_tokens == 0


def test_lm_scores_below_the_shared_contexts(spark):
    train = [" ".join(f"w{i * k % 17}" for i in range(12)) for k in range(1, 9)]
    asked = ["w3 w6 zebra w1", "Ü \x00 w16", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(train + asked)], "doc_id bigint, text string").repartition(3)
    for depth in (0, 1, 4):
        found = {r.doc_id: r.score for r in ctw.lm_scores(df, F.col("doc_id") >= len(train), depth=depth, buckets=7).collect()}
        for i, t in enumerate(train + asked):
            assert found[i] == pytest.approx(slow_ctw([x.encode() for x in train], t.encode().lower(), depth), rel=1e-5)


def test_lm_scores_keep_every_ngram(spark):
    """More distinct n-grams than 2^20, nearly all of them seen once: as told by one machine that holds them all."""
    letters = np.random.default_rng(1).integers(97, 123, 1_400_000, dtype=np.uint8).tobytes()
    train = [letters[i : i + 100_000].decode() for i in range(0, len(letters), 100_000)]
    asked = [train[3][500:600], "zz top", letters[::-1][:80].decode()]
    codes, n = common.run_lengths(common.training_codes(pa.array(train), 5, 1))
    assert len(codes) > 1 << 20
    want, _ = common.run_lengths(common.training_codes(pa.array(asked), 5, 1))
    every = np.union1d(codes, want)
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, codes)] = n
    logs = ctw.log10_probabilities(every, counts, 5, ctw.Top(*[np.zeros(0)] * 4, 0))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(train + asked)], "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: r.score for r in ctw.lm_scores(df, F.col("doc_id") >= len(train)).where(F.col("doc_id") >= len(train)).collect()}
    for i, t in enumerate(asked):
        mine = common.training_codes(pa.array([t]), 5, 1)
        assert found[len(train) + i] == pytest.approx(logs[np.searchsorted(every, mine)].sum(), rel=1e-5)
    assert found[len(train)] > -0.9 * 101 * 2.4  # a text learned from is no even guess


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3 + 0.5, 1e8])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)


@given(st.lists(st.integers(0, 2**40), max_size=300))
def test_code_table_and_packing_of_integers(values):
    codes = np.unique(np.array(values, np.uint64))
    t = common.CodeTable(codes, np.ones(len(codes)))
    probe = np.array([*values, 5, 2**41], np.uint64)
    want = {int(c): i for i, c in enumerate(codes)}
    assert t.find(probe).tolist() == [want.get(int(p), -1) for p in probe]
    assert common.unpacked(common.packed(probe), np.uint64).tolist() == probe.tolist()


# --- 11 source divergence


def brute_divergence(rows):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(fold))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen, total, groups = Counter(), Counter(), defaultdict(Counter)
        for _, source, terms in mine:
            seen.update(set(terms))
            total.update(terms)
            groups[source].update(terms)
        kept = [t for t in total if seen[t] >= 3]
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            term = sorted(((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]))[:200]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("tile,block", [(128, 2048), (2, 5)])
def test_divergence(spark, no_docs, monkeypatch, tile, block):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK", block)
    r = random.Random(7)
    pool = [f"{a}{b}" for a in "abcdefghijkl" for b in ("x", "É", "ZZ", "中")] + ["don't", "x1y", ""]
    rows = [(k, " ".join(r.choices(pool, k=r.randrange(60))), r.choice(["en", "de", None]), r.choice(["s", "t", "u", None, "vé", "w"]), 7) for k in range(80)]
    rows += [(None, None, "fr", "a", 1), (1, "only once", "fr", "b", 1), (2, "", "xx", None, 1), *[(3, "same same SAME", "one", "a", 1)] * 3, (4, "alone", None, "alone", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, value bigint").repartition(3)
    found = [tuple(x) for x in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    same_multiset(found, brute_divergence(rows))
    assert not divergence.audit(no_docs).count()


def test_divergence_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randrange(1, 1 << r.randrange(1, 53))
        count = r.randrange(1, total + 1)
        assert int(divergence.shares(np.array([count]), np.array([total]))[0]) == 1 + 1_000_000_000 * count // total


def test_divergence_keeps_the_best_terms(spark):
    rows = [(k, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400) for _ in range(1 + (i * k) % 3)), "en", f"s{k % 4}") for k in range(12)]
    found = [tuple(x) for x in divergence.audit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).select("lang", "source", "part", "item", "value", "rank").collect()]
    same_multiset(found, brute_divergence(rows))


# --- 12 importance resampling


def brute_resampling(rows, target, percent=5):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(fold))
        return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    bucket = lambda fs: Counter(zlib.crc32(f.encode()) % 10_000 for f in fs)
    mine = [(i, *features(t)) for i, t in rows]
    s, t = sum((bucket(f) for _, _, f in mine), Counter()), sum((bucket(features(x)[1]) for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1.0) * (big_s + 10_000.0) / ((s[k] + 1.0) * (big_t + 10_000.0))))
    out = []
    for i, n, f in mine:
        weight = sum(gain(k) * c for k, c in bucket(f).items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return [(*r[:4], k) for k, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in [*able[len(drawn) :], *(r for r in out if r[4] < 20)]]


@pytest.mark.parametrize("some", [{}, {"samples": 20, "merged": 7, "percent": 40}, {"samples": 3, "merged": 1, "percent": 100}])
def test_resampling(spark, docs, rows, no_docs, some):
    target = ["w1 w2 w3 don't", None, "w1 w2 É", " ".join(f"w{k}" for k in range(60))]
    benchmark = spark.createDataFrame([(t, k) for k, t in enumerate(target)], "text string, score int")
    found = resample.draw(resample.weigh(docs, benchmark), **some).collect()
    same_multiset(map(tuple, found), brute_resampling([(r[0], r[1]) for r in rows], target, some.get("percent", 5)))
    assert not resample.draw(resample.weigh(no_docs, benchmark), **some).count()


def test_resampling_splits_ties(spark):
    """A third of the rows share an id, so a score; the draw ends among them."""
    rows = [(7, "a b c d e f g h i j k l m n o p q r s t u")] * 100 + [(k, " ".join(f"v{(k * j) % 50}" for j in range(25))) for k in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = resample.draw(resample.weigh(df, df.limit(3)), 50, samples=60, merged=10).where("rank is not null").collect()
    assert sorted(r.rank for r in found) == list(range(1, 151))
    assert [(-r.score, r.doc_id) for r in sorted(found, key=lambda r: r.rank)] == sorted((-r.score, r.doc_id) for r in found)


@given(st.lists(st.binary(min_size=1, max_size=200), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_crc_of_joined_strings(parts):
    joined = resample.Crc()
    state = np.array([zlib.crc32(parts[0])], np.uint32)
    for p in parts[1:]:
        state = joined.shifted(state, np.array([len(p)])) ^ np.uint32(zlib.crc32(p))
    assert int(state[0]) == zlib.crc32(b"".join(parts))


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
@settings(max_examples=60, deadline=None)
def test_tournament(runs):
    assert list(resample.Tournament([[(x,) for x in sorted(r)] for r in runs])) == [(x,) for x in sorted(sum(runs, []))]


# --- 13 suffix-array dedup


def brute_repeats(rows):
    docs = [(-(1 << 63) if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, _, b in docs:
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = []
    for i, name, b in docs:
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p : p + 100] = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone))))
        out.append((name, len(b), tuple(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])))
    return out


@pytest.mark.parametrize("some", [{}, {"often": 20}, {"often": 20, "sorted_bytes": 2000}])
def test_suffix_dedup(spark, docs, rows, no_docs, some):
    r = random.Random(3)
    line, base = " ".join(words(5, 12)), " ".join(words(6, 300))
    extra = [(2000 + k, " ".join(words(k, r.randrange(60))) + line + " " + line + " ".join(words(k + 500, r.randrange(100)))) for k in range(150)]
    extra += [(3000, "ab" * 3000), (3001, "z" * 150), (3002, " ".join(words(7, 40)) + "ab ab " * 40), (3003, "abcdefghi" * 18 + "end"), (3004, "é中" * 300), (3005, base + base[:99]), (3006, base[50:150]), (3007, base[50:149]), (3008, base[20:]), (3009, base), (3009, base), (3009, base[7:])]
    mine = spark.createDataFrame(extra, "doc_id bigint, text string")
    all_docs = docs.select("doc_id", "text", F.lit("clash").alias("spans"), F.lit(1).alias("batch")).unionByName(mine, allowMissingColumns=True).repartition(4)
    found = suffix.remove_repeats(all_docs, **some).collect()
    same_multiset([(x.doc_id, x.n_bytes, tuple((s.start, s.stop) for s in x.spans), bytes(x.kept)) for x in found], brute_repeats([(x[0], x[1]) for x in rows] + extra))
    assert not suffix.remove_repeats(no_docs).count()


@pytest.mark.parametrize("most", [1 << 18, 300])
def test_blockwise_suffix_order(most):
    r = np.random.default_rng(2)
    data = np.concatenate([np.tile(r.integers(97, 99, n).astype(np.uint8), k) for n, k in ((40, 9), (300, 3), (7, 60), (1000, 1), (300, 2))] + [np.zeros(200, np.uint8)])
    raw, at = data.tobytes(), np.arange(len(data) - 299)
    seen, before = [], None
    for mine, same in suffix.equal_windows(data, at, most):
        for j, s in zip(mine.tolist(), same.tolist(), strict=True):
            window = raw[j : j + 100]
            assert s == (window == before)
            seen.append(window)
            before = window
    assert seen == sorted(raw[j : j + 100] for j in at.tolist())
