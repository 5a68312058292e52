"""Suffix-array dedup (operator 13): removes each byte of a 100-byte string that starts earlier as well.

A window is a 100-byte string at one place. Its anchor is the least hash among its 16-byte grams, so equal windows have equal anchors,
and some forty neighbouring windows share one: a stretch. First each batch of documents sends its anchors with a digest of the stretch. An anchor
that occurs once, or always in the same stretch, needs no more: its windows are unique, or repeats but for the earliest stretch.
The stretches of the other anchors, the earliest of each text, travel as text, dealt by anchor, so that all
occurrences of a window meet in one task. That task takes whole anchors, a few MB of text at a time, and sorts their suffixes
blockwise: the ranks of a difference cover's suffixes are worked out first, then one bucket of suffixes at a time is sorted by
eight bytes and, where these tie, by the cover ranks at the distance that both suffixes share. Equal windows are then neighbours.

A batch sends an anchor once, whatever it has of it, so that a frequent one is merged before it travels. Stretches of an
anchor that has very many are dealt window by window, by the hash of the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.common import as_bytes, chunks, materialise, ragged, run_lengths, table

WINDOW, GRAM = 100, 16
GRAMS = WINDOW - GRAM + 1
#: Bytes of a batch of documents and of the text that is sorted at once; windows of a bucket.
BATCH, SORTED, BUCKET = 4 << 20, 4 << 20, 1 << 18
#: Windows of a stretch at most, so few that the first and the last hold all its bytes; stretches of an anchor beyond which its windows are dealt one by one.
STRETCH, OFTEN = 96, 1 << 15
#: How well texts are compressed that travel.
LEVEL = 3
#: What becomes of a batch's stretches of an anchor.
GONE, SENT_ON, SPREAD = 1, 2, 3
#: Every difference modulo 7 is one between two of these.
COVER, PERIOD = (0, 1, 3), 7
SHARED = [[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)]
NO_ID = -(1 << 63)
ANCHOR = "anchor bigint, body bigint, doc_id bigint, start bigint, batch bigint, place int, n int"
ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

BATCHES = "batch bigint, doc_id array<bigint>, size array<bigint>, texts binary"
SENT = "kind int, key bigint, body binary, doc_id bigint, batch bigint, doc int, start bigint, windows int"
SPANS = "batch bigint, doc int, start bigint, stop bigint"
RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def words_at(data: np.ndarray, at: np.ndarray | None = None, order: str = "<") -> np.ndarray:
    """The eight bytes at each place, as a number."""
    view = np.ndarray((max(0, len(data) - 7),), f"{order}u8", data, 0, (1,))
    return view.astype(np.uint64) if at is None else view[at].astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= ODD[2]
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash, never 0, of the GRAM bytes at each place."""
    word = words_at(data)
    return mixed(word[:-8] * ODD[0] ^ (word[8:] * ODD[1] >> np.uint64(3))) | np.uint64(1)


def sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of each `width` neighbours."""
    n, reach = len(values) - width + 1, 1
    while reach * 2 <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    return best(values[:n], values[width - reach : width - reach + n])


def window_anchors(data: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """For each place, the least hash of the grams within the window that starts there."""
    windows = len(data) - WINDOW + 1
    out = np.empty(max(0, windows), np.uint64)
    for at in range(0, windows, block):
        stop = min(at + block, windows)
        out[at:stop] = sliding(np.minimum, gram_hashes(data[at : stop + WINDOW - 1]), GRAMS)
    return out


def anchor_counts(data: np.ndarray, sizes: np.ndarray, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of texts that lie one after another in data, and at how many places each is the least of a window around it.

    Places count, not stretches: where a text repeats itself within a few bytes, equal windows lie in one stretch.
    """
    inside = np.maximum(sizes - WINDOW + 1, 0)
    place = ragged(np.cumsum(sizes) - sizes, inside)
    around = np.zeros(max(0, len(data) - GRAM + GRAMS), np.uint64)
    around[place + GRAMS - 1] = window_anchors(data)[place]
    found = [np.zeros(0, np.uint64)]
    for at in range(0, len(data) - GRAM + 1 if len(place) else 0, block):
        stop = min(at + block, len(data) - GRAM + 1)
        own = gram_hashes(data[at : stop + GRAM - 1])
        found.append(own[own == sliding(np.maximum, around[at : stop + GRAMS - 1], GRAMS)])
    return run_lengths(np.concatenate(found))


def stretches(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window's place in data, windows, anchor) of each stretch of texts that lie one after another in data."""
    ends = np.cumsum(sizes)
    inside = np.maximum(sizes - WINDOW + 1, 0)
    place = ragged(ends - sizes, inside)
    anchor = window_anchors(data)[place]
    doc = np.repeat(np.arange(len(sizes)), inside)
    if not len(place):
        return doc, place, place, anchor
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(place)))
    parts = -(-windows // STRETCH)
    first = np.repeat(first, parts) + STRETCH * ragged(np.zeros(len(parts), np.int64), parts)
    windows = np.diff(np.append(first, len(place)))
    return doc[first], place[first], windows, anchor[first]


def pack(docs: DataFrame) -> DataFrame:
    """BATCHES: the whole texts of docs, compressed, some MB a row (or one longer text). Null texts are empty."""

    def run(batches):
        first = (TaskContext.get().partitionId() + 1) << 32
        for k, batch in enumerate(chunks(batches, BATCH)):
            texts = list(as_bytes(batch.column(1)))
            body = b"".join(texts)
            one = lambda v, kind: pa.array([v], kind)
            yield pa.RecordBatch.from_arrays(
                [one(first + k, pa.int64()), one(batch.column(0).to_pylist(), pa.list_(pa.int64())), one([len(t) for t in texts], pa.list_(pa.int64())), one(pa.Codec("zstd", compression_level=LEVEL).compress(body, asbytes=True), pa.binary())],
                [c.split()[0] for c in BATCHES.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, BATCHES)


def texts_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as bytes, and the size of each."""
    sizes = np.array(row["size"], np.int64)
    return np.frombuffer(pa.decompress(row["texts"], int(sizes.sum()), codec="zstd", asbytes=True), np.uint8), sizes


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def owners(row: dict) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in row["doc_id"]], np.int64)


def batch_anchors(row: dict) -> tuple[np.ndarray, ...]:
    """A row for each distinct anchor of a batch, in order: the anchor, the digest of its stretch, the earliest one's document and start, and n.

    n is 1 where all stretches of the anchor are the same text and no two windows in it can be equal. Else it is at least 2, and the digest one of its own.
    """
    data, sizes = texts_of(row)
    doc, place, windows, anchor = stretches(data, sizes)
    known, places = anchor_counts(data, sizes)
    number = np.searchsorted(known, anchor)
    body = mixed(digest(data, place) * ODD[0] ^ digest(data, place + windows - 1)) ^ windows.astype(np.uint64)
    owner, start = owners(row)[doc], place - (np.cumsum(sizes) - sizes)[doc]
    order = np.lexsort((start, owner, body, number))
    first = np.flatnonzero(np.diff(number[order], prepend=-1))
    new = np.ones(len(order), bool)
    new[1:] = (body[order][1:] != body[order][:-1]) | (np.diff(number[order]) != 0)
    texts = np.add.reduceat(new.astype(np.int64), first) if len(first) else first
    # more places than stretches, or a stretch longer than one place reaches: equal windows may lie in one stretch
    inner = (places > np.bincount(number, minlength=len(known))) | (np.maximum.reduceat(windows[order], first) > GRAMS if len(first) else False)
    n = np.where(inner | (texts > 1), np.maximum(texts, 2), 1)
    mine = order[first]
    own = mixed((known ^ np.uint64(row["batch"])) * ODD[1])
    return known, np.where(n > 1, own, body[mine]), owner[mine], start[mine], n


def repeated_anchors(packed: DataFrame, often: int) -> DataFrame:
    """batch, told: for the anchors of a batch that occur elsewhere too, 4 * their number among its distinct anchors + what becomes of their stretches.

    GONE: all, as the same text has an earlier one elsewhere. SENT_ON: the earliest of each text is compared with others. SPREAD: likewise, but window by
    window, as the anchor has more than `often` texts.
    """

    def find(batches):
        for row in rows_of(batches):
            anchor, body, owner, start, n = batch_anchors(row)
            columns = [anchor.view(np.int64), body.view(np.int64), owner, start, np.full(len(anchor), row["batch"]), np.arange(len(anchor), dtype=np.int32), np.minimum(n, 1 << 30).astype(np.int32)]
            for at in range(0, len(anchor), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], [c.split()[0] for c in ANCHOR.split(", ")])

    def tell(rows, some, what):
        return pa.RecordBatch.from_arrays([pa.array(rows[4][some]), pa.array((4 * rows[5][some] + what).astype(np.int32))], ["batch", "told"])

    def decide(batches):
        """Rows by anchor and digest, the earliest first. Of the last anchor the first row of each digest waits until it is known how many there are."""
        wait = [np.zeros(0, np.int64) for _ in ANCHOR.split(",")] + [np.zeros(0, bool)]  # the last: told already
        hot = None

        def settle(rows, edge, end):
            """What is told of whole anchors, the rows before `end`."""
            nonlocal hot
            group = np.searchsorted(edge, np.arange(end), "right") - 1
            firsts = np.ones(len(rows[0]), bool)
            firsts[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            total = np.bincount(group, (rows[6] * firsts)[:end]).astype(np.int64)[group]
            frequent = (total > often) | (rows[0][:end] == hot if hot is not None else False)
            left = ~rows[7][:end]
            for what, some in ((SPREAD, frequent & left), (SENT_ON, ~frequent & (total > 1) & left)):
                if some.any():
                    yield tell(rows, np.flatnonzero(some), what)

        for b in batches:
            rows = [np.concatenate((w, b.column(k).to_numpy() if k < 7 else np.zeros(b.num_rows, bool))) for k, w in enumerate(wait)]
            if not len(rows[0]):
                continue
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            gone = (rows[2] != rows[2][first]) | (rows[3] != rows[3][first])
            if gone.any():
                yield tell(rows, np.flatnonzero(gone), GONE)
                rows = [r[~gone] for r in rows]
            edge = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
            end = int(edge[-1])
            if end:
                yield from settle(rows, edge, end)
            rows = [r[end:] for r in rows]
            hot = hot if hot == int(rows[0][0]) else None
            if hot is not None or rows[6].sum() > often:
                hot = int(rows[0][0])
                yield from settle(rows, np.zeros(1, np.int64), len(rows[0]))
                rows = [r[-1:] for r in rows]
                rows[7] = np.ones(1, bool)
            wait = rows
        if len(wait[0]):
            yield from settle(wait, np.zeros(1, np.int64), len(wait[0]))

    order = ["anchor", "body", "doc_id", "start"]
    found = packed.mapInArrow(find, ANCHOR).repartition("anchor").sortWithinPartitions(*order)
    return found.mapInArrow(decide, "batch bigint, told int").groupBy("batch").agg(F.collect_list("told").alias("told"))


def earliest(keys: list, places: list[tuple]) -> np.ndarray:
    """Whether each item is the earliest of its key; items at one place are one."""
    best: dict = {}
    for key, place in zip(keys, places, strict=True):
        before = best.get(key)
        if before is None or place < before:
            best[key] = place
    return np.array([best[key] == place for key, place in zip(keys, places, strict=True)], bool)


def joined_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch, as one."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    shift = doc.astype(np.int64) << 40
    reach = np.maximum.accumulate(shift + stop) if len(doc) else stop
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - shift)[np.append(first[1:], len(doc)) - 1] if len(first) else stop[:0]


def sent(packed: DataFrame, repeated: DataFrame) -> DataFrame:
    """SENT: kind 1 are stretches to be sorted with those of the same key; kind 0 are spans that a batch knows itself to be repeats."""

    def run(batches):
        for row in rows_of(batches):
            data, sizes = texts_of(row)
            doc, place, windows, anchor = stretches(data, sizes)
            number = np.unique(anchor, return_inverse=True)[1]
            told = np.array(row["told"] or (), np.int64)
            kind = np.zeros(len(anchor) and number.max() + 1, np.int8)
            kind[told >> 2] = told & 3
            kind = kind[number]
            start = place - (np.cumsum(sizes) - sizes)[doc]
            over = [(doc[kind == GONE], start[kind == GONE], (start + windows + WINDOW - 1)[kind == GONE])]
            hot = np.flatnonzero(kind == SPREAD)
            once = ragged(place[hot], windows[hot])
            # anchors of one text that others don't have either: only the earliest of the batch stays, nothing is sent
            here = np.flatnonzero((kind == 0) & (np.bincount(number)[number] > 1)) if len(number) else hot
            some = np.concatenate((here, np.flatnonzero(kind == SENT_ON)))
            key = np.concatenate((anchor[some], digest(data, once)))
            doc = np.concatenate((doc[some], np.repeat(doc[hot], windows[hot])))
            place, windows = np.concatenate((place[some], once)), np.concatenate((windows[some], np.ones(len(once), np.int64)))
            raw = data.tobytes()
            bodies = [raw[p : p + m + WINDOW - 1] for p, m in zip(place.tolist(), windows.tolist(), strict=True)]
            start = place - (np.cumsum(sizes) - sizes)[doc]
            owner = owners(row)[doc]
            first = earliest(bodies, list(zip(owner.tolist(), start.tolist(), strict=True)))
            over.append(tuple(x[~first] for x in (doc, start, start + windows + WINDOW - 1)))
            gone = joined_spans(*map(np.concatenate, zip(*over, strict=True)))
            spread = mixed((np.arange(len(gone[0])) + row["batch"]).astype(np.uint64) * ODD[0])
            first[: len(here)] = False
            yield from sent_rows(1, key[first], [b for b, f in zip(bodies, first, strict=True) if f], owner[first], row["batch"], doc[first], start[first], windows[first])
            yield from sent_rows(0, spread, None, np.zeros(len(spread), np.int64), row["batch"], gone[0], gone[1], gone[2] - gone[1])

    return packed.join(repeated, "batch", "left").mapInArrow(run, SENT)


def sent_rows(kind, key, bodies, owner, batch, doc, start, windows, step: int = 1 << 13):
    for at in range(0, len(key), step):
        n = len(key[at : at + step])
        body = pa.array(bodies[at : at + step], pa.binary()) if bodies is not None else pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(key[at : at + n].view(np.int64)), body, pa.array(owner[at : at + n]), pa.array(np.full(n, batch)), pa.array(doc[at : at + n].astype(np.int32)), pa.array(start[at : at + n]), pa.array(windows[at : at + n].astype(np.int32))],
            [c.split()[0] for c in SENT.split(", ")],
        )


def digest(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole window."""
    h = np.zeros(len(at), np.uint64)
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        h = mixed((h ^ words_at(data, at + k)) * ODD[0])
    return h


def cover_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the WINDOW bytes (or more) at each place of the cover, by doubling; zeros elsewhere. data has spare bytes behind."""
    n = len(data) - WINDOW
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(len(data) + WINDOW, np.int64)
    rank[at] = np.unique(words_at(data, at, ">") >> np.uint64(8), return_inverse=True)[1] + 1
    depth = PERIOD
    while depth < WINDOW:
        rank[at] = np.unique(rank[at] << 32 | rank[at + depth], return_inverse=True)[1] + 1
        depth *= 2
    return rank


def by_cover(at: np.ndarray, run: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How many suffixes of its run lie before each. Suffixes of a run agree on PERIOD bytes at least; a pair is compared at the distance that puts both on the cover."""
    before = np.zeros(len(at), np.int64)
    members = [np.flatnonzero(at % PERIOD == r) for r in range(PERIOD)]
    runs = run.max() + 1 if len(run) else 0
    ahead = [np.concatenate(([0], np.cumsum(np.bincount(run[m], minlength=runs)))) for m in members]
    sorted_at: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def in_order(r: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(run, rank d bytes on) of the suffixes of a residue, sorted, and whose they are."""
        if (r, d) not in sorted_at:
            key = run[members[r]] << 32 | rank[at[members[r]] + d]
            order = np.argsort(key)
            sorted_at[r, d] = key[order], members[r][order]
        return sorted_at[r, d]

    for r in range(PERIOD):
        for s in range(PERIOD):
            if len(members[r]) and len(members[s]):
                want, whose = in_order(r, SHARED[r][s])
                before[whose] += np.searchsorted(in_order(s, SHARED[r][s])[0], want) - ahead[s][run[whose]]
    return before


def equal_windows(data: np.ndarray, at: np.ndarray, most: int = BUCKET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one bucket of suffixes after another: the windows (numbers in `at`) in order, and whether each equals the one before it."""
    rank = cover_ranks(data)
    head = words_at(data, at, ">")
    parts = -(-len(at) // most)
    cuts = np.unique(np.sort(head[:: max(1, len(head) // (64 * parts))])[::64])[1:] if parts > 1 else head[:0]
    bucket = np.searchsorted(cuts, head, "right")
    for k in range(len(cuts) + 1):
        mine = np.flatnonzero(bucket == k)
        mine = mine[np.argsort(head[mine], kind="stable")]
        same = np.zeros(len(mine), bool)
        same[1:] = head[mine[1:]] == head[mine[:-1]]
        tied = same.copy()
        tied[:-1] |= same[1:]
        some = np.flatnonzero(tied)
        if len(some):
            run = np.cumsum(~same[some]) - 1
            order = np.argsort(run << 32 | by_cover(at[mine[some]], run, rank), kind="stable")
            mine[some] = mine[some[order]]
            left = np.flatnonzero(same)
            for step in (*range(8, WINDOW - 8, 8), WINDOW - 8):
                differ = words_at(data, at[mine[left]] + step) != words_at(data, at[mine[left - 1]] + step)
                same[left[differ]] = False
                left = left[~differ]
        yield mine, same


def repeats(rows: pa.Table) -> pa.RecordBatch:
    """SPANS of the windows of some stretches that have an equal one earlier. Whole keys, so that nothing is missing."""
    bodies, key = rows["body"].to_pylist(), rows["key"].to_numpy()
    owner, batch, doc, start, windows = (rows[c].to_numpy().astype(np.int64) for c in ("doc_id", "batch", "doc", "start", "windows"))
    first = earliest(bodies, list(zip(owner.tolist(), start.tolist(), strict=True)))
    again = np.flatnonzero(~first)
    spans = [(again, start[again], start[again] + windows[again] + WINDOW - 1)]
    kept = np.flatnonzero(first)
    data = np.frombuffer(b"".join(bodies[k] for k in kept) + bytes(2 * WINDOW), np.uint8)
    size = windows[kept] + WINDOW - 1
    at = ragged(np.cumsum(size) - size, windows[kept])
    of = np.repeat(kept, windows[kept])
    begins = start[of] + ragged(np.zeros(len(kept), np.int64), windows[kept])
    place = np.unique(owner, return_inverse=True)[1][of] << 40 | begins
    gone = np.zeros(len(at), bool)
    for mine, same in equal_windows(data, at) if len(at) else ():
        edge = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(place[mine], edge), np.diff(np.append(edge, len(mine)))) if len(mine) else mine
        gone[mine] = place[mine] > least
    left = np.flatnonzero(gone)
    spans.append((of[left], begins[left], begins[left] + WINDOW))
    row, begin, end = joined_spans(*(np.concatenate(x) for x in zip(*spans, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array(batch[row]), pa.array(doc[row].astype(np.int32)), pa.array(begin), pa.array(end)], [c.split()[0] for c in SPANS.split(", ")])


def sort_keys(found: DataFrame, most: int) -> DataFrame:
    """SPANS of SENT rows, sorted by kind and key within their partition: whole keys with some `most` bytes of text at a time."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            kind = batch.column(0).to_numpy()
            told = int(np.searchsorted(kind, 1))
            if told:
                b = batch.slice(0, told)
                end = b.column(6).to_numpy() + b.column(7).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(4), b.column(5), b.column(6), pa.array(end)], [c.split()[0] for c in SPANS.split(", ")])
            batch = batch.slice(told)
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= most:
                rows = pa.Table.from_batches(held)
                key = rows["key"].to_numpy()
                edge = np.flatnonzero(key[1:] != key[:-1]) + 1
                whole = int(edge[-1]) if len(edge) else 0
                if whole:
                    yield repeats(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    size = sum(b.column(2).nbytes for b in held)
        if held:
            yield repeats(pa.Table.from_batches(held))

    return found.repartition("key").sortWithinPartitions("kind", "key").mapInArrow(run, SPANS)


def cut_out(packed: DataFrame, spans: DataFrame) -> DataFrame:
    """RESULT for each text of packed."""
    fields = F.struct("doc", "start", "stop")
    found = packed.join(spans.groupBy("batch").agg(F.collect_list(fields).alias("found")), "batch", "left")

    def run(batches):
        for row in rows_of(batches):
            data, sizes = texts_of(row)
            doc, start, stop = joined_spans(*(np.array([f[c] for f in row["found"] or ()], np.int64) for c in ("doc", "start", "stop")))
            begin = np.cumsum(sizes) - sizes
            keep = np.ones(len(data), bool)
            keep[ragged(begin[doc] + start, stop - start)] = False
            left = np.concatenate(([0], np.cumsum(keep)))[np.append(begin, len(data))]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[keep])])
            edge = np.searchsorted(doc, np.arange(len(sizes) + 1))
            span = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "stop"]))
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(sizes), span, kept.cast(pa.binary())], [c.split()[0] for c in ("doc_id", "n_bytes", "spans", "kept")])

    return found.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, often: int = OFTEN, sorted_bytes: int = SORTED) -> DataFrame:
    """RESULT for each row of docs: its id, its size, the spans that go (apart, in order) and the bytes that stay.

    A byte goes if a WINDOW-byte string over it starts earlier as well: in a document of smaller id (null is the smallest), or
    earlier in the same one. Rows of one id count as one document: equal ones leave each other alone, others are told apart by where a
    string starts. Null texts are empty; shorter texts stay whole; an empty table gives an empty result. Cuts are between bytes, so that
    what stays need not be whole characters.
    """
    packed = materialise(pack(docs))
    found = sent(packed, repeated_anchors(packed, often))
    return cut_out(packed, sort_keys(found, sorted_bytes))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
