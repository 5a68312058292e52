"""Source divergence audit (operator 11): how far the sources of a language lie apart, and by which terms.

Every group (a language's source) and every language gets a smoothed integer distribution over the terms the language keeps. The
terms of a language are dealt into blocks and its sources into tiles, by hash. For each block and pair of tiles one dense int64 matrix of
groups by terms is built for each tile, the divergences of all pairs come from broadcasting it against the other, and a task adds up the
pair matrices of its blocks before it sends them. The same matrices give each group's most divergent terms: a heap a group in each
task, merged by a window that keeps the best 200 of a group before and after the shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwood.llm.common import as_bytes, chunks, materialise, run_lengths, table

#: What each byte becomes: lower-case letters and all beyond ASCII stay, A-Z are lower-cased, the rest part terms.
FOLD = bytes(c if 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
UNIT = 1_000_000_000
#: A term is kept in a language if so many of its documents have it; so many terms of a group are told.
LEAST_DOCS, TOP = 3, 200
#: Terms of a block and sources of a tile, about (they are dealt by hash); cells of one broadcast; pairs and heaps that a task holds before it sends them.
BLOCK, TILE, CELLS, HELD = 2048, 128, 1 << 20, 1 << 18
COUNTED = "lang string, source string, term string, n bigint, docs bigint"
#: One pair matrix' input: a row a source of either tile without a term (its n, its language's n, the terms kept), and a row a source and term.
CELL = "lang string, block int, low int, high int, tile int, source string, term string, n bigint, lang_n bigint, terms bigint"
FOUND = "lang string, source string, part string, item string, value bigint"


def count_terms(docs: DataFrame) -> DataFrame:
    """COUNTED, several rows for a (lang, source, term); a row with an empty term for each group, whether it has terms or not."""

    def run(batches):
        for batch in chunks(batches):
            terms, sizes = [], []
            for t in as_bytes(batch.column(2)):
                mine = t.translate(FOLD).split()
                terms += mine
                sizes.append(len(mine))
            names = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            number = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
            group = np.array([number[p] for p in pairs], np.int64)
            coded = pa.array(terms, pa.large_binary()).dictionary_encode()
            code, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            cell, n = run_lengths(group[doc] * width + code)
            once, _ = run_lengths(doc * width + code)
            _, seen = run_lengths(group[once // width] * width + once % width)
            first = pa.array(np.unique(group, return_index=True)[1])
            whose = names.take(first)
            text = coded.dictionary.cast(pa.large_string()).cast(pa.string())
            for at in range(0, len(cell), 1 << 17):
                some = cell[at : at + (1 << 17)]
                mine = whose.take(pa.array(some // width))
                yield pa.RecordBatch.from_arrays([mine.field(0), mine.field(1), text.take(pa.array(some % width)), pa.array(n[at : at + (1 << 17)]), pa.array(seen[at : at + (1 << 17)])], ["lang", "source", "term", "n", "docs"])
            zero = pa.array(np.zeros(len(whose), np.int64))
            yield pa.RecordBatch.from_arrays([whose.field(0), whose.field(1), pa.array([""] * len(whose)), zero, zero], ["lang", "source", "term", "n", "docs"])

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*blank).mapInArrow(run, COUNTED)


def dealt(key: str, parts: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64({key}), {parts}) as int)")


def cells(counted: DataFrame) -> DataFrame:
    """CELL: each source once for each block and pair of tiles that it takes part in, each kept count likewise."""
    totals = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    wide = totals.withColumn("lang_n", F.sum("n").over(of_term)).withColumn("docs", F.sum("docs").over(of_term))
    kept = materialise(wide.where((F.col("docs") >= LEAST_DOCS) | (F.col("term") == "")).drop("docs"))
    groups = materialise(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")))
    terms = kept.where("term != ''").groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count("*").alias("sources")).join(terms, "lang", "left").fillna(0, ["terms"])
    langs = materialise(langs.select("lang", "all_n", "terms", F.expr(f"ceil(greatest(terms, 1) / {BLOCK})").alias("blocks"), F.expr(f"ceil(sources / {TILE})").alias("tiles")))
    columns = [c.split()[0] for c in CELL.split(", ")]
    tiled = lambda df: df.join(langs, "lang").withColumn("tile", dealt("source", "tiles"))
    heads = tiled(groups).withColumn("block", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)"))).select("lang", "block", "tiles", "tile", "source", F.lit("").alias("term"), "n", F.col("all_n").alias("lang_n"), "terms")
    counts = tiled(kept.where("term != ''")).withColumn("block", dealt("term", "blocks")).select("lang", "block", "tiles", "tile", "source", "term", "n", "lang_n", F.lit(None).cast("bigint").alias("terms"))
    either = heads.unionByName(counts).withColumn("other", F.explode(F.expr("sequence(0, cast(tiles as int) - 1)")))
    return either.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).select(*columns)


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * count / total), 0 < count <= total < 2^53, in steps of a thousand so that no product leaves int64."""
    out, rest = np.zeros(np.broadcast_shapes(np.shape(count), np.shape(total)), np.int64), np.asarray(count, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, a table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = np.zeros(batch.num_rows, bool)
        for c in keys:
            codes = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges[1:] |= codes[1:] != codes[:-1]
        first = tuple(batch.column(c)[0].as_py() for c in keys)
        cuts = np.flatnonzero(edges).tolist()
        if before is not None and first != before:
            cuts.insert(0, 0)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        before = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in keys)
    if held:
        yield pa.Table.from_batches(held)


class Tile:
    """The smoothed shares of one tile's groups over the terms of a block, dense, and their language's."""

    def __init__(self, heads: pa.Table, counts: pa.Table, term: pa.Array):
        self.sources = heads["source"].to_pylist()
        row = {s: k for k, s in enumerate(self.sources)}
        kept = heads["terms"][0].as_py() if len(self.sources) else 0
        self.count = np.zeros((len(row), len(term)), np.int64)
        at = np.array([row[s] for s in counts["source"].to_pylist()], np.int64)
        self.count[at, pa.compute.index_in(counts["term"].combine_chunks(), term).to_numpy(zero_copy_only=False)] = counts["n"].to_numpy()
        total = heads["n"].to_numpy()[:, None] + kept
        self.share, self.least = (shares(self.count + 1, total), shares(np.ones_like(total), total)) if kept else (self.count, self.count[:, :0])


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over the terms of divergence(a, b), all rows of a by all of b; blocks of terms at a time."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, CELLS // max(1, out.size))
    for at in range(0, a.shape[1], step):
        out += divergence(a[:, None, at : at + step], b[None, :, at : at + step]).sum(2)
    return out


def measure(found: DataFrame) -> DataFrame:
    """FOUND: sums by pair (several rows a pair, to be added up) and each task's best terms of a group, from sorted CELL rows."""

    def run(batches):
        pairs: dict[tuple[str, str], dict[str, int]] = {}
        heaps: dict[tuple[str, str], list[tuple[int, str]]] = {}

        def flush():
            out = [(*g, "pair", item, value) for g, mine in pairs.items() for item, value in mine.items()] + [(*g, "term", item, -value) for g, mine in heaps.items() for value, _, item in mine]
            pairs.clear()
            heaps.clear()
            for at in range(0, len(out), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 4 else pa.string()) for k, c in enumerate(zip(*out[at : at + (1 << 16)], strict=True))], [c.split()[0] for c in FOUND.split(", ")])

        held = 0
        for rows in runs_of(batches, ["lang", "block", "low", "high"]):
            lang, low, high = (rows[c][0].as_py() for c in ("lang", "low", "high"))
            is_head = pa.compute.equal(rows["term"], "")
            heads, counts = rows.filter(is_head), rows.filter(pa.compute.invert(is_head))
            term = pa.compute.unique(counts["term"])
            tiles = [Tile(heads.filter(pa.compute.equal(heads["tile"], t)), counts.filter(pa.compute.equal(counts["tile"], t)), term) for t in dict.fromkeys((low, high))]
            for a in tiles:
                for b in tiles if low == high else [t for t in tiles if t is not a]:
                    # terms of the language that neither tile has count as well: all terms once, in block 0, less those that are here
                    others = (heads["terms"][0].as_py() if rows["block"][0].as_py() == 0 else 0) - len(term)
                    sums = (pair_sums(a.share, b.share) + others * pair_sums(a.least, b.least)).tolist()
                    for source, line in zip(a.sources, sums, strict=True):
                        mine = pairs.setdefault((lang, source), {})
                        for item, value in zip(b.sources, line, strict=True):
                            if item != source:
                                mine[item] = mine.get(item, 0) + value
                                held += 1
            if low == high and len(term):
                own, (names, kept, all_n) = tiles[0], (term.to_pylist(), heads["terms"][0].as_py(), heads["lang_n"][0].as_py())
                of_lang = np.zeros(len(names), np.int64)
                of_lang[pa.compute.index_in(counts["term"].combine_chunks(), term).to_numpy(zero_copy_only=False)] = counts["lang_n"].to_numpy()
                q = shares(of_lang + 1, all_n + kept)
                value = np.where((own.count > 0) & (own.share > q), divergence(own.share, q), -1)
                for source, line in zip(own.sources, value, strict=True):
                    some = np.flatnonzero(line >= 0)
                    if len(some) > TOP:
                        some = some[line[some] >= np.partition(line[some], -TOP)[-TOP]]
                    if len(some):
                        new = ((-int(line[k]), names[k].encode(), names[k]) for k in some)
                        before = heaps.get((lang, source), [])
                        heaps[lang, source] = heapq.nsmallest(TOP, [*before, *new])
                        held += len(heaps[lang, source]) - len(before)
            if held > HELD:
                yield from flush()
                held = 0
        yield from flush()

    return found.mapInArrow(run, FOUND)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank of each group of docs.

    pair: the divergence of the group from each other source of its language, 0 where the language keeps no term. term: the TOP terms
    that the group has more of than its language. Null texts, languages and sources are empty ones; every row counts, copies
    included; an empty table gives an empty result. Counts of a language may reach 2^53.
    """
    keys = ["lang", "block", "low", "high"]
    found = materialise(measure(cells(count_terms(docs)).repartition(*keys).sortWithinPartitions(*keys)))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= TOP))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM groups LEFT JOIN counted USING (lang, source) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0)::HUGEINT + 1) // (s.n + l.v) AS p, 1 + 1000000000 * (k.n::HUGEINT + 1) // (l.n + l.v) AS q
  FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts QUALIFY part = 'pair' OR rank <= 200
"""
