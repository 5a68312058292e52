"""Language identification by prediction by partial matching (operator 9).

Each language has a byte context tree of variable order: how often each byte followed each context of up to ORDER
bytes in the training texts. The probability of a byte comes from the longest context that has it; each longer context that is known
but lacks it costs its escape (method C: distinct followers / (count + distinct followers)). The statistics are frozen
when texts are scored, so the code length of a byte depends on its n-gram alone and is worked out once for each n-gram.

The trees are fitted on a bounded sample: of a language with more than MOST_BYTES of labelled text, as many documents as hold about so
much, by a hash of id and text. So the trees that go to the driver and every task don't grow with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm.common import CodeTable, Tally, as_bytes, block_sums, chunks, crc_fold, discard, joined, materialise, table, text_of, training_codes, with_text

ORDER = 3
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
MOST_BYTES = 16 << 20
#: Rows that are sent to every task at most.
MOST_SENT = 20_000
#: A score says how sure so many bytes of the text would make it, or the whole text, if shorter.
EVIDENCE = 64


def training_sample(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(lang, text) of labelled documents: all of a language with at most most_bytes of text, else a share of them by hash that holds about so much."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text").cast("bigint")).alias("size"))
    share = materialise(sizes.select("lang", F.least(F.lit(1.0), F.lit(float(most_bytes)) / F.col("size")).alias("share")))
    # a row a language goes to every task if these are few; texts are dealt by language else
    few = share.limit(MOST_SENT + 1).count() <= MOST_SENT
    held = labelled.join(F.broadcast(share) if few else share, "lang")
    return held.where(F.pmod("h", F.lit(1 << 62)) < F.col("share") * float(1 << 62)).select("lang", "text")


def ngram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, code, n): how often each byte n-gram of order + 1 occurs in each language's texts.

    Texts start after `order` zero bytes. Counts are summed in each task before they are shuffled.
    """

    def run(batches):
        totals: dict[str, Tally] = {}
        for batch in chunks(batches):
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                some = batch.column(1).filter(pa.array([x == lang for x in langs]))
                totals.setdefault(lang, Tally()).add(training_codes(some, order))
        for lang, tally in totals.items():
            codes, n = tally.total()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])

    parts = labelled.select("lang", "text").mapInArrow(run, "lang string, code bigint, n bigint")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Trees:
    """The languages' frozen context trees; costs() gives code lengths in nats."""

    def __init__(self, langs: list[str], codes: np.ndarray, counts: np.ndarray, order: int):
        """codes: sorted n-grams of order + 1; counts: a row for each, a column for each language."""
        self.langs, self.order = langs, order
        self.grams, self.contexts = [], []
        for k in range(order + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            grams, at = np.unique(codes & mask, return_inverse=True)
            n = np.zeros((len(grams), len(langs)))
            np.add.at(n, at, counts)
            contexts, up = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, up, n)
            np.add.at(kinds, up, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.where(n > 0, np.log(total + kinds)[up] - np.log(n), np.nan)
                escape = np.where(total > 0, np.log(total + kinds) - np.log(kinds), 0.0)
            self.grams.append((grams, seen))
            self.contexts.append((contexts, escape))
        self.table = CodeTable(codes, counts.sum(axis=1))
        self.known = self.costs(codes).astype(np.float32)

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Exact code length of the byte of each n-gram in each language."""
        cost = np.full((len(codes), len(self.langs)), np.log(256.0))
        for k in range(self.order + 1):
            key = codes & np.uint64((1 << (8 * (k + 1))) - 1)
            (grams, seen), (contexts, escape) = self.grams[k], self.contexts[k]
            if not len(grams):
                continue
            c = np.minimum(np.searchsorted(contexts, key >> np.uint64(8)), len(contexts) - 1)
            cost += np.where((contexts[c] == key >> np.uint64(8))[:, None], escape[c], 0.0)
            g = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
            here = np.where((grams[g] == key)[:, None], seen[g], np.nan)
            cost = np.where(np.isnan(here), cost, here)
        return cost

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length in nats of each text in each language, and the texts' bytes."""
        data, starts, lengths = joined(column, self.order, 0)

        def cost(codes: np.ndarray) -> np.ndarray:
            at = self.table.find(codes)
            found = self.known[at] if len(self.known) else np.zeros((len(codes), len(self.langs)), np.float32)
            if len(new := np.flatnonzero(at < 0)):
                kinds, back = np.unique(codes[new], return_inverse=True)
                found[new] = self.costs(kinds).astype(np.float32)[back]
            return found

        return block_sums(data, self.order, starts, lengths, cost), lengths


def collect_trees(counts: DataFrame, order: int = ORDER) -> Trees:
    """The trees of all (lang, code, n) rows, of every language and count; as many as the sample's bound allows."""
    got = counts.toArrow()
    lang = got["lang"].combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    langs = sorted(names)
    rank = np.array([langs.index(x) for x in names], np.int64)
    codes, at = np.unique(got["code"].to_numpy().astype(np.uint64), return_inverse=True)
    n = np.zeros((len(codes), len(langs)))
    if langs:
        n[at, rank[lang.indices.to_numpy()]] = got["n"].to_numpy()
    return Trees(langs, codes, n, order)


def identify(docs: DataFrame, trees: Trees, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (doc_id) and lang_pred, score, nats_per_byte for each whole text.

    score: the best language's share of the languages' likelihoods of EVIDENCE average bytes (of the whole text, if shorter), all equally likely before. Texts that are null or have no letter
    are `und` with score 0, as are all where no language was learned. Ties: the first language by name. Repeated rows
    stay, columns neither kept nor `text` are not read; an empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("nats_per_byte", "double")):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast((trees.langs, trees.table.codes, trees.grams, trees.contexts, trees.order, trees.known, trees.table))

    def run(batches):
        t = Trees.__new__(Trees)
        t.langs, _, t.grams, t.contexts, t.order, t.known, t.table = shared.value
        for batch in chunks(batches, 4 << 20):
            lettered = np.array([bool(LETTER.search(x.decode("utf-8", "replace"))) for x in as_bytes(text_of(batch, keep))]) & bool(t.langs)
            if t.langs:
                nats, lengths = t.score(text_of(batch, keep))
                best = nats.argmin(axis=1)
                least = nats.min(axis=1)
                part = np.minimum(1.0, EVIDENCE / np.maximum(lengths, 1))
                share = 1.0 / np.exp(np.maximum((least[:, None] - nats) * part[:, None], -700.0)).sum(axis=1)
                per_byte = least / np.maximum(lengths, 1)
                names = np.array(t.langs, object)[best]
            else:
                share = per_byte = np.zeros(batch.num_rows)
                names = np.full(batch.num_rows, UNKNOWN, object)
            names = np.where(lettered, names, UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names.tolist(), pa.string()), pa.array(np.where(lettered, share, 0.0)), pa.array(np.where(lettered, per_byte, 0.0))],
                [*keep, "lang_pred", "score", "nats_per_byte"],
            )

    return with_text(docs, keep).mapInArrow(run, schema)


def learn(docs: DataFrame, order: int = ORDER, most_bytes: int = MOST_BYTES) -> Trees:
    """Trees from docs' text and non-null lang, at most about most_bytes of text of each language."""
    counts = materialise(ngram_counts(training_sample(docs, most_bytes), order))
    trees = collect_trees(counts, order)
    discard(counts)
    return trees


def held_out():
    return crc_fold(F.col("doc_id"), 3) == 1


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
