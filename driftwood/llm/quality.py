"""Quality rules with risk-controlled thresholds (operator 4).

Each rule rejects documents whose value is above a cutoff. On one half of the labelled documents (by a hash of
the text), cutoffs are proposed for each stratum at several levels of strictness. The other half is held out: a
level may be used in a stratum only if the exact binomial bound on how often all its rules together reject a good
text is at most `risk`. All levels of all strata are tested at once (Bonferroni), so with probability 1 - `doubt` no stratum
loses more than `risk` of its good texts to the rules. The bound needs independent trials, so copies and near copies (SimHash components of
the labelled documents) are one trial, and both halves are dealt by component: no text is proposed on and certified on.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.llm import simhash
from driftwood.llm.common import as_bytes, as_row, chunks, discard, materialise, table, text_of, with_text

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_marks")
SYMBOLS, MARKS, UPPER = b"#*$%&|<>", b"!?", bytes(range(65, 91))
WINDOW = 5
#: Rule -> (numerator, denominator), in thousandths; each is high for one kind of bad text.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "marks": ("n_marks", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "long_words": ("word_chars", "n_words"),
    "short_words": ("n_words", "word_chars"),
}
#: Values of so many bits or fewer are exact, of larger ones the leading bits: a stratum has at most some 30,000 values, none is cut off.
EXACT_BITS = 10
#: Shares of good documents of the first half that a single rule may reject, by level.
OWN, POOL = "=", "pooled"
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.005)


def counts(text: bytes) -> tuple[int, ...]:
    """The values of BASE and MORE for one text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * (len(BASE) + len(MORE))
    flat = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeat = 0
    if n > WINDOW and len(set(words)) < n:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            found = Counter(windows)
            covered = 0
            for i, w in enumerate(windows):
                if found[w] > 1:
                    repeat += i + WINDOW - max(covered, i)
                    covered = i + WINDOW
    chars = len(flat.decode("utf-8", "replace"))
    less = lambda some: len(flat) - len(flat.translate(None, some))
    return n, chars, less(SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), less(UPPER), less(MARKS)


def measure(docs: DataFrame, keep: list[str], marked: bool = False) -> DataFrame:
    """Columns `keep` of docs and the counts of each whole text, if marked its fingerprint as well; null text has no words."""
    schema, more = docs.select(*keep).schema, (*BASE, *MORE, *(("fp",) if marked else ()))
    for c in more:
        schema = schema.add(c, "long")

    def run(batches):
        for batch in chunks(batches):
            found = [pa.array(c, pa.int64()) for c in zip(*map(counts, as_bytes(text_of(batch, keep))), strict=True)]
            if marked:
                found.append(pa.array(np.array([simhash.fingerprint(t) for t in as_bytes(text_of(batch, keep))], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], [*keep, *more])

    return with_text(docs, keep).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_value(rule: str) -> Column:
    top, bottom = RULES[rule]
    value = f"coalesce(1000 * {top} div nullif({bottom}, 0), 0L)"
    extra = f"greatest(length(bin({value})) - {EXACT_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {extra}), {extra})")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of probability p."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def propose(frame: pd.DataFrame) -> pd.DataFrame:
    """Cutoffs for one stratum: rows (rule, value, good, bad) of the first half to one row for each level.

    A rule's cutoff lies halfway between a value that at most the level's share of good documents exceed and the next bad
    document above it. A rule that catches no bad document beyond that is off (null).
    """
    out = []
    for level, share in enumerate(LEVELS):
        row = {"stratum": frame["stratum"].iloc[0], "level": level}
        for rule in RULES:
            mine = frame[frame["rule"] == rule].sort_values("value", ascending=False)
            allowed = int(share * mine["good"].sum())
            over = mine["good"].cumsum() > allowed
            safe = int(mine["value"][over].iloc[0]) if over.any() else None
            above = mine[(mine["value"] > safe) & (mine["bad"] > 0)] if safe is not None else mine[:0]
            row[rule] = float((safe + above["value"].min()) / 2) if len(above) else None
        out.append(row)
    return pd.DataFrame(out)


CUTOFFS = "stratum string, level int, " + ", ".join(f"{r} double" for r in RULES)


def rejected(prefix: str = "") -> Column:
    """Whether any rule that is on rejects the row."""
    found = F.lit(False)
    for rule in RULES:
        found = found | F.coalesce(F.col(f"v_{rule}") > F.col(prefix + rule), F.lit(False))
    return found


def strata(docs: DataFrame, stratum: str | None) -> Column:
    """The stratum of a row by name; null is one of its own."""
    return F.concat(F.lit(OWN), F.coalesce(F.col(stratum).cast("string"), F.lit(""))) if stratum else F.lit(OWN)


def certify(frame: pd.DataFrame, alpha: float, risk: float) -> pd.DataFrame:
    """Of one stratum's levels (good, lost, caught: held-out trials), the certified one that catches most; of equal ones the mildest."""
    safe = [binomial_tail(int(k), int(n), risk) <= alpha if n else False for k, n in zip(frame["lost"], frame["good"], strict=True)]
    return frame[safe].sort_values(["caught", "level"], ascending=[False, True]).head(1)[["stratum", "level"]]


def trials(seen: DataFrame) -> DataFrame:
    """seen with `trial`, what its near copies share: the least fingerprint of its component; and `held_out`, dealt by that."""
    fps = seen.select("fp").distinct()
    rooted = simhash.components(simhash.near_pairs(materialise(fps)))
    named = seen.join(rooted.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").withColumn("trial", F.coalesce("root", "fp"))
    return named.drop("root").withColumn("held_out", F.pmod(F.xxhash64("trial"), F.lit(2)) == 1)


def once_each(seen: DataFrame) -> DataFrame:
    """One row for each trial of a stratum: good if one of its documents is; its values are those of its least fingerprint, so that ids and the number of copies don't matter."""
    values = [f"v_{r}" for r in RULES]
    first = F.min(F.struct("fp", *values)).alias("first")
    return seen.groupBy("stratum", "trial", "held_out").agg(first, F.max("quality").alias("quality")).select("stratum", "held_out", "quality", *[f"first.{v}" for v in values])


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """(stratum, level, a cutoff for each rule; null: off) of each stratum with labels enough to certify something, and of the others together (POOL).

    measured: doc_id, stratum, the counts, fp. labels: doc_id, quality (1: good, 0: bad; null ones are not used). Enough are so many good
    held-out trials that losing none of them would do; that counts labels, not what rules do to them. Of the certified levels that
    which rejects most bad held-out trials is taken; of equal ones the mildest. Without a certified level, level and cutoffs are null.
    """
    graded = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = materialise(measured.where(~base_failed()).join(graded, "doc_id").select("fp", "stratum", "quality", *[rule_value(r).alias(f"v_{r}") for r in RULES]))
    seen = materialise(trials(labelled))
    sizes = materialise(once_each(seen).groupBy("stratum").agg(F.count_if(F.col("held_out") & (F.col("quality") == 1)).alias("good")))
    alpha = doubt / (len(LEVELS) * (sizes.count() + 1))
    enough = sizes.where(F.col("good") >= math.log(alpha) / math.log1p(-risk)).select("stratum")
    joined = seen.join(enough.withColumn("own", F.lit(True)), "stratum", "left")
    single = materialise(once_each(joined.withColumn("stratum", F.when(F.col("own"), F.col("stratum")).otherwise(F.lit(POOL)))))
    values = single.where("not held_out").select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"v_{r}").alias("value")) for r in RULES])).alias("x"))
    histogram = values.groupBy("stratum", "x.rule", "x.value").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    proposed = materialise(histogram.groupBy("stratum").applyInPandas(propose, CUTOFFS))
    tried = single.where("held_out").join(proposed, "stratum").withColumn("out", rejected())
    tried = tried.groupBy("stratum", "level").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if((F.col("quality") == 1) & F.col("out")).alias("lost"), F.count_if((F.col("quality") == 0) & F.col("out")).alias("caught"))
    certified = proposed.join(tried.groupBy("stratum").applyInPandas(lambda frame: certify(frame, alpha, risk), "stratum string, level int"), ["stratum", "level"])
    every = enough.unionByName(measured.sparkSession.range(1).select(F.lit(POOL).alias("stratum")))
    out = materialise(every.join(certified, "stratum", "left"))
    discard(labelled, seen, sizes, single, proposed)
    return out


def with_cutoffs(valued: DataFrame, cutoffs: DataFrame, most: int = 20_000) -> DataFrame:
    """Joins each row's cutoffs: its stratum's, or else those of POOL, a single row.

    The strata's are sent to every task if there are at most `most` (a few MB); beyond, rows are dealt by stratum, the large ones split.
    """
    names = [c.split()[0] for c in CUTOFFS.split(", ")][1:]
    own = cutoffs.where(F.col("stratum") != POOL).withColumn("own", F.lit(True))
    pool = cutoffs.where(F.col("stratum") == POOL).first()
    found = valued.join(F.broadcast(own) if own.count() <= most else own, "stratum", "left")
    kinds = dict(cutoffs.dtypes)
    return found.select(*valued.columns, *[F.when(F.col("own"), F.col(c)).otherwise(F.lit(pool[c]).cast(kinds[c])).alias(c) for c in names])


def judge(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """doc_id, the counts of BASE, base_failed, kept, level (of the cutoffs used; null: none is certified).

    stratum: the column of docs whose values are the strata, null being one (None: all documents are one). Strata with too few
    labels share cutoffs; where even these have too few, the base rules decide alone. Repeated rows stay; an empty table gives an empty result.
    """
    measured = materialise(measure(docs.select("doc_id", strata(docs, stratum).alias("stratum"), "text"), ["doc_id", "stratum"], True))
    cutoffs = certified_cutoffs(measured, labels, risk, doubt)
    valued = measured.select("*", *[rule_value(r).alias(f"v_{r}") for r in RULES])
    return with_cutoffs(valued, cutoffs).select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & ~rejected()).alias("kept"), "level")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", risk: float = 0.02, doubt: float = 0.05) -> DataFrame:
    """The rows of docs, all their columns, that judge() keeps. Texts are measured twice rather than shuffled."""
    name = strata(docs, stratum)
    measured = materialise(measure(docs.select("doc_id", name.alias("stratum"), "text"), ["doc_id", "stratum"], True))
    cutoffs = certified_cutoffs(measured, labels, risk, doubt)
    discard(measured)
    valued = measure(as_row(docs, name.alias("stratum")), ["row", "stratum"]).select("*", *[rule_value(r).alias(f"v_{r}") for r in RULES])
    return with_cutoffs(valued, cutoffs).where(~base_failed() & ~rejected()).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
