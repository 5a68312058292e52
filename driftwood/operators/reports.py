"""What is told of guesses: shown candidates, per-class measures, and sweeps over ways to mix evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.functions import fixed
from driftwood.operators.history import adapted_prior, argmax
from driftwood.sinks import bar, percent

#: Shares below which a candidate is not shown besides the first: the second one, and any other.
SHOWN_SECOND, SHOWN_MORE = 0.01, 0.03


def shown(candidates: DataFrame, most: int = 3, width: int = 20) -> DataFrame:
    """The candidates (..., rank, p) that are shown, with percent, bar and needs_review (of the first: too unsure to go unasked)."""
    p = F.col("p")
    least = F.when(F.col("rank") == 1, 0.0).when(F.col("rank") == 2, SHOWN_SECOND).otherwise(SHOWN_MORE)
    kept = candidates.where((F.col("rank") <= most) & (p >= least))
    return kept.withColumns({"percent": percent(p), "bar": bar(p, width), "needs_review": (F.col("rank") == 1) & (p < fixed.ASK_BELOW)})


def confident(guesses: DataFrame, least: float) -> DataFrame:
    """The guesses that are at least so sure."""
    return guesses.where(F.col("p") >= least)


def class_measures(guesses: DataFrame) -> DataFrame:
    """(type, n, precision, recall, f1) by class of guesses (type, first), and a row `macro` with the means over the classes that occur.

    One row of each guess goes to its true class and one to its guessed class, so that one aggregation counts both.
    """
    sides = F.explode(F.array(F.struct(F.col("type").alias("class"), F.lit(1).alias("true"), F.lit(0).alias("guessed")), F.struct(F.col("first").alias("class"), F.lit(0).alias("true"), F.lit(1).alias("guessed"))))
    hit = (F.col("first") == F.col("type")).cast("int")
    counted = guesses.select(sides.alias("x"), hit.alias("hit")).groupBy(F.col("x.class").alias("type")).agg(F.sum("x.true").alias("n"), F.sum("x.guessed").alias("guessed"), F.sum(F.col("hit") * F.col("x.true")).alias("hits"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    measured = counted.select("type", "n", share("hits", "guessed").alias("precision"), share("hits", "n").alias("recall"), F.coalesce(F.try_divide(F.lit(2.0) * F.col("hits"), F.col("n") + F.col("guessed")), F.lit(0.0)).alias("f1"))
    macro = measured.agg(F.lit("macro").alias("type"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    return measured.unionByName(macro.where("n is not null"))


def sweep(rows: DataFrame, ways: dict[str, Column], classes: list[str]) -> DataFrame:
    """(way, n, top1, nll) of rows with type, by each way to get an array of class probabilities: all in one pass."""
    names = F.array(*[F.lit(c) for c in classes])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("way"), F.transform(p, lambda x: F.round(x, 9)).alias("p")) for name, p in ways.items()]))
    held = rows.select("type", each.alias("x")).select("type", "x.way", "x.p")
    own = F.get("p", (F.array_position(names, F.col("type")) - 1).cast("int"))
    return held.groupBy("way").agg(F.count("*").alias("n"), F.avg((F.get(names, argmax("p")) == F.col("type")).cast("double")).alias("top1"), F.avg(-F.log(own)).alias("nll"))


def blends(prior: Column, file: Column) -> dict[str, Column]:
    """Ways to mix two distributions: each alone, their mean, their product and their larger values, normalised."""
    whole = lambda raw: F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))
    both = lambda f: F.zip_with(prior, file, f)
    return {"prior": prior, "file": file, "mean": both(lambda a, b: (a + b) / 2), "product": whole(both(lambda a, b: a * b)), "larger": whole(both(lambda a, b: F.greatest(a, b)))}


def prior_powers(p: Column, repo: Column, train: Column, powers: tuple[float, ...] = (0.0, 0.3, 0.5, 0.7, 1.0)) -> dict[str, Column]:
    """p adapted to the repo's shares by each power."""
    return {str(x): adapted_prior(p, repo, train, x) for x in powers}


#: What each kind of feature says of a change, by what it is about; {} is the rest of its name.
WORDS = {
    # the change as a whole
    "only": "all changed files count as {}", "files": "portion of changed files that count as {}",
    # where files lie
    "p": "a changed path goes through {}/", "p0": "a changed path starts at {}/", "pp": "a changed path goes through {}/", "pl": "a changed file lies right in {}/", "fe": "a changed file has place and ending {}",
    # what files are
    "f": "a changed file is called {}", "fw": "{} is part of a changed file's name", "e": "a changed file ends in .{}", "l": "a changed file is written in {}", "c": "a changed file counts as {}", "s": "a changed file was {}",
    "cs": "a changed file is, and was: {}", "es": "a changed file has ending and fate {}", "ls": "a changed file has language and fate {}", "ce": "a changed file is of kind and ending {}",
    # tokens, and neighbours of them, on either side
    "a": "{} stands in code that came", "r": "{} stands in code that went", "x": "{} came and was not there before", "y": "{} went and did not come back", "ab": "{} stand side by side in code that came", "rb": "{} stand side by side in code that went",
    # how lines begin
    "A1": "a line that came begins like {}", "AL": "a line that came begins like {}", "R1": "a line that went begins like {}", "RL": "a line that went begins like {}",
    # what hunks and messages say
    "h": "a hunk's heading has {}", "hs": "a hunk's heading begins like {}", "m": "the message has {}", "m1": "the message opens with {}", "m2": "the message has, side by side, {}",
}
#: Kinds whose names hold two things, with a _ between them.
PAIRS = ("cs", "es", "ls", "ce", "ab", "rb", "m2")


def in_words(feature: Column) -> Column:
    """A feature's name as a sentence: lines' beginnings with their language, pairs with a plus. A name of an unknown kind stays; of an empty one only the bucket is known."""
    prefix = F.substring_index(feature, ":", 1)
    value = F.regexp_replace(feature, "^[^:]*:", "")
    said = F.try_element_at(F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair]), prefix)
    told = F.when(prefix.isin("AL", "RL"), F.concat(F.substring_index(value, ":", -1), F.lit(", in "), F.substring_index(value, ":", 1))).when(prefix.isin(*PAIRS), F.replace(value, F.lit("_"), F.lit(" + "))).otherwise(value)
    return (
        F.when(feature == "", "a bucket whose names are not known")
        .when(feature.startswith("lines_in_"), F.concat(F.lit("portion of changed lines in "), F.regexp_replace(feature, "^lines_in_", "")))
        .when(~feature.contains(":"), F.concat(F.lit("measure of "), F.replace(feature, F.lit("_"), F.lit(" "))))
        .when(said.isNull(), feature)
        .otherwise(F.replace(said, F.lit("{}"), told))
    )


def eval_report(guesses: DataFrame, others: int = 2, width: int = 10) -> DataFrame:
    """(type, hits, n, bar, guessed_as): each class's share of right guesses, and what it's most often taken for. guesses: (type, first).

    guessed_as holds at most `others` names and counts, the most frequent first, ties by name.
    """
    by = guesses.groupBy("type", "first").agg(F.count("*").alias("k"))
    wrong = F.array_sort(F.collect_list(F.when(F.col("first") != F.col("type"), F.struct((-F.col("k")).alias("k"), F.col("first").alias("first")))))
    summed = by.groupBy("type").agg(F.coalesce(F.sum(F.when(F.col("first") == F.col("type"), F.col("k"))), F.lit(0)).alias("hits"), F.sum("k").alias("n"), wrong.alias("wrong"))
    told = F.array_join(F.transform(F.slice("wrong", 1, others), lambda x: F.concat(x["first"], F.lit(" "), (-x["k"]).cast("string"))), ", ")
    return summed.select("type", "hits", "n", bar(F.col("hits") / F.col("n"), width).alias("bar"), told.alias("guessed_as"))


def check_summary(checked: DataFrame, strict: bool = False) -> DataFrame:
    """(n, missing, disputed, failed) of checked commits (status): a type that is missing fails the check; if strict, a disputed one does too."""
    counts = checked.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "disputed").alias("disputed"))
    return counts.withColumn("failed", (F.col("missing") > 0) | (F.lit(strict) & (F.col("disputed") > 0)))


def agreement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, hits, rate): how often guess equals actual; rows without an actual value don't count."""
    hit = F.col("guess").eqNullSafe(F.col("actual"))
    return rows.where("actual is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.avg(hit.cast("double")).alias("rate"))


def top_confusions(rows: DataFrame, most: int = 14) -> DataFrame:
    """(actual, guess, n): the most frequent wrong guesses; ties by name."""
    wrong = rows.where((F.col("actual") != F.col("guess")) | (F.col("actual").isNotNull() & F.col("guess").isNull()))
    return wrong.groupBy("actual", "guess").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "actual", "guess").limit(most)
