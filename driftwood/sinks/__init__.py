"""Writers and renderings of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.sources import INDEX_PARTS


def percent(p: Column) -> Column:
    return F.least(F.lit(99), F.floor(p * 100 + 0.5)).cast("int")


def bar(p: Column, width: int = 20) -> Column:
    full = F.floor(p * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*[F.col(c) for c in results.columns])).alias("value"))


def check_lines(checked: DataFrame) -> DataFrame:
    """(value): an annotation line for each commit that is missing a type (error) or disputed (warning). checked: sha, subject, declared, first, p, status."""
    said = F.when(F.col("status") == "missing", F.concat(F.lit("::error::"), "sha", F.lit(" has no type: "), "subject")).when(
        F.col("status") == "disputed", F.concat(F.lit("::warning::"), "sha", F.lit(" says "), "declared", F.lit(", looks like "), "first", F.lit(" ("), percent(F.col("p")).cast("string"), F.lit("%)"))
    )
    return checked.select(said.alias("value")).where("value is not null")


def write_index(index: DataFrame, path: str, version: int) -> None:
    """A folder for each part of the repos, by a hash; sorted by repo within."""
    part = F.pmod(F.xxhash64("repo"), F.lit(INDEX_PARTS)).alias("part")
    held = index.select("*", part, F.lit(version).alias("version"))
    held.repartition("part").sortWithinPartitions("part", "repo").write.mode("overwrite").partitionBy("part").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)
