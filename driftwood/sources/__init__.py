"""Readers of what commits come from; all are Spark readers, so paths can be in any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwood.functions import text

RECORD = "repo string, sha string, type string, scope string, breaking boolean, subject string, convention string, bot boolean, ts bigint, nfiles int, truncated boolean, patch_hash string, patch string"
LONGEST_COMMIT = 8 << 20
#: Folders of an index: repos share them, as one each would be millions of small files.
INDEX_PARTS = 256


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Training records of JSON lines, gzipped or not; lines that are no JSON are left out."""
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, ts, subject, patch) of the output of `git log -p --format=%x1e%H%x00%at%x00%s`: one record a separator, patches cut at 8 MiB."""
    records = spark.read.option("lineSep", "\x1e").text(path).where(F.length("value") > 0)
    first = F.substring_index("value", "\n", 1)
    parts = F.split(first, "\x00")
    patch = text.cut(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 2)"), LONGEST_COMMIT)
    return records.select(F.get(parts, F.lit(0)).alias("sha"), F.get(parts, F.lit(1)).try_cast("bigint").alias("ts"), F.get(parts, F.lit(2)).alias("subject"), patch.alias("patch")).where(F.length("sha") >= 7)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, patch): one patch a file."""
    return spark.read.option("wholetext", True).text(path).select(F.xxhash64(F.input_file_name()).alias("commit_id"), F.col("value").alias("patch"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(repo): the first word of each line that is no comment, once each."""
    word = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))
    return spark.read.text(path).where(~F.trim("value").rlike("^(#|$)")).select(word.alias("repo")).distinct()


def read_index(spark: SparkSession, path: str, version: int, repo: str | None = None) -> DataFrame | None:
    """The history index (of one repo, from its part alone), or None if it was written by another version of the features."""
    held = spark.read.parquet(path)
    if repo is not None:
        held = held.where((F.col("part") == F.pmod(F.xxhash64(F.lit(repo)), F.lit(INDEX_PARTS))) & (F.col("repo") == repo))
    return held.drop("version", "part") if held.where(F.col("version") != version).isEmpty() else None
