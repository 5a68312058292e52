"""Commit messages: the header that a guess puts into them, and training records from whole commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.functions import headers
from driftwood.operators import diffs, training
from driftwood.sinks import percent

#: Commits that touch more files make no training record.
MOST_FILES = 120


def rewritten(rows: DataFrame, comment: str = "#", strip: bool = True) -> DataFrame:
    """Adds rewritten, the message with its header: rows (message, source, amends, type, scope, breaking, p, second, second_p).

    Left as they are: messages of merges, squashes and earlier commits, amended ones, those that have a header and those that say fixup or revert.
    A message without a subject gets the header on a line before it and, where comments are stripped, the guesses as a comment at its end.
    Of a message given on the command line (source message) no line is a comment. Null messages stay null.
    """
    c = F.col
    given = F.coalesce(c("source"), F.lit("")) == "message"
    lines = F.split("message", "\n")
    first_no = F.coalesce(F.array_position(F.transform(lines, lambda x: ~x.startswith(comment)), True) - 1, F.lit(0)).cast("int")
    at = F.when(given, 0).otherwise(F.greatest(first_no, F.lit(0)))
    first = F.when(given, F.trim(F.get(lines, F.lit(0)))).otherwise(headers.subject_line(c("message"), comment))
    held = rows.withColumns({"_at": at, "_first": first})
    keep = F.coalesce(c("source"), F.lit("")).isin("merge", "squash", "commit") | F.coalesce(c("amends"), F.lit(False)) | headers.has_header(c("_first")) | headers.is_skipped_subject(c("_first"))
    header = F.regexp_replace(headers.format_header(c("type"), c("scope"), c("breaking"), c("_first")), ": $", ":")
    told = F.concat(F.lit(f"{comment}\n{comment} guess: "), c("type"), F.lit(" ("), percent(c("p")).cast("string"), F.lit("%)"), F.coalesce(F.concat(F.lit(", or "), "second", F.lit(" ("), percent(c("second_p")).cast("string"), F.lit("%)")), F.lit("")), F.lit("\n"))
    blank = F.concat(header, F.lit(" \n"), F.regexp_replace("message", "^\n", ""), told if strip else F.lit(""))
    full = F.array_join(F.transform(lines, lambda x, i: F.when(i == c("_at"), header).otherwise(x)), "\n")
    return held.withColumn("rewritten", F.when(F.coalesce(keep, F.lit(True)), c("message")).when(c("_first") == "", blank).otherwise(full)).drop("_at", "_first")


def records(commits: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    """Training records of commits (commit_id, repo, sha, author, ts, subject, patch): those with a type in their subject, a patch, and not too many files.

    commit_id must be unique; null subjects and patches make no record.
    """
    said = headers.corpus_subject(F.col("subject"))
    fit = commits.select("commit_id", "repo", "sha", "author", "ts", "subject", said.alias("said"), F.regexp_replace("patch", "^\n+", "").alias("patch")).where("said is not null and trim(patch) <> ''")
    trimmed = diffs.trimmed(fit.select("commit_id", "patch")).where((F.col("nfiles") > 0) & (F.col("nfiles") <= most_files))
    rows = fit.drop("patch").join(trimmed, "commit_id")
    bot: Column = F.coalesce(headers.is_bot(F.col("author")), F.lit(False))
    return rows.select("commit_id", "repo", "sha", "said.type", "said.scope", "said.breaking", "subject", "said.convention", bot.alias("bot"), "ts", "nfiles", "truncated", training.patch_hash(F.col("patch")).alias("patch_hash"), "patch")
