"""Bags of features of a change, their weights and hashed vectors, and structural measures of it.

Lines: (commit_id, added boolean, text); files: (commit_id, path, status, binary, added, removed, mode). Every function is
a few groupings by commit_id, so one partitioning by it serves them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions import fixed, paths, text


def counted_tokens(texts: DataFrame, prefixes: tuple[str, str]) -> DataFrame:
    """(commit_id, side, token, bucket, n) of texts (commit_id, side boolean, text); bucket is that of the token behind the prefix of its side, false or true.

    Dealt by commit alone, so that whatever is grouped by commit and more later stays where it is. Names are hashed before, as a Python step would lose that.
    """
    return _counted(texts, prefixes).repartition("commit_id").groupBy("commit_id", "side", "token", "bucket").agg(F.sum("n").alias("n"))


def _counted(texts: DataFrame, prefixes: tuple[str, str]) -> DataFrame:
    kind = dict(texts.dtypes)["commit_id"]
    return texts.select("commit_id", "side", "text").mapInArrow(text.counted_tokens(prefixes), f"commit_id {kind}, side boolean, token string, n bigint, bucket bigint")


def _short(lines: DataFrame) -> DataFrame:
    trimmed = text.trim(F.col("text"))
    # most lines are short as they are, and need not be trimmed twice
    short = lines.where((F.octet_length("text") <= fixed.LONG_LINE) | (F.octet_length(trimmed) <= fixed.LONG_LINE))
    return short.select("commit_id", F.col("added").alias("side"), trimmed.alias("text"))


def line_tokens(lines: DataFrame) -> DataFrame:
    """counted_tokens of added (a:) and removed (r:) lines that are not too long."""
    return counted_tokens(_short(lines), ("r:", "a:"))


def token_buckets(lines: DataFrame) -> DataFrame:
    """(bucket): those that token_counts of the lines have, each once. Counts are not dealt for it: a task sends its distinct buckets."""
    return _counted(_short(lines), ("r:", "a:")).select("bucket").distinct()


def token_counts(lines: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(commit_id, feature, n, bucket): a: or r: and the token. tokens: line_tokens(lines), if another step needs them too."""
    return (line_tokens(lines) if tokens is None else tokens).select("commit_id", F.concat(F.when(F.col("side"), "a:").otherwise("r:"), "token").alias("feature"), "n", "bucket")


def with_buckets(counts: DataFrame) -> DataFrame:
    """(..., bucket) of counts that don't have it yet. A batch's distinct names are hashed once."""
    return counts if "bucket" in counts.columns else counts.withColumn("bucket", text.bucket(F.col("feature")))


def bigram_counts(lines: DataFrame) -> DataFrame:
    """ab: and rb: features, of neighbours on a line."""
    toks = lines.where(F.octet_length(text.trim(F.col("text"))) <= fixed.LONG_LINE).select("commit_id", "added", text.tokens(text.trim(F.col("text"))).alias("t")).where(F.size("t") > 1)
    pairs = toks.select("commit_id", "added", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat(F.element_at("t", i), F.lit("_"), F.element_at("t", i + 1)))).alias("pair"))
    return pairs.groupBy("commit_id", F.concat(F.when(F.col("added"), "ab:").otherwise("rb:"), "pair").alias("feature")).agg(F.count("*").alias("n"))


def bigram_names(lines: DataFrame) -> DataFrame:
    """(feature): the features of bigram_counts, each once for a batch, not for each commit; nothing is dealt."""
    return _short(lines).select("side", "text").mapInArrow(text.distinct_pairs(("rb:", "ab:")), "feature string")


def _sides(lines: DataFrame, tokens: DataFrame | None) -> DataFrame:
    """(commit_id, token, x, y): whether added lines have it, and removed ones.

    A side is told by its counts, so that the same columns are dealt as for token_counts, once for both.
    """
    on = lambda side: F.sum(F.when(side, F.col("n"))).isNotNull()
    return (line_tokens(lines) if tokens is None else tokens).groupBy("commit_id", "token").agg(on(F.col("side")).alias("x"), on(~F.col("side")).alias("y"))


def vocabulary_difference(lines: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(commit_id, feature, n = 1): x: tokens only added, y: only removed. tokens: line_tokens(lines), if another step needs them too."""
    return _sides(lines, tokens).where("x <> y").select("commit_id", F.concat(F.when(F.col("x"), "x:").otherwise("y:"), "token").alias("feature"), F.lit(1).cast("bigint").alias("n"))


def shape_counts(lines: DataFrame) -> DataFrame:
    """(commit_id, feature, n): A1:/R1: and the line's shape; long lines are <long>. If lines have a path, also AL:/RL:, its language and the shape (long lines have none)."""
    trimmed = text.trim(F.col("text"))
    long = F.octet_length(trimmed) > fixed.LONG_LINE
    shape = F.when(long, "<long>").otherwise(text.shape(trimmed))
    plain = F.concat(F.when(F.col("added"), "A1:").otherwise("R1:"), shape)
    if "path" not in lines.columns:
        return lines.groupBy("commit_id", plain.alias("feature")).agg(F.count("*").alias("n"))
    of_language = F.when(~long, F.concat(F.when(F.col("added"), "AL:").otherwise("RL:"), paths.language(paths.extension(F.col("path"))), F.lit(":"), shape))
    names = lines.select("commit_id", F.explode(F.array(plain, of_language)).alias("feature")).where("feature is not null")
    return names.groupBy("commit_id", "feature").agg(F.count("*").alias("n"))


def hunk_counts(files: DataFrame) -> DataFrame:
    """(commit_id, feature, n) of files (commit_id, hunks array<string>): h: each token of a hunk's context, hs: its shape. Files without contexts have none."""
    each = files.select("commit_id", F.explode("hunks").alias("text")).where("text is not null")
    told = counted_tokens(each.withColumn("side", F.lit(True)), ("", "h:")).select("commit_id", F.concat(F.lit("h:"), "token").alias("feature"), "n")
    shapes = each.select("commit_id", F.concat(F.lit("hs:"), text.shape(F.col("text"))).alias("feature")).groupBy("commit_id", "feature").agg(F.count("*").alias("n"))
    return told.unionByName(shapes)


def message_counts(messages: DataFrame) -> DataFrame:
    """(commit_id, feature, n) of message_names()."""
    return message_names(messages).groupBy("commit_id", "feature").agg(F.count("*").alias("n"))


def message_names(messages: DataFrame) -> DataFrame:
    """(commit_id, feature), as often as it occurs, of subjects (commit_id, message): m1: first, m: each, m2: neighbours; what follows the last "(#" is cut."""
    cut = F.regexp_replace("message", r"^(.+)\(#(?:[^(]|\([^#]|\($)*$", "$1")
    toks = messages.where("message is not null and message <> ''").select("commit_id", text.tokens(cut).alias("t"))
    names = F.when(F.size("t") == 0, F.array(F.lit("m:<empty>"))).otherwise(
        F.concat(
            F.array(F.concat(F.lit("m1:"), F.get("t", F.lit(0)))),
            F.transform("t", lambda x: F.concat(F.lit("m:"), x)),
            F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.concat(F.lit("m2:"), F.element_at("t", i), F.lit("_"), F.element_at("t", i + 1)))).otherwise(F.array().cast("array<string>")),
        )
    )
    return toks.select("commit_id", F.explode(names).alias("feature"))


def path_counts(files: DataFrame) -> DataFrame:
    """(commit_id, feature, n) of path_names()."""
    return path_names(files).groupBy("commit_id", "feature").agg(F.count("*").alias("n"))


def path_names(files: DataFrame) -> DataFrame:
    """(commit_id, feature), as often as it occurs, of the path group; files need commit_id, path, status, binary. With old_path (empty for none) also ren: features of moves."""
    p, low = F.col("path"), F.lower("path")
    base, ext = paths.base_name(low), paths.extension(p)
    lang, cat = paths.language(ext), paths.category(p)
    segments = F.filter(F.split(paths.directory(low), "/"), lambda s: s != "")
    base_words = text.tokens(F.when(ext != "", F.substr(base, F.lit(1), F.length(base) - F.length(ext) - 1)).otherwise(base))
    tag = lambda t, *c: F.concat(F.lit(f"{t}:"), *c)
    n = F.size(segments)
    last = F.when(n > 0, F.element_at(segments, -1)).otherwise("<root>")
    none = F.array().cast("array<string>")
    moved = none
    if "old_path" in files.columns:
        old = F.lower("old_path")
        told = F.array(F.when(paths.directory(old) == paths.directory(low), "ren:samedir").otherwise("ren:moved"), F.when(paths.extension(old) != ext, "ren:ext"))
        moved = F.when(old != "", F.filter(told, lambda x: x.isNotNull())).otherwise(none)
    names = F.concat(
        F.transform(segments, lambda s: tag("p", s)),
        F.when(n > 0, F.array(tag("p0", F.get(segments, F.lit(0))))).otherwise(F.array().cast("array<string>")),
        F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: tag("pp", F.element_at(segments, i), F.lit("/"), F.element_at(segments, i + 1)))).otherwise(F.array().cast("array<string>")),
        F.array(tag("pl", last), tag("fe", last, F.lit("/"), ext)),
        F.array(tag("f", base), tag("e", ext), tag("l", lang), tag("c", cat), tag("s", F.col("status"))),
        F.transform(base_words, lambda w: tag("fw", w)),
        F.array(tag("cs", cat, F.lit("_"), F.col("status")), tag("es", ext, F.lit("_"), F.col("status")), tag("ce", cat, F.lit("_"), ext), tag("ls", lang, F.lit("_"), F.col("status"))),
        F.when(F.col("binary"), F.array(F.lit("bin"))).otherwise(none),
        moved,
    )
    return files.select("commit_id", F.explode(names).alias("feature"))


def log_tf_l2(counts: DataFrame) -> DataFrame:
    """Adds weight: log1p(n) over the commit's (and group's, if there is a column grp) root of sums of squares."""
    keys = [c for c in ("commit_id", "grp") if c in counts.columns]
    norm = F.sqrt(F.sum(F.pow(F.log1p("n"), F.lit(2.0))).over(Window.partitionBy(*keys)))
    return counts.withColumn("weight", F.log1p("n") / norm)


def hashed(weighted: DataFrame) -> DataFrame:
    """(commit_id, bucket, weight): features that share a bucket are summed. With buckets from before log_tf_l2 (with_buckets) rows stay where that dealt them: by commit."""
    return with_buckets(weighted).groupBy("commit_id", "bucket").agg(F.sum("weight").alias("weight"))


def token_jaccard(lines: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(commit_id, jaccard) of the added and removed vocabularies; 0 if there are no tokens. tokens: line_tokens(lines), if another step needs them too."""
    by = _sides(lines, tokens).groupBy("commit_id").agg(F.count_if(F.col("x") & F.col("y")).alias("both"), F.count("*").alias("either"))
    return by.select("commit_id", text.ratio(F.col("both"), F.col("either")).alias("jaccard"))


def hashed_groups(groups: dict[str, DataFrame]) -> DataFrame:
    """hashed() of counts by group, each weighted on its own; buckets that groups share are summed. All is dealt by commit once."""
    counted = reduce(DataFrame.unionByName, [with_buckets(counts).select("commit_id", "bucket", "n").withColumn("grp", F.lit(name)) for name, counts in groups.items()])
    return hashed(log_tf_l2(counted.repartition("commit_id")))


def space_only_similarity(lines: DataFrame) -> DataFrame:
    """(commit_id, similarity): twice the common lines, white space aside, over all lines."""
    norm = text.without_space(text.trim(F.col("text")))
    short = lines.where(F.octet_length(text.trim(F.col("text"))) <= fixed.LONG_LINE)
    by_line = short.groupBy("commit_id", norm.alias("line")).agg(F.count_if("added").alias("x"), F.count_if(~F.col("added")).alias("y"))
    by = by_line.groupBy("commit_id").agg(F.sum(F.least("x", "y")).alias("common"), F.sum(F.col("x") + F.col("y")).alias("n"))
    return by.select("commit_id", text.ratio(2 * F.col("common"), F.col("n")).alias("similarity"))


def keyword_counts(lines: DataFrame) -> DataFrame:
    """One row a commit: how many added lines have each kind of word, deprecation counting removed ones too."""
    trimmed = text.trim(F.col("text"))
    rows = lines.select("commit_id", "added", trimmed.alias("t"), F.lower(trimmed).alias("low")).where(F.octet_length("t") <= fixed.LONG_LINE)
    added, low, t = F.col("added"), F.col("low"), F.col("t")
    return rows.groupBy("commit_id").agg(
        F.count_if(added & text.has_test_word(low)).alias("n_test"),
        F.count_if(added & text.has_error_word(low)).alias("n_error"),
        F.count_if(added & text.has_null_word(low)).alias("n_null"),
        F.count_if(added & text.has_log_word(low)).alias("n_log"),
        F.count_if(added & text.has_type_word(low)).alias("n_type"),
        F.count_if(low.contains("deprecat")).alias("n_deprecated"),
        F.count_if(added & t.rlike("[\"'`]")).alias("n_string"),
        F.count_if(added & text.is_trivial(t)).alias("n_trivial"),
        F.count_if(added & text.is_comment(t)).alias("n_comment_added"),
        F.count_if(~added & text.is_comment(t)).alias("n_comment_removed"),
        F.count_if(added & text.is_import(t)).alias("n_import_added"),
        F.count_if(~added & text.is_import(t)).alias("n_import_removed"),
        F.sum(F.when(added, F.octet_length(t)).otherwise(0)).alias("added_bytes"),
    )


def file_counters(files: DataFrame) -> DataFrame:
    """One row a commit: counts and shares of its files; files need path, status, binary, added, removed, mode.

    Only what is counted is dealt, by commit and once: a file's marks are bits, and so is its language, of which there are few, so that extensions are the
    only distinct values to gather.
    """
    ext = paths.extension(F.col("path"))
    added, removed, lines = F.col("added"), F.col("removed"), F.col("added") + F.col("removed")
    marks = {
        "new_files": F.col("status") == "added", "deleted_files": F.col("status") == "deleted", "renamed_files": F.col("status").isin("renamed", "copied"), "binary_files": F.col("binary"),
        "pure_add_files": (added > 0) & (removed == 0), "pure_delete_files": (added == 0) & (removed > 0), "executable_files": F.col("mode").endswith("755"),
    }
    bits = sum((F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(marks.values())), F.lit(0))
    dealt = files.select("commit_id", "added", "removed", bits.alias("marks"), ext.alias("ext")).repartition("commit_id")
    families = F.lit(0).cast("bigint")
    for i, family in enumerate(["none", *fixed.LANGUAGES, "unknown"]):
        families = F.when(F.col("language") == family, F.lit(1 << i).cast("bigint")).otherwise(families)
    mark = lambda name: F.count_if(F.col("marks").bitwiseAND(1 << list(marks).index(name)) != 0).alias(name)
    return dealt.withColumn("language", paths.language(F.col("ext"))).groupBy("commit_id").agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), *[mark(x) for x in list(marks)[:6]], F.max(lines).alias("largest_file"), mark("executable_files"),
        F.bit_count(F.bit_or(families)).cast("bigint").alias("languages"), F.count_distinct("ext").alias("extensions"),
    )


def category_shares(files: DataFrame) -> DataFrame:
    """(commit_id, category, file_share, line_share, only): shares of the commit's files and lines; only: all its files are of it."""
    by = files.groupBy("commit_id", paths.category(F.col("path")).alias("category")).agg(F.count("*").alias("files"), F.sum(F.col("added") + F.col("removed")).alias("lines"))
    whole = Window.partitionBy("commit_id")
    return by.select("commit_id", "category", text.ratio(F.col("files"), F.sum("files").over(whole)).alias("file_share"), text.ratio(F.col("lines"), F.sum("lines").over(whole)).alias("line_share"), (F.col("files") == F.sum("files").over(whole)).alias("only"))


def version_bump(files_lines: DataFrame) -> DataFrame:
    """(commit_id, version_bump) of rows (commit_id, path, added, text): a manifest with a version line on either side. Commits without such files have no row.

    The condition on the path goes below the generator of a file's lines: a path is looked at once, and other files' lines are not made.
    """
    held = files_lines.where(paths.category(F.col("path")).isin("build", "version", "lock", "config"))
    fit = text.is_version_line(F.lower("text"))
    by_file = held.groupBy("commit_id", "path").agg(F.bool_or(fit & F.col("added")).alias("x"), F.bool_or(fit & ~F.col("added")).alias("y"))
    return by_file.groupBy("commit_id").agg(F.bool_or(F.col("x") & F.col("y")).alias("version_bump"))


#: What each structural slot of dense() measures, in their order.
SLOT_NAMES = [
    "file_count", "lines_added", "lines_removed", "share_added", "lines_changed", "share_new_files", "share_deleted_files", "share_moved_files", "share_binary_files", *(f"files:{c}" for c in fixed.CATEGORIES), *(f"only:{c}" for c in fixed.CATEGORIES),
    "spacing_only", "common_tokens", "comments_in_added", "comments_in_removed", "imports_in_added", "imports_in_removed", "files_only_adding", "files_only_removing", "version_changed", "language_count", "largest_file", "has_message", "lines_in_tests",
    "lines_in_docs", "lines_in_source", "cut_short", "one_file", "hunk_count", "executable_files", "line_length", "trivial_lines", "test_words", "one_extension", "lines_in_ci", "lines_in_build", "lines_in_config", "lines_in_style", "lines_in_schema",
    "lines_in_generated", "lines_in_i18n", "lines_in_changelog", "strings", "growth", "error_words", "null_words", "log_words", "deprecations", "type_words", "nothing_removed", "nothing_added", "tests_with_source",
]


def dense(counters: DataFrame, keywords: DataFrame, shares: DataFrame, similarity: DataFrame, jaccard: DataFrame, bumps: DataFrame, more: DataFrame) -> DataFrame:
    """(commit_id, dense array<double>): the 88 structural features in their fixed order. more: commit_id, hunks, truncated, has_message."""
    c = F.col
    wide = shares.groupBy("commit_id").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("file_share", "line_share", "only")))).alias("cats"))
    rows = counters.join(wide, "commit_id")
    for other in (keywords, similarity, jaccard, bumps, more):
        rows = rows.join(other, "commit_id", "left")
    zero = lambda name: F.coalesce(c(name).cast("double"), F.lit(0.0))
    share = lambda cat, field: F.coalesce(F.try_element_at("cats", F.lit(cat))[field].cast("double"), F.lit(0.0))
    flag = lambda cond: F.coalesce(cond.cast("double"), F.lit(0.0))
    total, n = c("added") + c("removed"), c("files")
    per_added = lambda name: text.ratio(zero(name), c("added"))
    lines_in = lambda *cats: sum((share(x, "line_share") for x in cats[1:]), share(cats[0], "line_share"))
    slots = [text.log_scale(n, 200), text.log_scale(c("added"), 20000), text.log_scale(c("removed"), 20000), text.ratio(c("added"), total), text.log_scale(total, 40000)]
    slots += [text.ratio(c(x), n) for x in ("new_files", "deleted_files", "renamed_files", "binary_files")]
    slots += [share(x, "file_share") for x in fixed.CATEGORIES] + [share(x, "only") for x in fixed.CATEGORIES]
    slots += [zero("similarity"), zero("jaccard"), per_added("n_comment_added"), text.ratio(zero("n_comment_removed"), c("removed")), per_added("n_import_added"), text.ratio(zero("n_import_removed"), c("removed"))]
    slots += [text.ratio(c("pure_add_files"), n), text.ratio(c("pure_delete_files"), n), flag(c("version_bump")), text.clamp(c("languages") / 5.0), text.ratio(c("largest_file"), total), flag(c("has_message"))]
    slots += [lines_in("test", "snapshot"), lines_in("docs"), lines_in("source"), flag(c("truncated")), flag(n == 1), text.log_scale(zero("hunks"), 2000), text.ratio(c("executable_files"), n)]
    slots += [text.clamp(text.ratio(zero("added_bytes"), c("added")) / 120.0), per_added("n_trivial"), per_added("n_test"), flag(c("extensions") == 1)]
    slots += [lines_in("ci"), lines_in("build", "lock", "version"), lines_in("config"), lines_in("style"), lines_in("schema"), lines_in("generated"), lines_in("i18n"), lines_in("changelog"), per_added("n_string")]
    slots += [text.clamp(F.lit(0.5) + (c("added") - c("removed")) / F.greatest(total, F.lit(1)) / 2.0), per_added("n_error"), per_added("n_null"), per_added("n_log"), text.clamp(zero("n_deprecated") / 3.0), per_added("n_type")]
    slots += [flag((c("removed") == 0) & (c("added") > 0)), flag((c("added") == 0) & (c("removed") > 0)), flag((share("test", "file_share") > 0) & (share("source", "file_share") > 0))]
    return rows.select("commit_id", F.array(*[s.cast("double") for s in slots]).alias("dense"))
