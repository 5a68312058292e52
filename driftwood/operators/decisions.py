"""What is decided about a commit: scope, emoji, lint verdict, calibration; all from small per-commit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions import fixed, headers, paths


def scope_votes(files: DataFrame) -> DataFrame:
    """(commit_id, scope, votes, strong, files): candidates and how many of the commit's files vote for them."""
    voted = files.select("commit_id", paths.scope_candidate(F.col("path")).alias("c"))
    n = voted.groupBy("commit_id").agg(F.count("*").alias("files"))
    by = voted.where("c.scope is not null").groupBy("commit_id", F.col("c.scope").alias("scope")).agg(F.count("*").alias("votes"), F.bool_or("c.strong").alias("strong"))
    return by.join(n, "commit_id")


def guess_scope(files: DataFrame, habits: DataFrame | None = None, repo_of: DataFrame | None = None) -> DataFrame:
    """(commit_id, scope) of every commit of files; empty for none.

    The best candidate must have a clear majority of the files (unless there is one). habits: (repo, conventional, with_scope, scopes
    array<struct<scope, n>>); repo_of: (commit_id, repo). With 20 conventional commits the repo's spelling wins (the most frequent, then by name), a repo that rarely
    scopes gets none, one that mostly does gets the candidate if it is strong or unanimous. Without, only strong candidates count.
    """
    order = F.row_number().over(Window.partitionBy("commit_id").orderBy(F.col("votes").desc(), "scope"))
    best = scope_votes(files).withColumn("n", order).where("n = 1").where((2 * F.col("votes") > F.col("files")) | (F.col("files") == 1))
    strong_only = F.when(F.col("strong"), F.col("scope"))
    if habits is None:
        chosen = best.select("commit_id", strong_only.alias("chosen"))
    else:
        rows = best.join(repo_of, "commit_id").join(habits, "repo", "left")
        same = F.filter("scopes", lambda s: F.lower(F.regexp_replace(s["scope"], "^@", "")) == F.lower("scope"))
        spelled = F.get(F.array_sort(F.transform(same, lambda s: F.struct((-s["n"]).alias("n"), s["scope"].alias("scope")))), F.lit(0))["scope"]
        rate = F.try_divide(F.col("with_scope"), F.col("conventional"))
        learned = F.coalesce(spelled, F.when((rate >= 0.5) & (F.col("strong") | (F.col("votes") == F.col("files"))), F.col("scope")))
        chosen = rows.select("commit_id", F.when(F.coalesce(F.col("conventional") >= 20, F.lit(False)), learned).otherwise(strong_only).alias("chosen"))
    return files.select("commit_id").distinct().join(chosen, "commit_id", "left").select("commit_id", F.coalesce("chosen", F.lit("")).alias("scope"))


def file_predicates(files: DataFrame) -> DataFrame:
    """One row a commit: what holds for all its files. files: commit_id, path, status, added, removed."""
    p = F.col("path")
    of = lambda c: F.count_if(F.col("_category") == c).alias(f"n_{c}")
    # a column, as each count would work the category out again
    return files.withColumn("_category", paths.category(p)).groupBy("commit_id").agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.count_if(F.col("status").isin("renamed", "copied")).alias("renamed"), F.max(F.col("added") + F.col("removed")).alias("largest"),
        F.bool_and(F.lower(paths.base_name(p)) == ".gitignore").alias("all_gitignore"), F.bool_and(paths.is_license(p)).alias("all_license"), F.bool_and(paths.is_contributors(p)).alias("all_contributors"),
        F.bool_and(paths.is_bot_config(p)).alias("all_bot_config"), F.bool_and(paths.is_types(p)).alias("all_types"), F.bool_and(paths.is_database(p)).alias("all_database"), F.bool_and(paths.is_mock(p)).alias("all_mock"),
        *[of(c) for c in ("i18n", "asset", "style", "ci", "docs", "changelog", "snapshot", "build", "lock", "version")],
    )


def line_signals(lines: DataFrame, truncated: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(commit_id, logs, comments): logs is 1 if only log lines were added, -1 if only removed, else 0; comments: all lines are comments.

    Lines that a diff's caps left out could be anything, so a commit that `truncated` (commit_id, truncated) names says nothing of logs; and one with a
    binary file (files: commit_id, binary) isn't all comments.
    """
    full = lines.where(F.col("text").rlike(r"\S"))
    is_log, added = F.col("text").rlike(fixed.LOG_LINE), F.col("added")
    by = full.groupBy("commit_id").agg(F.count_if(~is_log).alias("other"), F.count_if(is_log & added).alias("log_added"), F.bool_and(F.col("text").rlike(fixed.COMMENT_LINE)).alias("comments"))
    by = by.join(truncated.select("commit_id", "truncated"), "commit_id", "left") if truncated is not None else by.withColumn("truncated", F.lit(False))
    binary = files.groupBy("commit_id").agg(F.bool_or("binary").alias("binary")) if files is not None else None
    by = by.join(binary, "commit_id", "left") if binary is not None else by.withColumn("binary", F.lit(False))
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    logs = F.when((F.col("other") > 0) | known("truncated"), 0).when(F.col("log_added") > 0, 1).otherwise(-1)
    return by.select("commit_id", logs.alias("logs"), (F.col("comments") & ~known("binary")).alias("comments"))


def pick_emoji(rows: DataFrame) -> DataFrame:
    """Adds emoji, a code. rows: type, breaking, subject, and the columns of file_predicates, line_signals, dependency (nullable), version_bump."""
    c, kind = F.col, F.col("type")
    message = F.lower(F.coalesce("subject", F.lit("")))
    says = lambda name: message.rlike(fixed.MESSAGE[name])
    every = lambda cat: (c("files") > 0) & (c(f"n_{cat}") == c("files"))
    gone = (c("removed") > 0) & (c("added") == 0)
    # one rule a line, the first that holds wins: (types, condition, code); no types: any
    rules: list[tuple[str, Column, str]] = [
        ("", says("wip"), "construction"), ("revert", F.lit(True), "rewind"), ("", c("breaking"), "boom"),
        ("", c("files") == 0, ""), ("", c("all_gitignore"), "see_no_evil"), ("", c("all_license"), "page_facing_up"), ("", c("all_contributors"), "busts_in_silhouette"), ("", c("all_bot_config"), "wrench"),
        ("", (c("renamed") > 0) & (2 * c("renamed") >= c("files")) & (c("largest") <= 10), "truck"), ("", every("i18n") & (kind != "test"), "globe_with_meridians"), ("", every("asset") & ~kind.isin("docs", "test"), "bento"),
        ("", (c("logs") > 0) & ~kind.isin("docs", "test", "ci", "build"), "loud_sound"), ("", (c("logs") < 0) & ~kind.isin("docs", "test", "ci", "build"), "mute"),
        ("feat", c("all_types"), "label"), ("feat", c("all_database"), "card_file_box"), ("feat", every("style"), "lipstick"), ("feat", says("i18n"), "globe_with_meridians"), ("feat", says("a11y"), "wheelchair"),
        ("feat", says("analytics"), "chart_with_upwards_trend"), ("feat", says("flag"), "triangular_flag_on_post"), ("feat", says("animation"), "dizzy"), ("feat", says("responsive"), "iphone"), ("feat", says("seo"), "mag"),
        ("feat", says("authz"), "passport_control"), ("feat", says("validation"), "safety_vest"), ("feat", says("deprecate"), "wastebasket"), ("feat", gone, "fire"),
        ("fix", says("hotfix"), "ambulance"), ("fix", every("ci"), "green_heart"),
        ("docs", says("typo"), "pencil2"), ("docs", (c("n_docs") == 0) & (c("n_changelog") == 0) & c("comments"), "bulb"),
        ("style", every("style"), "lipstick"), ("style", says("lint"), "rotating_light"), ("style", says("typo"), "pencil2"),
        ("refactor", says("dead_code") & gone, "coffin"), ("refactor", gone, "fire"), ("refactor", says("deprecate"), "wastebasket"), ("refactor", says("architecture"), "building_construction"), ("refactor", c("all_types"), "label"), ("refactor", c("all_database"), "card_file_box"),
        ("test", c("all_mock"), "clown_face"), ("test", every("snapshot"), "camera_flash"), ("test", says("failing"), "test_tube"),
        ("ci", c("dependency").isNull() & says("ci_fix"), "green_heart"),
        ("build chore ci", c("dependency").isNull() & (c("version_bump") | (says("release") & (kind != "ci"))), "bookmark"),
        ("build chore ci", c("dependency").isNull() & says("bump") & (c("n_build") + c("n_lock") + c("n_ci") > 0), "arrow_up"),
        ("build chore ci", c("dependency").isNull() & says("downgrade") & (c("n_build") + c("n_lock") > 0), "arrow_down"),
        ("build chore ci", c("dependency").isNull() & says("pin") & (c("n_build") + c("n_lock") > 0), "pushpin"),
        ("ci", c("dependency").isNull() & every("ci"), "construction_worker"), ("chore", c("dependency").isNull() & says("typo"), "pencil2"), ("chore", c("dependency").isNull() & says("deprecate"), "wastebasket"), ("chore", c("dependency").isNull() & c("all_types"), "label"),
    ]
    usual = F.coalesce(F.try_element_at(headers.known_map(fixed.EMOJI_OF_TYPE), kind), F.lit("wrench"))
    chosen = None
    for types, condition, code in rules:
        holds = F.coalesce(condition, F.lit(False)) & (kind.isin(*types.split()) if types else F.lit(True))
        value = F.lit(code) if code else usual
        chosen = F.when(holds, value) if chosen is None else chosen.when(holds, value)
    chosen = chosen.when(kind.isin("build", "chore", "ci") & F.col("dependency").isNotNull(), F.col("dependency")).otherwise(usual)
    return rows.withColumn("emoji", chosen)


def adapt_emoji(picks: DataFrame, used: DataFrame) -> DataFrame:
    """Adds adapted: the repo's favourite of the type, if the pick is not a habit there. picks: (repo, type, emoji); used: (repo, code, n).

    Of favourites with equal use the first in the emoji table wins.
    """
    table = used.sparkSession.createDataFrame([(code, kind, i) for i, (_, code, kind) in enumerate(fixed.EMOJI)], "code string, kind string, ord int")
    held = used.join(F.broadcast(table), "code")  # 75 rows
    favourite = held.groupBy("repo", "kind").agg(F.max_by("code", F.struct("n", -F.col("ord"))).alias("favourite"), F.max("n").alias("most"))
    own = used.select("repo", F.col("code").alias("emoji"), F.col("n").alias("own"))
    kinds = table.select(F.col("code").alias("emoji"), "kind")
    rows = picks.join(F.broadcast(kinds), "emoji", "left").join(own, ["repo", "emoji"], "left").join(favourite.withColumnRenamed("kind", "type"), ["repo", "type"], "left")
    n, most = F.coalesce("own", F.lit(0)), F.coalesce("most", F.lit(0))
    keep = (F.coalesce("kind", F.lit("")) != F.col("type")) | (most < 3) | (n * 10 >= most) | (F.col("emoji").isin(*fixed.STRUCTURAL_EMOJI) & (n > 0))
    return rows.select(*picks.columns, F.when(keep, F.col("emoji")).otherwise(F.col("favourite")).alias("adapted"))


def manifest(path: Column) -> Column:
    """Which parser a file's lines take; null if it is no manifest."""
    b = F.lower(paths.base_name(path))
    named = F.try_element_at(headers.known_map(fixed.MANIFESTS), b)
    return (
        F.when(named.isNotNull(), named)
        .when(b.rlike(r"^requirements.*\.txt$") | (b == "constraints.txt"), "requirements")
        .when(b.startswith("dockerfile") | b.endswith(".dockerfile"), "docker")
        .when(b.rlike(r"\.ya?ml$") & (paths.category(path) == "ci"), "uses")
    )


def dependency(parser: Column, line: Column) -> Column:
    """struct(name, version) of a manifest line; null if it is none."""
    part = lambda kind, i: F.regexp_extract(line, fixed.DEPENDENCY_LINES[kind], i)
    out = None
    for kind in ("json", "go", "toml", "requirements", "gem", "yaml", "mix", "gradle", "swift", "uses", "docker"):
        name, version = part(kind, 1), part(kind, 2)
        fits = name != ""
        if kind in fixed.NO_DEPENDENCY:
            fits = fits & ~F.lower(name).isin(*fixed.NO_DEPENDENCY[kind])
        if kind == "json":
            fits = fits & headers.looks_like_version(version)
        elif kind == "go":
            fits = fits & ~line.rlike(fixed.GO_DIRECTIVES)
        elif kind == "toml":
            version = F.when(version != "", version).otherwise(part(kind, 3))
            fits = fits & (headers.looks_like_version(version) | (version == "*"))
        elif kind == "requirements":
            version = F.concat(version, part(kind, 3))
            fits = fits & ~line.rlike(r"^\s*[#-]")
        found = F.when(fits, F.struct(name.alias("name"), version.alias("version")))
        if kind == "toml":
            found = F.when(name != "", found).when(part("pylist", 1) != "", F.struct(part("pylist", 1).alias("name"), part("pylist", 2).alias("version")))
        out = F.when(parser == kind, found) if out is None else out.when(parser == kind, found)
    return out


def dependency_changes(lines: DataFrame) -> DataFrame:
    """(commit_id, name, old, new, kind) of lines (commit_id, ln, path, added, text) of manifests; the last line of a name wins."""
    # a file's path is looked at once where its lines are made from it, as this condition goes below their generator; others' lines are not made
    lines = lines.where(manifest(F.col("path")).isNotNull())
    # from a generator, as the optimiser would copy the parser's expression into each of its uses otherwise
    told = lines.select("commit_id", "ln", "added", "text", F.explode(F.array_compact(F.array(manifest(F.col("path"))))).alias("parser"))
    parsed = told.select("commit_id", "ln", "added", dependency(F.col("parser"), F.col("text")).alias("d")).where("d is not null")
    last = lambda cond: F.coalesce(F.max_by(F.when(cond, F.col("d.version")), F.when(cond, F.col("ln"))), F.lit(""))
    by = parsed.groupBy("commit_id", F.col("d.name").alias("name")).agg(last(~F.col("added")).alias("old"), last(F.col("added")).alias("new"))
    major = lambda v: F.regexp_extract(v, "[0-9]+", 0)
    old, new = F.col("old"), F.col("new")
    way = headers.compare_versions(old, new)
    pinned = headers.is_range(old) & ~headers.is_range(new) & (major(old) != "") & (major(old).try_cast("bigint") == major(new).try_cast("bigint"))
    kind = F.when((old == "") & (new != ""), "added").when((new == "") & (old != ""), "removed").when(old == new, "other").when(F.coalesce(pinned, F.lit(False)), "pinned").when(way == 1, "up").when(way == -1, "down").otherwise("other")
    return by.withColumn("kind", kind)


def dependency_emoji(changes: DataFrame) -> DataFrame:
    """(commit_id, dependency): the emoji of changes that are all of one kind; package for mixed ones."""
    n = lambda k: F.count_if(F.col("kind") == k)
    total = F.count("*")
    code = F.when(n("added") == total, "heavy_plus_sign").when(n("removed") == total, "heavy_minus_sign").when((n("up") > 0) & (n("up") + n("pinned") == total), "arrow_up").when(n("down") == total, "arrow_down").when(n("pinned") == total, "pushpin").otherwise("package")
    return changes.groupBy("commit_id").agg(code.alias("dependency"))


def release_only(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(commit_id, version_bump): whether all that changed is version files, changelogs, lock files and the version lines of manifests.

    files: commit_id, path, added, removed; lines: commit_id, path, text. At least one version must have changed. Where fewer lines are
    there than were changed, nothing can be told: false. So it is for a commit with any other file.
    """
    # of the line without white space around it, which need not be cut off for that
    versions = F.col("text").contains("version") & F.col("text").rlike(r'(?U)^\s*(?:"version"|version(?:[=:]| \s*\S))')
    by_file = lines.groupBy("commit_id", "path").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"(?U)\S")).alias("full"), F.count_if(versions).alias("versions"))
    held = files.select("commit_id", "path", "added", "removed").join(by_file, ["commit_id", "path"], "left")
    held = held.withColumns({"_category": paths.category(F.col("path")), "_manifest": manifest(F.col("path")).isNotNull()})
    cat, n = F.col("_category"), lambda c: F.coalesce(c, F.lit(0))
    free = cat.isin("version", "changelog", "lock")
    fits = free | (F.col("_manifest") & (n("full") == n("versions")))
    bumped = (cat == "version") | (~free & (n("versions") > 0))
    whole = n("n") >= n("added") + n("removed")
    return held.groupBy("commit_id").agg((F.bool_and(fits & whole) & F.bool_or(bumped)).alias("version_bump"))


def lint(commits: DataFrame, disputed_from: float = fixed.DISPUTE_FROM) -> DataFrame:
    """Adds status: missing (no declared type), disputed (not among the two best guesses, the best being sure), ok. commits: declared, first, p, second."""
    missing = F.col("declared").isNull() | (F.col("declared") == "")
    disputed = (F.col("declared") != F.col("first")) & (F.coalesce("second", F.lit("")) != F.col("declared")) & (F.col("p") >= disputed_from)
    return commits.withColumn("status", F.when(missing, "missing").when(disputed, "disputed").otherwise("ok"))


def calibration(scored: DataFrame, buckets: int = 10) -> DataFrame:
    """(bucket, n, mean_p, accuracy) of rows (p, correct): how often guesses of each confidence are right."""
    b = F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)).cast("int")
    return scored.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def topk_metrics(ranked: DataFrame) -> DataFrame:
    """(type, n, top1, top2) by true type. ranked: (type, first, second)."""
    one, two = (F.col("first") == F.col("type")).cast("double"), ((F.col("first") == F.col("type")) | (F.coalesce("second", F.lit("")) == F.col("type"))).cast("double")
    return ranked.groupBy("type").agg(F.count("*").alias("n"), F.avg(one).alias("top1"), F.avg(two).alias("top2"))
