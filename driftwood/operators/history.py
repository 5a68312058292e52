"""Evidence from a repository's own past, for every commit at once: what came strictly before it, within the last commits.

Commits: (repo, pos, type, ...), pos numbering a repo's commits in order of time. All is windows over (repo, pos) or
joins on keys that hold a block of positions, so that the frame bounds the work per commit, whatever the repo's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwood.functions import fixed, headers
from driftwood.operators import scan


def numbered(commits: DataFrame, order: list[str], wide: bool = False) -> DataFrame:
    """Adds pos: 1, 2, ... within repo, by `order` (which must be total). wide: all tasks share a large repo; else a repo is one task's."""
    if wide:
        return scan.numbered(commits, ["repo"], order)
    return commits.withColumn("pos", F.row_number().over(Window.partitionBy("repo").orderBy(*order)).cast("bigint"))


def before(window: int = fixed.WINDOW, *more: str):
    return Window.partitionBy("repo", *more).orderBy("pos").rangeBetween(-window, -1)


def habits(commits: DataFrame) -> DataFrame:
    """One row a repo: commits, and how many have each type, as a map; more habits from type, scope and emoji columns if there."""
    by = commits.groupBy("repo", "type").agg(F.count("*").alias("n"))
    return by.groupBy("repo").agg(F.sum("n").alias("commits"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n"))))).alias("types"))


def recent(commits: DataFrame, most: int = fixed.WINDOW, skip: int = 0) -> DataFrame:
    """The `most` newest commits of each repo, without the `skip` newest: what is older than a range that is checked."""
    age = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("pos").desc()))
    return commits.withColumn("age", age).where((F.col("age") > skip) & (F.col("age") <= skip + most)).drop("age")


def subject_habits(commits: DataFrame, known: list[str] = fixed.CLASSES) -> DataFrame:
    """What a repo's subjects (repo, subject) usually say: (repo, commits, conventional, with_scope, types, scopes, emoji), the last three
    array<struct<name, n>>, called type, scope and code, sorted by name.

    Blank and null subjects don't count. One aggregation by name, of which each repo has few, then one by repo.
    """
    said = F.trim("subject")
    full = commits.select("repo", headers.header(said, known).alias("h"), headers.emoji_header(said)["code"].alias("code")).where(said != "")
    names = F.array(
        F.struct(F.lit("commits").alias("kind"), F.lit("").alias("name")), F.struct(F.when(F.col("h").isNotNull(), "type").alias("kind"), F.col("h.type").alias("name")),
        F.struct(F.when(F.col("h.scope") != "", "scope").alias("kind"), F.col("h.scope").alias("name")), F.struct(F.when(F.col("code").isNotNull(), "code").alias("kind"), F.col("code").alias("name")),
    )
    counted = full.select("repo", F.explode(names).alias("x")).where("x.kind is not null").groupBy("repo", "x.kind", "x.name").agg(F.count("*").alias("n"))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("name").alias(kind), "n"))))
    return counted.groupBy("repo").agg(total("commits").alias("commits"), total("type").alias("conventional"), total("scope").alias("with_scope"), listed("type").alias("types"), listed("scope").alias("scopes"), listed("code").alias("emoji"))


def laplace(commits: DataFrame, classes: list[str]) -> DataFrame:
    """(repo, type, p) for every class: (n + 1) / (N + C)."""
    counted = commits.groupBy("repo").agg(*[F.count_if(F.col("type") == c).alias(f"n{i}") for i, c in enumerate(classes)], F.count_if(F.col("type").isin(*classes)).alias("total"))
    return counted.select("repo", "total", F.explode(F.array(*[F.struct(F.lit(c).alias("type"), F.col(f"n{i}").alias("n")) for i, c in enumerate(classes)])).alias("x")).select(
        "repo", F.col("x.type").alias("type"), ((F.col("x.n") + 1) / (F.col("total") + len(classes))).alias("p")
    )


def _counts(rows: DataFrame, classes: list[str]) -> DataFrame:
    """rows with _t0, _t1, ...: 1 for a row of that class."""
    return rows.withColumns({f"_t{i}": F.coalesce((F.col("type") == c).cast("bigint"), F.lit(0).cast("bigint")) for i, c in enumerate(classes)})


def with_prior(commits: DataFrame, classes: list[str], window: int = fixed.WINDOW, wide: bool = False) -> DataFrame:
    """Adds size (commits before, within the window) and prior, an array over classes: (n + 1) / (size + C).

    pos numbers a repo's commits without gaps. Counts are running sums less those of `window` commits ago: one addition a row, whatever the window.
    wide: all tasks share a large repo.
    """
    if wide:
        found = scan.windowed(_counts(commits, classes), ["repo"], "pos", {f"_m{i}": f"_t{i}" for i in range(len(classes))}, window, True)
        sized = commits.join(found, ["repo", "pos"]).withColumn("size", F.least(F.col("pos") - 1, F.lit(window)).cast("bigint"))
        return sized.select(*commits.columns, "size", F.array(*[(F.col(f"_m{i}") + 1) / (F.col("size") + len(classes)) for i in range(len(classes))]).alias("prior"))
    order = Window.partitionBy("repo").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    running = {f"_n{i}": F.coalesce(F.sum((F.col("type") == c).cast("bigint")).over(so_far), F.lit(0)) for i, c in enumerate(classes)}
    summed = commits.withColumns(running).withColumns({f"_m{i}": F.col(f"_n{i}") - F.coalesce(F.lag(f"_n{i}", window).over(order), F.lit(0)) for i in range(len(classes))})
    sized = summed.withColumn("size", F.least(F.row_number().over(order) - 1, F.lit(window)).cast("bigint"))
    return sized.select(*commits.columns, "size", F.array(*[(F.col(f"_m{i}") + 1) / (F.col("size") + len(classes)) for i in range(len(classes))]).alias("prior"))


def argmax(values: str | Column) -> Column:
    """0-based; ties go to the lowest index."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ranked(values: str | Column, classes: list[str]) -> Column:
    """array<struct<p, type>> from the most likely on; ties in the order of classes."""
    pairs = F.arrays_zip(F.col(values).alias("p") if isinstance(values, str) else values.alias("p"), F.array(*[F.lit(-i) for i in range(len(classes))]).alias("back"))
    names = F.array(*[F.lit(c) for c in classes])
    return F.transform(F.reverse(F.array_sort(pairs)), lambda x: F.struct(x["p"].alias("p"), F.element_at(names, 1 - x["back"]).alias("type")))


def file_evidence(commits: DataFrame, touched: DataFrame, classes: list[str], window: int = fixed.WINDOW, smooth: float = fixed.FILE_SMOOTH, wide: bool = False) -> DataFrame:
    """(repo, pos, seen, file): with_files() without the commits' other columns."""
    return with_files(commits, touched, classes, window, smooth, wide).select("repo", "pos", "seen", "file")


def with_files(commits: DataFrame, touched: DataFrame, classes: list[str], window: int = fixed.WINDOW, smooth: float = fixed.FILE_SMOOTH, wide: bool = False) -> DataFrame:
    """Adds seen and file: how the types of earlier commits spread over the files that a commit touches.

    commits: with prior. touched: (repo, pos, path, type), a row a path. For each path that was seen, the shares of its types are
    taken; their mean is smoothed. Without such a path it is the prior. The frame is a range over pos: it holds
    the last `window` commits, not touches, and none of the commit's own. Counts are differences of running sums by path. wide: all tasks share a large path.
    """
    per_path = scan.windowed(_counts(touched, classes), ["repo", "path"], "pos", {f"n{i}": f"_t{i}" for i in range(len(classes))}, window, wide)
    counts = [F.col(f"n{i}") for i in range(len(classes))]
    total = sum(counts[1:], counts[0])
    shares = per_path.where(total > 0).groupBy("repo", "pos").agg(F.array(*[F.avg(n / total) for n in counts]).alias("mean"))
    joined = commits.join(shares, ["repo", "pos"], "left")
    return joined.select(*[joined[c] for c in commits.columns], F.col("mean").isNotNull().alias("seen"), F.coalesce(F.transform("mean", lambda m: (m + smooth) / (1 + smooth * len(classes))), F.col("prior")).alias("file"))


def confusion(guessed: DataFrame, classes: list[str], diagonal: float = fixed.CONF_DIAGONAL, smooth: float = fixed.CONF_SMOOTH) -> DataFrame:
    """(repo, guess, type, p): rows of the guess-to-type matrix, smoothed and normalised; guessed: (repo, guess, type)."""
    counted = guessed.groupBy("repo", "guess", "type").agg(F.count("*").alias("n"))
    classes_ = F.array(*[F.lit(c) for c in classes])
    grid = guessed.select("repo").distinct().select("repo", F.explode(classes_).alias("guess")).select("repo", "guess", F.explode(classes_).alias("type"))
    cell = F.coalesce(F.col("n"), F.lit(0)) + smooth + F.when(F.col("guess") == F.col("type"), diagonal).otherwise(0.0)
    cells = grid.join(counted, ["repo", "guess", "type"], "left").withColumn("cell", cell)
    return cells.select("repo", "guess", "type", (F.col("cell") / F.sum("cell").over(Window.partitionBy("repo", "guess"))).alias("p"))


def corrected(scored: DataFrame, matrix: DataFrame) -> DataFrame:
    """(repo, commit_id, type, p): a commit's class probabilities (repo, commit_id, guess, p) through the repo's matrix."""
    m = matrix.withColumnRenamed("p", "m")
    return scored.join(m, ["repo", "guess"]).groupBy("repo", "commit_id", "type").agg(F.sum(F.col("p") * F.col("m")).alias("p"))


def corrected_arrays(guessed: DataFrame, classes: list[str], diagonal: float = fixed.CONF_DIAGONAL, smooth: float = fixed.CONF_SMOOTH) -> DataFrame:
    """guessed (repo, guess, type, p array over classes, ...) with conf: p through the repo's confusion() as in corrected(), an array.

    A repo's matrix is one row of counts, so rows stay as many as they are, and rows that are dealt by repo stay where they are.
    """
    size = range(len(classes))
    cells = [F.count_if((F.col("guess") == g) & (F.col("type") == t)) for g in classes for t in classes]
    matrix = guessed.groupBy("repo").agg(F.array(*cells).alias("_n"))
    cell = lambda g, t: F.get("_n", F.lit(g * len(classes) + t)) + F.lit(smooth + (diagonal if g == t else 0.0))
    held = matrix.select("repo", F.array(*[F.array(*[cell(g, t) / sum((cell(g, x) for x in size), F.lit(0.0)) for t in size]) for g in size]).alias("_m"))
    through = F.array(*[sum((F.get("p", F.lit(g)) * F.get(F.get("_m", F.lit(g)), F.lit(t)) for g in size), F.lit(0.0)) for t in size])
    return guessed.join(held, "repo").withColumn("conf", through).drop("_m")


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Commits that the index lacks."""
    return wanted.join(cache, ["repo", "sha"], "left_anti")


def newest(entries: DataFrame, window: int = fixed.WINDOW) -> DataFrame:
    """The `window` newest entries of each repo, ties by sha."""
    age = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("ts").desc(), F.col("sha")))
    return entries.withColumn("_age", age).where(F.col("_age") <= window).drop("_age")


def wanted(log: DataFrame, known: list[str] = fixed.CLASSES, skip: int = 0, window: int = fixed.WINDOW) -> DataFrame:
    """(repo, sha, ts, type): what an index of each repo should hold. log: (repo, sha, ts, subject), and merge if the log tells.

    Merges don't count. Without its `skip` newest commits, the next 2 * window of a repo are looked at, and of those with a type in their subject the newest `window` taken.
    """
    plain = log.where(~F.coalesce("merge", F.lit(False))) if "merge" in log.columns else log
    age = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("ts").desc(), F.col("sha")))
    seen = plain.withColumn("_age", age).where((F.col("_age") > skip) & (F.col("_age") <= skip + 2 * window))
    typed = seen.select("repo", "sha", "ts", headers.header(F.trim("subject"), known)["type"].alias("type")).where("type is not null")
    return newest(typed, window)


def refreshed(wanted: DataFrame, cache: DataFrame, fresh: DataFrame, window: int = fixed.WINDOW) -> DataFrame:
    """The index after a refresh: of the newest `window` wanted commits a repo those that cache or fresh has, with the wanted ts and type. What has no entry leaves a gap."""
    entries = cache.unionByName(fresh).dropDuplicates(["repo", "sha"]).drop("ts", "type")
    return newest(wanted.select("repo", "sha", "ts", "type"), window).join(entries, ["repo", "sha"])


def adapted_prior(p: Column, repo: Column, train: Column, power: float = fixed.PRIOR_POWER) -> Column:
    """p times (repo share / training share) ** power, normalised; arrays over classes."""
    shares = F.zip_with(repo, train, lambda r, t: F.pow(r / F.when(t > 0, t).otherwise(1e-4), F.lit(power)))
    raw = F.zip_with(p, shares, lambda a, b: a * b)
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))


def meta_features(p: Column, knn: Column, conf: Column, file: Column, seen: Column, size: Column, similarity: Column) -> Column:
    """4 C + 3 numbers: logs of the four distributions, whether a file was seen, the history's size, the best similarity."""
    logs = F.flatten(F.array(*[F.transform(x, lambda v: F.log(v + fixed.META_EPSILON)) for x in (p, knn, conf, file)]))
    return F.concat(logs, F.array(seen.cast("double"), F.log1p(size) / 8.0, similarity.cast("double")))
