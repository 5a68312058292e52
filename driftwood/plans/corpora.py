"""Commits, files, lines and subjects derived from the given tables, since these hold no diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LABELS = [str(i) for i in range(10)]
#: {s}: the document's source, {d}: its id.
PATH_FORMS = [
    "packages/{s}/src/index{d}.ts", "packages/{s}/src/index{d}.test.ts", "docs/{s}/guide{d}.md", ".github/workflows/{s}.yml", "services/{s}/package.json", "go.sum", "cmd/{s}/main.go", "internal/{s}/store_test.go",
    "src/styles/{s}.scss", "locales/{s}.json", "assets/{s}/logo{d}.png", "__snapshots__/{s}.snap", "vendor/{s}/lib.js", "CHANGELOG.md", "LICENSE", "config/{s}.yaml", "templates/{s}.html", "scripts/{s}.sh", "db/migrate/{d}_{s}.rb",
    "version.txt", ".eslintrc.json", "Dockerfile", "README", "src/{s}/util{d}.py", "lib/{s}/Makefile.am", "apps/@{s}/api/handler.rs", "{s}.tar.gz", ".gitignore", "proto/{s}.proto", "tools/{s}/run", "src/main/java/{s}/FooTest.java", "types/{s}.d.ts",
]
STATUSES = ["modified", "added", "deleted", "renamed"]
SUBJECT_STARTS = ["", "feat: ", "fix({r}): ", "Docs: ", "✨ ", ":bug: (c{c}) ", "⬆️ (deps): ", "tests(c{c})!: ", "ENH: ", "wip "]
MANIFEST_LINES = ['  "lib{k}": "^{v}.0",', '  "version": "{v}.1",', '  "tool{k}": "{v}.2.0-rc.1",', '  "name": "x{k}",']

TXT = """txt AS (SELECT doc_id AS commit_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ln, (generate_subscripts(l, 1) - 1) % 3 <> 2 AS added, source
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"""
HTM = """htm AS (SELECT page_id AS commit_id, unnest(l) AS text, (generate_subscripts(l, 1) - 1) % 3 <> 2 AS added
  FROM (SELECT page_id, string_split(replace(html, '<', chr(10) || '<'), chr(10)) AS l FROM pages))"""


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


FIL = f"""fil AS (SELECT doc_id // 5 AS commit_id, doc_id, source AS repo,
    replace(replace({_sql_list(PATH_FORMS)}[doc_id % {len(PATH_FORMS)} + 1], '{{s}}', source), '{{d}}', doc_id::VARCHAR) AS path,
    {_sql_list(STATUSES)}[doc_id % 4 + 1] AS status, doc_id % 11 = 0 AS "binary", CASE WHEN doc_id % 7 = 0 THEN '100755' ELSE '' END AS mode,
    len(list_filter(range(n), lambda i: i % 3 <> 2)) AS added, len(list_filter(range(n), lambda i: i % 3 = 2)) AS removed
  FROM (SELECT *, len(string_split(text, chr(10))) AS n FROM documents))"""
EV = """ev AS (SELECT user_id AS repo, event_id, event_type AS type, 'k' || regexp_extract(props, '[0-9]+', 0) AS path, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)"""
SUB = f"""sub AS (SELECT conv_id, turn, role, replace(replace({_sql_list(SUBJECT_STARTS)}[(conv_id * 3 + turn) % {len(SUBJECT_STARTS)} + 1], '{{r}}', role), '{{c}}', conv_id::VARCHAR)
    || replace(text, chr(10), ' ') AS subject FROM conversations)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _form(forms: list[str], index, **values):
    out = F.element_at(F.array(*[F.lit(f) for f in forms]), index + 1)
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commits: every third line is removed, the others are added."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("commit_id"), "source", F.posexplode(F.split("text", "\n")).alias("ln", "text"))
    return lines.withColumn("added", F.col("ln") % 3 != 2)


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as commits: a line starts at each tag."""
    lines = read(spark, sf_dir, "pages").select(F.col("page_id").alias("commit_id"), F.posexplode(F.split(F.replace("html", F.lit("<"), F.lit("\n<")), "\n")).alias("ln", "text"))
    return lines.select("commit_id", "text", (F.col("ln") % 3 != 2).alias("added"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, five to a commit."""
    d = read(spark, sf_dir, "documents").withColumn("n", F.size(F.split("text", "\n")))
    removed = F.floor(F.col("n") / 3).cast("bigint")
    i = F.col("doc_id")
    return d.select(
        F.floor(i / 5).cast("bigint").alias("commit_id"), "doc_id", F.col("source").alias("repo"),
        _form(PATH_FORMS, (i % len(PATH_FORMS)).cast("int"), s=F.col("source"), d=i.cast("string")).alias("path"),
        _form(STATUSES, (i % 4).cast("int")).alias("status"), (i % 11 == 0).alias("binary"), F.when(i % 7 == 0, "100755").otherwise("").alias("mode"),
        (F.col("n") - removed).cast("bigint").alias("added"), removed.alias("removed"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits of a user, each of one type, touching one path."""
    from driftwood.operators.history import numbered

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), "event_id", "ts", F.col("event_type").alias("type"), F.concat(F.lit("k"), F.regexp_extract("props", "[0-9]+", 0)).alias("path"), "value")
    return numbered(e, ["ts", "event_id"])


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as subjects, with one of several kinds of header."""
    c = read(spark, sf_dir, "conversations")
    start = _form(SUBJECT_STARTS, ((F.col("conv_id") * 3 + F.col("turn")) % len(SUBJECT_STARTS)).cast("int"), r=F.col("role"), c=F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", "role", F.concat(start, F.replace("text", F.lit("\n"), F.lit(" "))).alias("subject"))


#: {s}: the document's source.
DOCUMENT_STARTS = ["", "feat: ", "fix({s}): ", "docs(@{s}): ", "✨ ", ":bug: ({s}) ", "ENH: ", "perf({s})!: ", "wip ", "Bump "]
DSUB = f"""dsub AS (SELECT doc_id, source, 'r' || (doc_id % 12)::VARCHAR AS repo, doc_id // 12 + 1 AS pos, replace({_sql_list(DOCUMENT_STARTS)}[CASE doc_id % 12 WHEN 0 THEN doc_id // 12 % 2 + 2 WHEN 1 THEN 1 ELSE doc_id // 12 % {len(DOCUMENT_STARTS)} END + 1], '{{s}}', CASE WHEN doc_id % 24 = 0 THEN upper(source) ELSE source END)
    || coalesce(string_split(text, chr(10))[1], '') AS subject FROM documents)"""


def document_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commits of twelve repos, their first lines as subjects: one repo always says a scope, one never, the others do by turns."""
    i = F.col("doc_id")
    turn = F.floor(i / 12).cast("bigint")
    start = F.when(i % 12 == 0, turn % 2 + 2).when(i % 12 == 1, 1).otherwise(turn % len(DOCUMENT_STARTS)).cast("int")
    said = F.concat(_form(DOCUMENT_STARTS, start, s=F.when(i % 24 == 0, F.upper("source")).otherwise(F.col("source"))), F.coalesce(F.get(F.split("text", "\n"), F.lit(0)), F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("r"), (i % 12).cast("string")).alias("repo"), (turn + 1).alias("pos"), said.alias("subject"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as unified diffs of one file each."""
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i % 3 != 2, "+").otherwise("-"), x)), "\n")
    path = F.concat(F.lit("src/"), "source", F.lit("/f "), F.col("doc_id").cast("string"), F.lit(".py"))
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 1..2 100644\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@ def f():\n"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("commit_id"), F.concat(head, body).alias("patch"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of a customer, their line items as files."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    back = F.col("l_returnflag") == "R"
    n = F.col("l_quantity").cast("bigint")
    return line.select(
        F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"), F.lit("/f"), F.col("l_partkey").cast("string"), F.lit(".go")).alias("path"),
        F.when(back, "deleted").otherwise("modified").alias("status"), F.lit(False).alias("binary"), F.lit("").alias("mode"), F.when(back, 0).otherwise(n).alias("added"), F.when(back, n).otherwise(0).alias("removed"),
    )


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as manifest lines: each part of a commit is removed in one version and added in another."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    side = p.select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    k = F.col("p_partkey")
    version = F.when(F.col("side") == 0, F.concat_ws(".", F.lit("1"), (F.col("p_size") % 4).cast("string"))).otherwise(F.concat_ws(".", F.lit("1"), (k % 4).cast("string")))
    line = _form(MANIFEST_LINES, (k % len(MANIFEST_LINES)).cast("int"), k=(k % 97).cast("string"), v=version)
    return side.where((F.col("side") == 1) | (k % 5 != 0)).select(F.floor(k / 8).cast("bigint").alias("commit_id"), (k * 2 + F.col("side")).alias("ln"), F.lit("web/package.json").alias("path"), (F.col("side") == 1).alias("added"), line.alias("text"))


#: One for each kind of message, and some that say nothing.
PHRASES = [
    "wip parser", "fix typo in guide", "hotfix for login", "fix broken build", "improve a11y of menus", "translate the menus", "add telemetry", "add feature flag", "animate the header", "responsive grid", "better seo", "check permissions",
    "validate input", "deprecate old call", "remove dead code", "new architecture", "fix lint warnings", "release 1.2.3", "add failing test", "bump things", "downgrade things", "pin things", "update docs", "say nothing",
]


def changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, lines and subjects of commits: documents as files, parts eight to a manifest, and each part as a manifest of its own."""
    i = F.col("doc_id")
    files = document_files(spark, sf_dir).select(i.alias("commit_id"), "path", "status", "added", "removed")
    path = _form(PATH_FORMS, (i % len(PATH_FORMS)).cast("int"), s=F.col("source"), d=i.cast("string"))
    docs = read(spark, sf_dir, "documents")
    lines = docs.select(i.alias("commit_id"), path.alias("path"), F.posexplode(F.split("text", "\n")).alias("ln", "text")).select("commit_id", F.col("ln").cast("bigint").alias("ln"), "path", (F.col("ln") % 3 != 2).alias("added"), "text")
    parts = manifest_lines(spark, sf_dir)
    each = F.explode(F.array(-1 - F.col("commit_id"), -1000000000 - F.floor(F.col("ln") / 2).cast("bigint"))).alias("commit_id")
    manifests = parts.select(each, "ln", "path", "added", "text")
    own = manifests.groupBy("commit_id", "path").agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("removed")).withColumn("status", F.lit("modified"))
    n = F.abs("commit_id")
    phrase = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (F.floor(n / 11) % len(PHRASES) + 1).cast("int"))
    said = docs.select(i.alias("commit_id"), F.coalesce(F.get(F.split("text", "\n"), F.lit(0)), F.lit("")).alias("more")).unionByName(own.select("commit_id", F.lit("web").alias("more")))
    return files.unionByName(own), lines.unionByName(manifests), said.select("commit_id", F.concat(phrase, F.lit(" "), "more").alias("subject"))


MAN = f"""man AS (SELECT p_partkey // 8 AS commit_id, p_partkey * 2 + side AS ln, side = 1 AS added,
    replace(replace({_sql_list(MANIFEST_LINES)}[p_partkey % {len(MANIFEST_LINES)} + 1], '{{k}}', (p_partkey % 97)::VARCHAR), '{{v}}', '1.' || (CASE WHEN side = 0 THEN p_size % 4 ELSE p_partkey % 4 END)::VARCHAR) AS text
  FROM part, (VALUES (0), (1)) s(side) WHERE side = 1 OR p_partkey % 5 <> 0)"""

CHANGES = f"""{FIL}, {TXT}, {MAN}, cl AS (SELECT t.commit_id, t.ln, f.path, t.added, t.text FROM txt t JOIN fil f ON f.doc_id = t.commit_id
    UNION ALL SELECT -1 - commit_id, ln, 'web/package.json', added, text FROM man UNION ALL SELECT -1000000000 - ln // 2, ln, 'web/package.json', added, text FROM man),
  own AS (SELECT commit_id, path, 'modified' AS status, count(*) FILTER (WHERE added) AS added, count(*) FILTER (WHERE NOT added) AS removed FROM cl WHERE commit_id < 0 GROUP BY ALL),
  cf AS (SELECT doc_id AS commit_id, path, status, added, removed FROM fil UNION ALL SELECT * FROM own),
  say AS (SELECT commit_id, {_sql_list(PHRASES)}[(abs(commit_id) // 11) % {len(PHRASES)} + 1] || ' ' || more AS subject FROM (SELECT doc_id AS commit_id, coalesce(string_split(text, chr(10))[1], '') AS more FROM documents UNION ALL SELECT commit_id, 'web' FROM own))"""
