from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwood.functions import fixed, headers, paths, text


def evaluate(spark, values, f, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i bigint, {schema}")
    return [r.y for r in sorted(df.select("i", f(F.col("x")).alias("y")).collect(), key=lambda r: r.i)]


def plain_tokens(line: str) -> list[str]:
    """One pass over bytes: a part ends at marks, at lower-upper, before the last capital of a run, between letters and digits."""
    out, part = [], b""
    data = line.encode()

    def kind(c):
        return "u" if 65 <= c <= 90 else "l" if 97 <= c <= 122 else "d" if 48 <= c <= 57 else "x" if c >= 128 else ""

    def flush():
        nonlocal part
        if part and len(out) < fixed.MAX_TOKENS:
            if part.isdigit():
                out.append("0")
            elif 2 <= len(part) <= 24:
                out.append(part.decode(errors="replace").lower())
        part = b""

    for i, c in enumerate(data):
        k, before = kind(c), kind(data[i - 1]) if i else ""
        after = kind(data[i + 1]) if i + 1 < len(data) else ""
        if not k:
            flush()
            continue
        if part and (k == "u" and before == "l" or k == "u" and before == "u" and after == "l" or (k == "d") != (before == "d")):
            flush()
        part += bytes([c])
    flush()
    return out


def test_tokens(spark):
    r = random.Random(2)
    lines = ["getHTTPResponse2xx(user_id)", "a b cc", "", "x" * 25, "éÀb ß12", "HTTPServer", "__init__", "fooBar9Baz"] + ["".join(r.choice("abXYZ09_ é(") for _ in range(r.randrange(60))) for _ in range(400)]
    lines.append(" ".join(["ab"] * 50))
    assert evaluate(spark, lines, text.tokens) == [plain_tokens(x) for x in lines]


def test_tokens_of_a_batch():
    r = random.Random(5)
    lines = ["getHTTPResponse2xx(user_id)", "", "x" * 25, "éÀb ß12", " ", "ab", "Cd", "7", "HTTPServer", "ΟΔΟΣ İx", "1" * 30, " ".join(["ab"] * 50)] + ["".join(r.choice("abXYZ09_ é(") for _ in range(r.randrange(60))) for _ in range(500)] + [""]
    for some in (lines, lines[3:9], [""], []):
        row, code, names = text.split_tokens(pa.array(lines, pa.string()).slice(3, 6) if len(some) == 6 else pa.array(some, pa.string()))
        found = [[] for _ in some]
        for k, c in zip(row, code, strict=True):
            found[k].append(names[int(c)].as_py())
        assert found == [plain_tokens(x) for x in some]


def test_bucket(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h & ((1 << 20) - 1)

    names = ["", "a:foo", "é", "中文", "x" * 300]
    assert evaluate(spark, names, text.bucket) == [fnv(n) for n in names]


@pytest.mark.parametrize(
    ("line", "shape"),
    [("", "<empty>"), ("// note", "<comment>"), ("# note", "<comment>"), ("#include <x>", "#include"), ("#!bin", "#"), ("return x", "return"), ("  ", "<empty>"), ("}", "<close>"), ("({", "<open>"), ("<div>", "<tag>"),
     ("'a'", "<string>"), (".x", "<dot>"), ("+ 1", "<punct>"), ("42", "<num>"), ("é", "<other>"), ("--- a", "<punct>"), ("-- sql", "<comment>"), ("@Override", "@override"), ("abcdefghijklmnopqrst", "abcdefghijklmnop"), ('"""doc', "<comment>")],
)
def test_shapes(spark, line, shape):
    assert evaluate(spark, [line], lambda c: text.shape(text.trim(c))) == [shape]


def test_line_predicates(spark):
    imports = ["import os", "from a import b", "from a get b", "const x = require('y')", "use std::io", "export { a } from 'b'", "export const a", "package main", "important"]
    assert evaluate(spark, imports, text.is_import) == [True, True, False, True, True, True, False, True, False]
    assert evaluate(spark, ["it('works')", "require.Equal(t, 1)", "require.Equal(x)", "plain"], text.has_test_word) == [True, True, False, False]
    assert evaluate(spark, ["raise x", "if err != nil", "x"], text.has_null_word) == [False, True, False]
    assert evaluate(spark, ["", "}", "});", "ab"], text.is_trivial) == [True, True, False, False]


CASES = {
    ".github/workflows/ci.yml": "ci", ".github/dependabot.yml": "ci", "Jenkinsfile": "ci", "version.txt": "version", "CHANGELOG.md": "changelog", "changes/12.md": "changelog", "LICENSE": "license", "go.sum": "lock", "sub/yarn.lock": "lock",
    "vendor/x/y.go": "generated", "api/x.pb.go": "generated", "a/app.min.js": "generated", "mocks/a.go": "generated", "__snapshots__/a.snap": "snapshot", "out.golden": "snapshot", "pkg/a_test.go": "test", "src/a.spec.ts": "test", "tests/helper.py": "test",
    "src/FooTest.java": "test", "src/latest.go": "source", "test_a.py": "test", "conftest.py": "test", "docs/a.md": "docs", "README": "docs", "notes.txt": "docs", "examples/a.py": "docs", "locales/en.json": "i18n", "a/messages.po": "i18n",
    "package.json": "build", "Dockerfile": "build", "deploy/x.yaml": "build", "requirements-dev.txt": "docs", ".eslintrc.json": "config", ".gitignore": "config", ".vscode/settings.json": "config", "src/a.scss": "style", "img/logo.png": "asset",
    "assets/data.xyz": "asset", "assets/app.js": "source", "db/migrate/1_a.rb": "schema", "a.proto": "schema", "schema/a.json": "schema", "schema/a.py": "source", "run.sh": "script", "scripts/a.xyz": "script", "scripts/a.py": "script", "views/a.html": "template",
    "templates/a": "template", "a/b.yaml": "data", "main.go": "source", "": "source",
}


def test_categories(spark):
    found = dict(zip(CASES, evaluate(spark, list(CASES), paths.category), strict=True))
    assert found == CASES


def test_extension_and_language(spark):
    names = ["a/b.test.TS", ".gitignore", "Makefile", "a.", "x.abcdefghijklmn", "d.ts/x", "a.rs"]
    assert evaluate(spark, names, paths.extension) == ["ts", "", "", "", "", "", "rs"]
    assert evaluate(spark, ["ts", "", "zzz", "kt", "tf"], paths.language) == ["ts", "none", "unknown", "jvm", "config"]


def test_scope_candidates(spark):
    names = ["packages/core-ui/a.ts", "packages/@acme/b.ts", "src/auth/login.py", "main.go", "docs/a.md", "billing/x.go", "src/main/java/x.java", "internal/.hidden/x"]
    found = [(r["scope"], r["strong"]) for r in evaluate(spark, names, paths.scope_candidate)]
    assert found == [("core-ui", True), ("acme", True), ("auth", False), (None, False), (None, False), ("billing", False), (None, False), (None, False)]


def test_headers(spark):
    subjects = ["feat(ui)!: x", "Fix: y", "tests: z", "nope: x", "feat:", "feat:x", "✨ (auth): add", ":bug: fix it", "⬆️ deps", "⬆ deps", ":unknown: x", "plain", "🧑‍💻 tools", "🚧 wip"]
    found = [(r["type"], r["scope"]) if r else None for r in evaluate(spark, subjects, headers.header)]
    assert found == [("feat", "ui"), ("fix", ""), ("test", ""), None, ("feat", ""), None, ("feat", "auth"), ("fix", ""), ("build", ""), ("build", ""), None, None, ("chore", ""), None]
    e = evaluate(spark, ["✨ (auth): add login", ":bug:  crash", "🧑‍💻x", "x"], headers.emoji_header)
    assert [(r["code"], r["scope"], r["message"]) if r else None for r in e] == [("sparkles", "auth", "add login"), ("bug", "", "crash"), ("technologist", "", "x"), None]


def test_corpus_subjects_and_bots(spark):
    found = evaluate(spark, ["perfs(x)!: go", "feat: ", "ENH: add", "MAINT(io): fix", "XYZ: no", "feat(a): b"], headers.corpus_subject)
    assert [(r["type"], r["scope"], r["breaking"], r["convention"]) if r else None for r in found] == [("perf", "x", True, "cc"), None, ("feat", "", False, "scipy"), ("chore", "", False, "scipy"), None, ("feat", "a", False, "cc")]
    assert evaluate(spark, ["renovate[bot]", "Ann <a@b>"], headers.is_bot) == [True, False]


@pytest.mark.parametrize(("a", "b", "way"), [("1.2.0", "1.3.0", 1), ("v2", "v1.9", -1), ("1.2", "1.2.1", 1), ("2.0.0-rc.1", "2.0.0", 1), ("2.0.0", "2.0.0-rc.1", -1), ("x", "1", 0), ("1.0", "1.0", 0), ("^1.10.0", "^1.9.0", -1), ("1.0-a", "1.0-b", 1)])
def test_versions(spark, a, b, way):
    assert spark.range(1).select(headers.compare_versions(F.lit(a), F.lit(b)).alias("y")).first().y == way


def test_formats(spark):
    row = spark.range(1).select(headers.format_header(F.lit("feat"), F.lit("ui"), F.lit(True), F.lit("x")).alias("a"), headers.format_emoji(F.lit("✨"), F.lit(""), F.lit("add")).alias("b"), headers.first_content_line(F.lit("# c\n\nhello\nx")).alias("c")).first()
    assert tuple(row) == ("feat(ui)!: x", "✨ add", "hello")


def test_rule_patterns_are_portable():
    """No look-around or back-references: the other engine's expressions lack them."""
    for _, always, unless in paths.RULES:
        assert not any(re.search(r"\(\?[=!<]|\\[1-9]", p) for p in always + unless)


def test_trim_of_lines_with_and_without_white_space(spark):
    lines = ["", "a", " a", "a ", "\ta b\u00a0", "\u2003x\u3000", "é", "é ", "a\u0085", "\x1fa", "~ !", None, "   "]
    plain = spark.createDataFrame([(x,) for x in lines], "x string").select(F.regexp_replace("x", r"(?U)^\s+|\s+$", "")).collect()
    assert evaluate(spark, lines, text.trim) == [r[0] for r in plain]


def test_words_are_found_by_their_bytes(spark):
    lines = [f"x{w}y" for w in (*fixed.TEST_WORDS, *fixed.ERROR_WORDS, *fixed.NULL_WORDS)] + ["", "a.b", "require.x(t,", "é"]
    for f, words in ((text.has_test_word, fixed.TEST_WORDS), (text.has_error_word, fixed.ERROR_WORDS), (text.has_null_word, fixed.NULL_WORDS)):
        also = lambda x: f is text.has_test_word and "require." in x and "(t," in x  # noqa: E731, B023
        assert evaluate(spark, lines, f) == [any(w in x for w in words) or also(x) for x in lines]
    assert "RLIKE" not in str(text.has_log_word(F.col("x"))).upper()
