"""What a file's path says: base name, extension, category, language. All are Column -> Column.

The rules of each category are word lists; each list is one alternation of a regular expression over the lower-cased path,
so that classifying a path is a CASE of at most two matches a category. The expressions use no syntax that RE2 lacks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwood.functions import fixed


def _any(words: str | list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\-", "-").replace("/", "/") for w in (words.split() if isinstance(words, str) else words))


def at(words: str) -> str:
    """The path starts so."""
    return f"^(?:{_any(words)})"


def base(words: str) -> str:
    """The whole base name."""
    return f"(?:^|/)(?:{_any(words)})$"


def begins(words: str) -> str:
    return f"(?:^|/)(?:{_any(words)})[^/]*$"


def ends(words: str) -> str:
    return f"(?:^|/)[^/]*(?:{_any(words)})$"


def ext(words: str | list[str]) -> str:
    return rf"(?:^|/)[^/]+\.(?:{_any(words)})$"


def dirs(words: str) -> str:
    """One of the directories; words of several segments may also start the path with their last one unfinished."""
    several = [w for w in words.split() if "/" in w]
    return f"(?:^|/)(?:{_any(words)})/" + (f"|^(?:{_any(several)})[^/]*/" if several else "")


def name(pattern: str, extensions: str = "") -> str:
    """A pattern of the part of the base name before its first dot (after the first byte), with one of the extensions."""
    return rf"(?:^|/)(?:{pattern})" + (rf"(?:\.(?:[^/]*\.)?(?:{_any(extensions)}))$" if extensions else r"(?:\.[^/]*)?$")


CODE = ext(fixed.CODE_EXT)
TEST = [
    dirs(fixed.TEST_DIRS),
    name(r"[^/.][^/.]*[_-](?:test|spec)|\.[^/.]*[_-](?:test|spec)|[_-](?:test|spec)"),
    r"(?:^|/)[^/]*(?:\.(?:test|spec|e2e|e2e-spec|integration|bench|cy|test-d|spec-d|stories)|_(?:test|spec))(?:\.[^/.]{1,12})?$",
    r"(?:^|/)(?:test_|test-|spec_)[^/]*$",
    name(r"[^/.]*test", "java kt cs scala php swift groovy dart exs"),
    name(r"[^/.]*tests", "java kt cs scala php swift cpp cc py rs"),
    name(r"[^/.]*spec", "rb js ts php scala exs"),
    name(r"[^/.]*testcase"),
    base(fixed.TEST_FILES),
    r"(?:^|/)[^/]*\.(?:test|spec)\.[^/]*$",
]
#: Category -> (patterns, patterns that count unless the extension is code's). The first category that matches wins.
RULES: list[tuple[str, list[str], list[str]]] = [
    ("ci", [at(fixed.CI_AT), base(fixed.CI_FILES), r"^\.github/(?:.*/)?[^/]+\.(?:yml|yaml)$"], []),
    ("version", [base(fixed.VERSION_FILES)], []),
    ("changelog", [base(fixed.CHANGELOG_FILES), at(fixed.CHANGELOG_AT), r"/changelog\.|/upcoming_changes/|/whatsnew/"], []),
    ("license", [base(fixed.LICENSE_FILES), at("licenses/ license/")], []),
    ("lock", [base(fixed.LOCK_FILES)], []),
    ("generated", [dirs(fixed.GENERATED_DIRS), ends(fixed.GENERATED_ENDS), begins("zz_generated"), r"\.generated\.[^/]*$", r"(?:^|/)mocks/(?:.*/)?[^/]+\.go$"], []),
    ("snapshot", [dirs(fixed.SNAPSHOT_DIRS), ext(fixed.SNAPSHOT_EXT), r"\.snap\.[^/]*$", ends(".golden")], []),
    ("test", TEST, []),
    ("docs", [dirs(fixed.DOC_DIRS), ext(fixed.DOC_EXT), begins("readme"), base(fixed.DOC_FILES), at(fixed.DOC_AT)], []),
    ("i18n", [dirs(fixed.I18N_DIRS), ext(fixed.I18N_EXT), base(fixed.I18N_FILES)], []),
    (
        "build",
        [base(fixed.BUILD_FILES + " " + fixed.BUILD_MORE), begins(fixed.BUILD_BEGINS), ends(fixed.BUILD_ENDS), ext(fixed.BUILD_EXT), r"(?:^|/)requirements[^/]*\.txt$", dirs(fixed.BUILD_DIRS), at("fastlane/"),
         r"(?:^|/)(?:chrome|extension)/(?:.*/)?manifest\.json$", r"rpm.*[^/]\.spec$", r"[^/]rpm[^/]*\.spec$", r"(?:^|/)sam/(?:.*/)?template\.yaml$"],
        [],
    ),
    ("config", [base(fixed.CONFIG_FILES + " " + fixed.CONFIG_MORE), dirs(fixed.CONFIG_DIRS), begins(fixed.CONFIG_BEGINS), r"(?:^|/)\.[^/]*ignore$"], []),
    ("style", [ext(fixed.STYLE_EXT)], []),
    ("asset", [ext(fixed.ASSET_EXT)], [dirs(fixed.ASSET_DIRS)]),
    ("schema", [ext(fixed.SCHEMA_EXT), dirs(fixed.MIGRATION_DIRS), ends(".graphqls"), base(fixed.SCHEMA_FILES)], [dirs(fixed.SCHEMA_DIRS)]),
    ("script", [ext(fixed.SCRIPT_EXT)], [dirs(fixed.SCRIPT_DIRS)]),
    ("template", [ext(fixed.TEMPLATE_EXT), ends(".blade.php .html.erb .html.twig"), rf"(?:^|/)(?:{_any(fixed.TEMPLATE_DIRS)})/(?:.*/)?(?:[^/]+\.xml|[^/.]+|\.[^/.]+|[^/]+\.)$"], []),
    ("data", [], [ext(fixed.DATA_EXT)]),
    ("script", [dirs(fixed.SCRIPT_LAST_DIRS)], []),
]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory(path: Column) -> Column:
    """All before the last slash; empty for a file at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty for none, for a leading dot alone and beyond 12 bytes."""
    found = F.regexp_extract(F.lower(path), r"(?:^|/)[^/]+\.([^./]+)$", 1)
    return F.when(F.octet_length(found) <= 12, found).otherwise("")


def is_code(path: Column) -> Column:
    return F.lower(path).rlike(CODE)


def category(path: Column) -> Column:
    """One of fixed.CATEGORIES; an empty path is source."""
    low = F.lower(path)
    out = F.when(low.isin("", "."), "source")
    for label, always, unless_code in RULES:
        match = low.rlike("|".join(always)) if always else F.lit(False)
        if unless_code:
            match = match | (low.rlike("|".join(unless_code)) & ~low.rlike(CODE))
        out = out.when(match, label)
    return out.otherwise("source")


def language(extension_: Column) -> Column:
    """The family of an extension; `none` without one, `unknown` for others."""
    out = F.when(extension_ == "", "none")
    for family, words in fixed.LANGUAGES.items():
        out = out.when(extension_.isin(*words.split()), family)
    return out.otherwise("unknown")


def scope_candidate(path: Column) -> Column:
    """struct(scope, strong): the child of a container directory, else the first directory that says something; nulls for none."""
    segments = F.split(F.lower(directory(path)), "/")
    skipped = lambda s: s.isin(*fixed.SCOPE_SKIPPED, "") | s.startswith(".")
    pairs = F.when(F.size(segments) > 1, F.transform(F.sequence(F.lit(1), F.size(segments) - 1), lambda i: F.struct(F.element_at(segments, i).alias("of"), F.element_at(segments, i + 1).alias("name"))))
    held = F.get(F.filter(pairs, lambda p: p["of"].isin(*fixed.SCOPE_CONTAINERS) & ~skipped(p["name"])), F.lit(0))
    first = F.get(F.filter(segments, lambda s: ~skipped(s)), F.lit(0))
    return F.struct(
        F.coalesce(F.regexp_replace(held["name"], "^@", ""), first).alias("scope"),
        F.coalesce(held["of"].isNotNull() & ~held["of"].isin(*fixed.SCOPE_WEAK), F.lit(False)).alias("strong"),
    )


def is_license(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*fixed.LICENSE_NAMES) | F.lower(path).rlike("^licen[s]es?/")


def is_contributors(path: Column) -> Column:
    return F.lower(base_name(path)).isin(*fixed.CONTRIBUTOR_NAMES)


def is_bot_config(path: Column) -> Column:
    return F.lower(path).rlike(r"(?:^|/)(?:dependabot\.ya?ml|renovate\.json5?|\.renovaterc[^/]*)$")


def is_types(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:d\.ts|d\.mts|d\.cts|pyi|flow)$|(?:^|/)@?types/")


def is_database(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:sql|prisma)$|migration|db/migrate/|alembic/versions/|/seeds/|/seeders/")


def is_mock(path: Column) -> Column:
    return F.lower(path).rlike(r"__mocks__/|/mocks/|(?:mock|stub|fake)[^/]*$")
