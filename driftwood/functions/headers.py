"""Commit subjects: conventional headers and emoji headers. Column -> Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwood.functions import fixed

HEADER = r"^([A-Za-z]+)(?:\(([^)]*)\))?!?:(?:\s|$)"


def known_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _signs() -> list[tuple[str, str]]:
    """(what a subject may start with, code), the longest first: an emoji with and without its variation selector."""
    found = {}
    for sign, code, _ in fixed.EMOJI:
        for s in (sign, sign.replace(fixed.VARIATION, "")):
            found.setdefault(s, code)
    return sorted(found.items(), key=lambda x: (-len(x[0].encode()), x[0]))


SIGNS = _signs()
SIGN = "^(" + "|".join(re.escape(s) for s, _ in SIGNS) + ")"
CODES = {code: kind for _, code, kind in fixed.EMOJI}


def emoji_header(subject: Column) -> Column:
    """struct(code, kind, scope, message) of "<emoji> [(scope)][:] message", the emoji as a sign or :code:; null if there is none."""
    s = F.trim(subject)
    sign = F.regexp_extract(s, SIGN, 1)
    short = F.regexp_extract(s, "^:([^:]*):", 1)
    code = F.when(short.isin(*CODES), short).when(sign != "", F.element_at(known_map(dict(SIGNS)), F.when(sign != "", sign).otherwise(SIGNS[0][0])))
    rest = F.regexp_replace(F.when(short.isin(*CODES), F.regexp_replace(s, "^:[^:]*:", "")).otherwise(F.regexp_replace(s, SIGN, "")), "^[ \t]+", "")
    scoped = rest.rlike(r"^\([^)]*\)")
    scope = F.when(scoped, F.trim(F.regexp_extract(rest, r"^\(([^)]*)\)", 1))).otherwise("")
    message = F.trim(F.regexp_replace(F.when(scoped, F.regexp_replace(rest, r"^\([^)]*\)[ \t]*", "")).otherwise(rest), "^:", ""))
    return F.when(code.isNotNull(), F.struct(code.alias("code"), F.element_at(known_map(CODES), code).alias("kind"), scope.alias("scope"), message.alias("message")))


def conventional_header(subject: Column) -> Column:
    """struct(type, scope) of `type(scope)!:`, aliases resolved; the type is lower-cased and need not be a known one."""
    raw = F.lower(F.regexp_extract(subject, HEADER, 1))
    typed = F.coalesce(F.try_element_at(known_map(fixed.TYPE_ALIASES), raw), raw)
    return F.when(raw != "", F.struct(typed.alias("type"), F.trim(F.regexp_extract(subject, HEADER, 2)).alias("scope")))


def header(subject: Column, known: list[str] = fixed.CLASSES) -> Column:
    """struct(type, scope) of either kind of header whose type is known; null otherwise."""
    e, c = emoji_header(subject), conventional_header(subject)
    found = F.when(e.isNotNull(), F.struct(e["kind"].alias("type"), e["scope"].alias("scope"))).otherwise(c)
    return F.when(found["type"].isin(*known), found)


def corpus_subject(subject: Column) -> Column:
    """struct(type, scope, breaking, convention) as training data takes it: conventional with a text, or an upper-case prefix."""
    pattern = r"^([A-Za-z]+)(?:\(([^)\n]*)\))?(!?):\s+.+$"
    raw = F.lower(F.regexp_extract(subject, pattern, 1))
    typed = F.coalesce(F.try_element_at(known_map(fixed.TYPE_ALIASES | fixed.CORPUS_ALIASES), raw), raw)
    upper = F.regexp_extract(subject, r"^([A-Z]{2,5})\s*[:(]", 1)
    return (
        F.when(typed.isin(*fixed.CLASSES), F.struct(typed.alias("type"), F.trim(F.regexp_extract(subject, pattern, 2)).alias("scope"), (F.regexp_extract(subject, pattern, 3) == "!").alias("breaking"), F.lit("cc").alias("convention")))
        .when(upper.isin(*fixed.SCIPY_PREFIXES), F.struct(F.element_at(known_map(fixed.SCIPY_PREFIXES), upper).alias("type"), F.lit("").alias("scope"), F.lit(False).alias("breaking"), F.lit("scipy").alias("convention")))
    )


def is_bot(author: Column) -> Column:
    return author.rlike(fixed.BOTS)


def is_skipped_subject(subject: Column) -> Column:
    """What a message hook leaves alone: fixups, squashes, reverts."""
    return subject.rlike(r"^(?:fixup! |squash! |amend! |Revert \"|Reapply \")")


def is_dependency_subject(subject: Column) -> Column:
    """Whether a bot's update of a dependency speaks so."""
    low = F.lower(subject)
    return low.startswith("bump ") | low.startswith("update dependency") | low.contains("renovate")


def first_content_line(message: Column, comment: str = "#") -> Column:
    """The first line that is neither blank nor a comment."""
    return F.get(F.filter(F.split(message, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith(comment)), F.lit(0))


def subject_line(message: Column, comment: str = "#") -> Column:
    """What a message hook takes as subject: the first line that is no comment, trimmed; blank if nothing was written there. Empty if all are comments."""
    lines = F.transform(F.split(message, "\n"), lambda x: F.when(~x.startswith(comment), F.trim(x)))
    return F.coalesce(F.get(F.filter(lines, lambda x: x.isNotNull()), F.lit(0)), F.when(message.isNotNull(), ""))


def has_header(subject: Column) -> Column:
    """Whether a subject already says its type, in words or by an emoji."""
    return F.coalesce(header(subject).isNotNull() | emoji_header(subject).isNotNull(), F.lit(False))


def format_header(kind: Column, scope: Column, breaking: Column, subject: Column) -> Column:
    """type(scope)!: subject; an empty scope is left out."""
    return F.concat(kind, F.when(scope != "", F.concat(F.lit("("), scope, F.lit(")"))).otherwise(""), F.when(breaking, "!").otherwise(""), F.lit(": "), subject)


def format_emoji(sign: Column, scope: Column, subject: Column) -> Column:
    return F.concat(sign, F.when(scope != "", F.concat(F.lit(" ("), scope, F.lit("):"))).otherwise(""), F.when(subject != "", F.concat(F.lit(" "), subject)).otherwise(""))


def compare_versions(a: Column, b: Column) -> Column:
    """1 if b is newer than a, -1 if older, 0 if that can't be told. Up to four numbers, then pre-releases before releases."""
    cut = r"^([^-]+)-([^ ].*)$"
    numbers = lambda v: F.transform(F.slice(F.regexp_extract_all(F.when(F.trim(v).rlike(cut), F.regexp_extract(F.trim(v), cut, 1)).otherwise(F.trim(v)), F.lit("[0-9]+"), F.lit(0)), 1, 4), lambda x: x.cast("bigint"))
    pre = lambda v: F.regexp_extract(F.trim(v), cut, 2)
    x, y, p, q = numbers(a), numbers(b), pre(a), pre(b)
    return (
        F.when((F.size(x) == 0) | (F.size(y) == 0), 0).when(y > x, 1).when(y < x, -1)
        .when((p != "") & (q == ""), 1).when((p == "") & (q != ""), -1).when(p < q, 1).when(p > q, -1).otherwise(0)
    )


def is_range(version: Column) -> Column:
    v = F.trim(version)
    return v.isin("*", "latest") | v.rlike(r"[\^~<>*x]") | v.contains(" - ") | v.contains("||")


def looks_like_version(version: Column) -> Column:
    v = F.trim(version)
    return v.rlike(fixed.VERSION_LIKE) | v.rlike(fixed.VERSION_WORDS)
