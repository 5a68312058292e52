"""DuckDB expressions for the oracles: the same functions, written for the other engine."""

from __future__ import annotations

from driftwood.functions import fixed, headers, paths, text


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    for cut in text.CUTS:
        x = rf"regexp_replace({x}, {quoted(cut)}, '\1 \2', 'g')"
    found = f"regexp_extract_all({x}, {quoted(text.RUN)})"
    named = f"list_transform({found}, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '0' WHEN strlen(t) BETWEEN 2 AND 24 THEN lower(t) END)"
    return f"list_filter({named}, lambda t: t IS NOT NULL)[1:{fixed.MAX_TOKENS}]"


def token_rows(corpus: str) -> str:
    """A CTE tok(commit_id, added, token) of a corpus CTE."""
    return f"tok AS (SELECT commit_id, added, unnest({tokens(trim('text'))}) AS token FROM {corpus} WHERE strlen({trim('text')}) <= {fixed.LONG_LINE})"


def bucket(x: str) -> str:
    pairs = f"regexp_extract_all(hex(encode({x})), '..')"
    return f"list_reduce(list_prepend({fixed.FNV_START}::BIGINT, list_transform({pairs}, lambda p: ('0x' || p)::BIGINT)), lambda h, b: (xor(h, b) * {fixed.FNV_STEP}) & {(1 << fixed.HASH_BITS) - 1})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


def is_comment(t: str) -> str:
    return f"((starts_with({t}, '#') AND NOT {matches(t, text.DIRECTIVES)}) OR {matches(t, text.COMMENT)})"


def shape(t: str) -> str:
    word = f"lower(regexp_extract({t}, '^[A-Za-z_@#$]+', 0))"
    first = f"substr({t}, 1, 1)"
    return f"""CASE WHEN {t} = '' THEN '<empty>' WHEN {is_comment(t)} THEN '<comment>' WHEN {word} <> '' THEN substr({word}, 1, 16)
      WHEN {first} IN {strings("})]")} THEN '<close>' WHEN {first} IN {strings("{([")} THEN '<open>' WHEN {first} = '<' THEN '<tag>' WHEN {first} IN {strings(chr(34) + chr(39) + "`")} THEN '<string>'
      WHEN {first} = '.' THEN '<dot>' WHEN {first} IN {strings("*-+|=>/" + chr(92) + ":;,?!&%^~")} THEN '<punct>' WHEN {first} BETWEEN '0' AND '9' THEN '<num>' ELSE '<other>' END"""


def any_word(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def category(path: str) -> str:
    low = f"lower({path})"
    out = f"CASE WHEN {low} IN ('', '.') THEN 'source'"
    for label, always, unless in paths.RULES:
        parts = [matches(low, p) for p in always] + [f"({matches(low, p)} AND NOT {matches(low, paths.CODE)})" for p in unless]
        out += f" WHEN {' OR '.join(parts)} THEN '{label}'"
    return out + " ELSE 'source' END"


def extension(path: str) -> str:
    e = rf"regexp_extract(lower({path}), '(?:^|/)[^/]+\.([^./]+)$', 1)"
    return f"CASE WHEN strlen({e}) <= 12 THEN {e} ELSE '' END"


def language(ext: str) -> str:
    return f"CASE WHEN {ext} = '' THEN 'none' " + " ".join(f"WHEN {ext} IN {strings(w.split())} THEN '{family}'" for family, w in fixed.LANGUAGES.items()) + " ELSE 'unknown' END"


def ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE ({top})::DOUBLE / ({bottom})::DOUBLE END"


def alias(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.TYPE_ALIASES.items()) + f" ELSE {x} END"


def emoji_parts(subject: str) -> dict[str, str]:
    """SQL for code (null if none), kind, scope and message of an emoji header."""
    s = f"trim({subject})"
    short = f"regexp_extract({s}, '^:([^:]*):', 1)"
    sign = f"regexp_extract({s}, {quoted(headers.SIGN)}, 1)"
    codes = strings(headers.CODES)
    code = f"CASE WHEN {short} IN {codes} THEN {short} ELSE CASE {sign} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in headers.SIGNS) + " END END"
    kind = f"CASE {code} " + " ".join(f"WHEN {quoted(c)} THEN {quoted(k)}" for c, k in headers.CODES.items()) + " END"
    rest = f"ltrim(CASE WHEN {short} IN {codes} THEN regexp_replace({s}, '^:[^:]*:', '') ELSE regexp_replace({s}, {quoted(headers.SIGN)}, '') END, ' ' || chr(9))"
    scope = rf"trim(regexp_extract({rest}, '^\(([^)]*)\)', 1))"
    message = rf"trim(regexp_replace(regexp_replace({rest}, '^\([^)]*\)[ \t]*', ''), '^:', ''))"
    return {"code": code, "kind": kind, "scope": scope, "message": message}
