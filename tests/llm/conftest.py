from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, bin int, stratum string, row string, held string"


def words(seed: int, n: int, pool: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(pool)}" for _ in range(n)]


def texts() -> list[str | None]:
    """Odd cases first: null, empty, blanks, marks, one word, a very long word, other scripts, copies, near copies."""
    base = " ".join(words(1, 300))
    near = base.split()
    near[150] = "changed"
    out = [None, "", "   \n\t ", "?!", "one", "two words", "x" * 70_000, "It's  a té́st İ 中文 \U0001f600 12²\n\n", "a\x1cb \x00 c", base, base, base.upper(), " ".join(near)]
    out += ["line one here\n" * 30, "\n".join(["", "same", "same", " same"]), "<|im_end|><\\|x|> <|endoftext|> don't ***"]
    out += [" ".join(words(i, 5 + 37 * i % 400)).capitalize() + "." for i in range(2, 40)]
    out += [" ".join(words(100, 20_000, 5000))]
    return out


@pytest.fixture(scope="session")
def rows():
    got = [(i, t, ["en", "de", None][i % 3], "s", 7, "clash", 1, "clash", "clash", "clash") for i, t in enumerate(texts())]
    return [*got, got[9], (None, "no id here", "en", "s", 1, "", 0, "", "", ""), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
