import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from driftwood.operators import classify, history
from driftwood.streaming import replay

CLASSES = ["fix", "docs", "feat"]
SCHEMA = "repo string, sha string, ts bigint, type string, p array<double>, paths array<string>"


@pytest.fixture(scope="module")
def rocks(spark):
    session = spark.newSession()
    session.conf.set(replay.STATE_STORE, replay.ROCKS)
    return session


def history_of(n: int, repos: str = "rq") -> list[tuple]:
    draw = random.Random(7)
    rows = []
    for k in range(n):
        p = [draw.random() + 0.01 for _ in CLASSES]
        paths = [f"f{draw.randrange(6)}" for _ in range(draw.randrange(5))]
        rows.append((draw.choice(repos), f"s{k:04}", k // 3, draw.choice([*CLASSES, None, "odd"]), [x / sum(p) for x in p], paths))
    return rows


def told_at_once(spark, rows, window):
    commits = history.numbered(spark.createDataFrame(rows, SCHEMA), ["ts", "sha"])
    own = history.with_prior(commits, CLASSES, window)
    touched = commits.select("repo", "pos", F.explode("paths").alias("path"), "type").distinct()
    found = own.join(classify.earlier_confusion(own, CLASSES, window), ["repo", "pos"]).join(history.file_evidence(own, touched, CLASSES, window), ["repo", "pos"])
    return {r.sha: r for r in found.collect()}


def run(rocks, folder, parts, window, idle=None, at="cp"):
    found = []
    for part in parts:
        rocks.createDataFrame(part[::-1], SCHEMA).coalesce(1).write.mode("append").json(str(folder / "in"))
        stream = replay.replayed(rocks.readStream.schema(SCHEMA).json(str(folder / "in")), CLASSES, window, idle)
        stream.writeStream.foreachBatch(lambda batch, _: found.extend(batch.collect())).option("checkpointLocation", str(folder / at)).trigger(availableNow=True).start().awaitTermination(60)
    return found


def test_stream_equals_windows(spark, rocks, tmp_path):
    rows, window = history_of(120), 9
    found = run(rocks, tmp_path, (rows[:30], rows[30:33], rows[33:]), window)
    want = told_at_once(spark, rows, window)
    assert len(found) == len(rows) == len({r.sha for r in found})
    for r in found:
        w = want[r.sha]
        assert (r.size, r.seen) == (w.size, w.seen)
        for name in ("prior", "conf", "file"):
            assert r[name] == pytest.approx(w[name]), (r.sha, name)


def test_table_equals_windows(spark, rocks):
    rows = history_of(60, "r")
    want = told_at_once(spark, rows, 1000)
    found = replay.replayed(rocks.createDataFrame(rows, SCHEMA), CLASSES).collect()
    assert len(found) == 60 and all(r.file == pytest.approx(want[r.sha].file) and r.conf == pytest.approx(want[r.sha].conf) for r in found)


def test_odd_rows(rocks):
    rows = [(None, "a", 1, "fix", None, None), (None, "b", 2, "fix", [0.2, 0.5, 0.3], ["x", None, "x"]), (None, "b", 2, "fix", [0.2, 0.5, 0.3], []), (None, "c", None, None, [1.0, 0.0, 0.0], ["x"] + [f"y{k}" for k in range(500)])]
    found = sorted(replay.replayed(rocks.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(9)), CLASSES).collect(), key=lambda r: r.size)
    assert [r.size for r in found] == [0, 1, 2, 3] and found[0].conf is None and sum(found[1].conf) == pytest.approx(1)
    assert found[3].seen and found[3].file[0] > 0.8 and not found[1].seen
    assert not replay.replayed(rocks.createDataFrame([], SCHEMA), CLASSES).count()


def test_idle_repos_are_dropped(rocks, tmp_path):
    rows = history_of(12, "r")
    other = [("q", "t0", 9, "fix", [0.5, 0.25, 0.25], ["f1"])]
    rocks.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        found = {r.sha: r for r in run(rocks, tmp_path, (rows[:8], other, rows[8:]), 100, idle=1)}
    finally:
        rocks.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert [found[f"s{k:04}"].size for k in (0, 7, 8, 11)] == [0, 7, 0, 3] and found["t0"].size == 0
    assert found["s0008"].prior == pytest.approx([1 / 3] * 3) and not found["s0008"].seen


def test_other_state_store_is_refused(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        replay.replayed(spark.createDataFrame([], SCHEMA), CLASSES)


class Calls:
    """A state without a store: a value, or a map that counts what is asked of it."""

    def __init__(self):
        self.value, self.map, self.n = None, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        self.n += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.n += 1
        self.map[key] = value

    def containsKey(self, key):
        self.n += 1
        return key in self.map

    def removeKey(self, key):
        self.n += 1
        del self.map[key]


@pytest.mark.parametrize("window", [70, 1000])
def test_state_of_many_paths_takes_few_calls(window):
    commit = Row("sha", "ts", "type", "p", "paths")
    commits = [commit(f"s{k:04}", k, CLASSES[k * k % 3], [0.2, 0.5, 0.3], [f"d{k * 7 % 401}", f"e{k}"]) for k in range(600)]

    def told(size):
        repo = replay._Repo(CLASSES, window, None)
        repo.sums, repo.ring, repo.paths = Calls(), Calls(), Calls()
        found = [r for low in range(0, 600, size) for r in repo.handleInputRows(("r",), iter(commits[low : low + size]), None)]
        return found, repo

    (whole, one), (parts, several) = told(600), told(50)
    assert one.ring.n + one.paths.n <= 60
    assert [r.sha for r in whole] == [r.sha for r in parts] == [r.sha for r in commits]
    for a, b in zip(whole, parts, strict=True):
        assert (a.size, a.seen) == (b.size, b.seen) and a.prior == pytest.approx(b.prior) and a.conf == pytest.approx(b.conf) and a.file == pytest.approx(b.file)
    held = {name for names, _ in several.paths.map.values() for name in names}
    assert held == {f for r in commits[-window:] for f in r.paths} and several.sums.value[4] == len(held)
    assert sum(r.seen for r in whole) == sum(window >= 401 and k >= 401 for k in range(600))
