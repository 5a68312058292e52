"""A history replayed as it comes: each commit's prior, confusion and file evidence from a state by repo.

The same rows as the windows of operators.history and operators.classify give for a whole history, but a commit costs its own paths and
the one commit that leaves the window, and what lies in an entry of the state with these, whatever lies before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftwood.functions import fixed

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "repo string, sha string, size bigint, prior array<double>, conf array<double>, file array<double>, seen boolean"
OUT_ROW = Row("repo", "sha", "size", "prior", "conf", "file", "seen")


#: Commits that an entry of the ring holds, about as many paths as an entry of the map of paths, and commits that are worked out at once.
BLOCK, PAGE, STEP = 64, 64, 1000


class _Repo(StatefulProcessor):
    """State of a repo: commits so far and sums over the window; a ring of the window's commits; the types of the commits that touched a path.

    Each call of the state is an exchange with the JVM, so the ring lies in blocks of commits and the paths in pages by a hash, doubled in number as paths
    get more. A batch reads the blocks and pages of its commits once and writes them once. A path without commits in the window has no entry.
    """

    def __init__(self, classes: list[str], window: int, idle: int | None):
        self.code = {c: i for i, c in enumerate(classes)}
        self.classes, self.window, self.idle = len(classes), window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "at bigint, counts array<bigint>, cells array<bigint>, pages bigint, held bigint")
        self.ring = handle.getMapState("ring", "block bigint", "types array<int>, guesses array<int>, paths array<array<string>>")
        self.paths = handle.getMapState("paths", "page bigint", "names array<string>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self.classes
        commits = sorted(rows, key=lambda r: (r.ts is None, 0 if r.ts is None else r.ts, r.sha is None, r.sha or ""))
        at, counts, cells, pages, held = self.sums.get() or (0, [0] * n, [0] * n * n, 1, 0)
        counts, cells, old, stored = list(counts), list(cells), at, pages if at else 0
        blocks: dict[int, list[list]] = {}
        opened: dict[int, dict[str, list[int]]] = {}

        def block(k: int) -> list[list]:
            if k not in blocks:
                found = self.ring.getValue((k,)) if k * BLOCK < min(old, self.window) else None
                blocks[k] = [list(c) for c in found] if found else [[], [], []]
            return blocks[k]

        def page(k: int) -> dict[str, list[int]]:
            nonlocal held
            if k not in opened:
                found = self.paths.getValue((k,)) if k < stored else None
                opened[k] = {name: list(found[1][i * n : i * n + n]) for i, name in enumerate(found[0])} if found else {}
                held -= len(opened[k])
            return opened[k]

        def touched(path: str) -> list[int]:
            of = page(zlib.crc32(path.encode()) % pages)
            if path not in of:
                of[path] = [0] * n
            return of[path]

        def add(kind: int, guess: int, own: list[str], sign: int) -> None:
            if kind < n:
                counts[kind] += sign
                if guess >= 0:
                    cells[guess * n + kind] += sign
                for path in own:
                    touched(path)[kind] += sign

        for low in range(0, len(commits), STEP):
            some = commits[low : low + STEP]
            given = np.array([r.p is not None for r in some], bool)
            p = np.array([r.p for r in some if r.p is not None], float).reshape(-1, n)
            guesses = np.full(len(some), -1)
            guesses[given] = p.argmax(1) if len(p) else []
            size, before, matrix, by_path, owner = [], [], [], [], []
            for i, (commit, guess) in enumerate(zip(some, guesses.tolist(), strict=True)):
                own = list(dict.fromkeys(f for f in (commit.paths or [])[: fixed.MAX_PATHS] if f is not None))
                size.append(min(at, self.window))
                before += counts
                if guess >= 0:
                    matrix += cells
                for c in map(touched, own):
                    if any(c):
                        by_path += c
                        owner.append(i)
                k, slot = divmod(at % self.window, BLOCK)
                ring = block(k)
                if at >= self.window:
                    add(*(c[slot] for c in ring), -1)
                entry = (self.code.get(commit.type, n), guess, own)
                add(*entry, 1)
                for c, x in zip(ring, entry, strict=True):
                    c[slot : slot + 1] = [x]
                at += 1
            prior = (np.array(before, float).reshape(-1, n) + 1.0) / (np.array(size)[:, None] + n)
            seen = np.zeros(len(some), bool)
            file = prior.copy()
            if owner:
                shares = np.array(by_path, float).reshape(-1, n)
                own, first, several = np.unique(owner, return_index=True, return_counts=True)
                mean = np.add.reduceat(shares / shares.sum(1, keepdims=True), first) / several[:, None]
                seen[own], file[own] = True, (mean + fixed.FILE_SMOOTH) / (1 + fixed.FILE_SMOOTH * n)
            smoothed = np.array(matrix, float).reshape(-1, n, n) + fixed.CONF_SMOOTH + fixed.CONF_DIAGONAL * np.eye(n)
            told = iter(np.einsum("ij,ijk->ik", p, smoothed / smoothed.sum(2, keepdims=True)).tolist())
            for commit, *x, has, f, g in zip(some, size, prior.tolist(), given.tolist(), file.tolist(), seen.tolist(), strict=True):
                yield OUT_ROW(key[0], commit.sha, *x, next(told) if has else None, f, g)

        kept = {k: {name: c for name, c in found.items() if any(c)} for k, found in opened.items()}
        held += sum(map(len, kept.values()))
        if held > 2 * PAGE * pages:
            kept |= {k: page(k) for k in range(stored) if k not in kept}
            held = sum(map(len, kept.values()))
            pages = 1 << (held // PAGE).bit_length()
            every, kept = kept, {k: {} for k in range(pages)}
            for found in every.values():
                for name, c in found.items():
                    kept[zlib.crc32(name.encode()) % pages][name] = c
        for k, found in kept.items():
            if found:
                self.paths.updateValue((k,), (list(found), [x for c in found.values() for x in c]))
            elif k < stored and self.paths.containsKey((k,)):
                self.paths.removeKey((k,))
        for k, found in blocks.items():
            self.ring.updateValue((k,), tuple(found))
        self.sums.update((at, counts, cells, pages, held))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.sums, self.ring, self.paths):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def replayed(commits: DataFrame, classes: list[str], window: int = fixed.WINDOW, idle: int | None = None) -> DataFrame:
    """(repo, sha, size, prior, conf, file, seen) of commits (repo, sha, ts, type, p array<double>, paths array<string>), a stream or a table.

    p: the plain model's probabilities, in the order of classes. Evidence is that of classify.gather() from the `window` commits before; of paths the first
    MAX_PATHS count, each once, null ones not. A type that is no class, or null, takes a place in the window and counts for none. A null p has no conf and adds
    nothing to the confusion. Within a batch commits are taken by (ts, sha); one that comes in a later batch counts as later. Null repos are a repo.
    idle: after so many milliseconds of processing time without commits a repo's state goes, and its history begins anew; None keeps it. It goes with the next batch
    of any repo; as long as spark.sql.streaming.noDataMicroBatches.enabled is set, Spark runs batches for this without data, and a stream of what is available now doesn't end.
    A batch's rows of one repo are held by one task: bound batches at the source (maxFilesPerTrigger). State lies in RocksDB, which the session must name.
    """
    spark = commits.sparkSession
    if spark.conf.get(STATE_STORE) != ROCKS:
        raise ValueError(f"{STATE_STORE} must be {ROCKS}: states with several parts need it")
    _ = spark.streams.active  # the session's manager of streams starts the coordinator of states, which a table's run needs too
    held = commits.select("repo", "sha", "ts", "type", "p", "paths")
    return held.groupBy("repo").transformWithState(_Repo(classes, window, idle), OUT, "append", "None" if idle is None else "processingTime")
