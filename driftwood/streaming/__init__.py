"""Extensions: the history index kept up to date from a stream of commits, and each commit's prior from a state by repo (replay.py: all its evidence)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwood.functions import fixed
from driftwood.sources.index import VersionedIndex


def refresh_index(commits: DataFrame, path: str, checkpoint: str, window: int = fixed.WINDOW, features: int = 1, parts: int = 256) -> StreamingQuery:
    """commits: a stream of (repo, sha, ts, type, ...). Each batch adds what the index at `path` lacks and keeps the newest `window` a repo.

    A batch writes the parts of the repos that it touches, and one that is run again after a failure changes nothing (VersionedIndex).
    """
    schema = commits.schema

    def step(batch: DataFrame, number: int) -> None:
        VersionedIndex(batch.sparkSession, path, schema, features, parts).update(batch, window, number)

    return commits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_priors(commits: DataFrame, classes: list[str], window: int = fixed.WINDOW) -> DataFrame:
    """(repo, sha, size, prior) of a stream of (repo, sha, ts, type): each commit's smoothed shares of the types of the `window` commits before it.

    The state of a repo is the types of its last `window` commits, a byte each. Within a batch commits are taken by (ts, sha); one that
    comes in a later batch counts as later. Types that are no class, and null ones, take a place in the window and count for none. Null repos are a repo.
    """
    code = {c: i for i, c in enumerate(classes)}
    none = len(classes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "sha"], kind="stable")
        seen = np.frombuffer(state.get[0], np.uint8) if state.exists else np.zeros(0, np.uint8)
        every = np.concatenate([seen, np.array([code.get(t, none) for t in rows["type"]], np.uint8)])
        counts = np.vstack([np.zeros((1, none), np.int64), np.cumsum(every[:, None] == np.arange(none), axis=0)])
        at = np.arange(len(seen), len(every))
        since = np.maximum(at - window, 0)
        known = counts[at] - counts[since]
        size = at - since
        state.update((every[-window:].tobytes(),))
        yield pd.DataFrame({"repo": rows["repo"].to_numpy(), "sha": rows["sha"].to_numpy(), "size": size, "prior": list((known + 1.0) / (size[:, None] + none))})

    out = "repo string, sha string, size bigint, prior array<double>"
    held = commits.select("repo", "sha", "ts", "type")
    return held.groupBy("repo").applyInPandasWithState(step, out, "types binary", "append", GroupStateTimeout.NoTimeout)
