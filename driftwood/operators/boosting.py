"""Boosted trees on the structural slots, grown level by level from histograms.

Values are put into few bins by quantiles once. For each level of a round's trees, one a class, every task adds up gradients and curvatures by class, node, slot
and bin; the sums of all tasks are tables whose size depends on neither rows nor tasks, and the driver chooses splits from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.operators.tables import dropped, written

#: Sums of one class from so many parts of the tasks are added up apart, before all are.
PARTS = 64


@dataclass
class Trees:
    """edges: for each slot the upper ends of its bins but the last; rounds: for each round (slot, bin, leaf) arrays, a row a class. A value goes left up to its bin's end."""

    classes: int
    depth: int
    edges: list[np.ndarray]
    base: np.ndarray
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], 1).astype(np.uint8) if len(self.edges) else np.zeros((len(x), 0), np.uint8)

    def nodes(self, slot: np.ndarray, cut: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node, numbered within its level, that each row reaches after so many levels of one tree."""
        at = np.zeros(len(bins), np.int64)
        for level in range(levels):
            k = (1 << level) - 1 + at
            at = 2 * at + (bins[np.arange(len(bins)), slot[k]] > cut[k])
        return at

    def logits(self, bins: np.ndarray) -> np.ndarray:
        z = np.tile(self.base, (len(bins), 1))
        for slot, cut, leaf in self.rounds:
            for c in range(self.classes):
                z[:, c] += leaf[c][self.nodes(slot[c], cut[c], bins, self.depth)]
        return z


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def binned(rows: DataFrame, slots: int, bins: int) -> tuple[DataFrame, list[np.ndarray]]:
    """((label, weight, bins binary), a written table; the edges) of rows (label, weight, x): quantiles of each slot, at most bins - 1 of them, come to the driver."""
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(k)), at, 2000).alias(f"q{k}") for k in range(slots)]).first()
    edges = [np.unique(np.array(found[k] or [], float)) for k in range(slots)]
    trees = Trees(0, 0, edges, np.zeros(0))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                b = trees.bins(_matrix(batch.column(2), slots))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in b], pa.binary())], ["label", "weight", "bins"])

    held = rows.select(F.col("label").cast("int"), F.col("weight").cast("double"), "x")
    return written(held.mapInArrow(run, "label int, weight double, bins binary")), edges


def level_sums(table: DataFrame, trees: Trees, slot: np.ndarray, cut: np.ndarray, level: int, bins: int) -> np.ndarray:
    """Sums of gradients and curvatures by (class, node, slot, bin, 2) at a level of the trees that are being grown."""
    width, nodes = len(trees.edges), 1 << level
    size = nodes * width * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros((trees.classes, 2, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
            label, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            p = _softmax(trees.logits(b))
            for c in range(trees.classes):
                at = trees.nodes(slot[c], cut[c], b, level)
                cell = ((at[:, None] * width + np.arange(width)) * bins + b).ravel()
                for k, v in enumerate((weight * (p[:, c] - (label == c)), weight * p[:, c] * (1 - p[:, c]))):
                    out[c, k] += np.bincount(cell, np.repeat(v, width), size)
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees.classes, dtype=np.int32)), pa.array(np.full(trees.classes, part, np.int32)), pa.array([m.tobytes() for m in out], pa.binary())], ["class", "part", "sums"])

    def added(found: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m, np.float64) for m in found["sums"].to_pylist())
        return pa.table([found["class"].slice(0, 1), found["part"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["class", "part", "sums"])

    kind = "class int, part int, sums binary"
    sums = table.mapInArrow(run, kind).groupBy("class", "part").applyInArrow(added, kind).groupBy("class").applyInArrow(added, kind)
    out = np.zeros((trees.classes, 2, size))
    for r in sums.collect():
        out[r["class"]] = np.frombuffer(r["sums"], np.float64).reshape(2, size)
    return out.reshape(trees.classes, 2, nodes, width, bins).transpose(0, 2, 3, 4, 1)


def best_splits(sums: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, bin, sums of both sides) of the best split of each (class, node); a node that gains nothing sends all to the left."""
    left = sums.cumsum(3)
    whole = left[:, :, :, -1:]
    right = whole - left
    gain = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    value = gain(left) + gain(right) - gain(whole)
    value = np.where((left[..., 1] >= least) & (right[..., 1] >= least), value, 0.0)
    flat = value.reshape(*value.shape[:2], -1)
    best = flat.argmax(2)
    slot, cut = best // sums.shape[3], best % sums.shape[3]
    none = flat.max(2) <= 1e-12
    slot, cut = np.where(none, 0, slot), np.where(none, sums.shape[3] - 1, cut)
    i, j = np.indices(slot.shape)
    return slot, cut, np.stack((left[i, j, slot, cut], right[i, j, slot, cut]), 2)


def fit(rows: DataFrame, classes: int, slots: int, rounds: int = 10, depth: int = 3, bins: int = 32, rate: float = 0.3, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Trees for rows (label int, weight, x array of `slots` values, none null); rows without label fall out. A node splits only if each side has `least` curvature.

    Each level is one pass over the binned rows; the driver holds classes * 2^depth * slots * bins sums. Without rows every class is as likely.
    """
    table, edges = binned(rows.where("label is not null"), slots, bins)
    n = {r["label"]: r["w"] for r in table.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    total = sum(n.values())
    trees = Trees(classes, depth, edges, np.array([np.log((n.get(c, 0.0) + 1.0) / (total + classes)) for c in range(classes)]))
    for _ in range(rounds if total else 0):
        slot, cut = np.zeros((classes, (1 << depth) - 1), np.int64), np.full((classes, (1 << depth) - 1), bins, np.int64)
        for level in range(depth):
            s, b, sides = best_splits(level_sums(table, trees, slot, cut, level, bins), l2, least)
            own = slice((1 << level) - 1, (1 << level + 1) - 1)
            slot[:, own], cut[:, own] = s, b
        leaf = -rate * sides[..., 0] / (sides[..., 1] + l2)
        trees.rounds.append((slot, cut, leaf.reshape(classes, -1)))
    dropped(table)
    return trees


def score(rows: DataFrame, trees: Trees, keep: tuple[str, ...] = ("commit_id",)) -> DataFrame:
    """Columns `keep` of rows with x, and z, the logits."""
    width = len(trees.edges)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z = trees.logits(trees.bins(_matrix(batch.column(batch.num_columns - 1), width)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * trees.classes), pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], [*batch.schema.names[:-1], "z"])

    held = rows.select(*keep, "x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    return held.mapInArrow(run, f"{schema}, z array<double>")
