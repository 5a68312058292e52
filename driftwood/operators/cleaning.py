"""Which labels are likely wrong, told from out-of-fold class probabilities.

A class's threshold is what the model gives it on average where it is the label. The confident joint counts, for each label, the classes that the
model is sure of by these thresholds; brought to the labels' totals it says how many labels of each class should be another. So many, those
with the largest margin, are told. All is counts: by class, by pair of classes, and by pair and step of the margin, so no class is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a margin of 1.
STEPS = 10_000


def disagreeing(label: Column, p: Column, least: float) -> Column:
    """Whether the likeliest class (of equal ones the first) is another than the label, by number, and has `least` or more."""
    return (F.array_position(p, F.array_max(p)) - 1 != label) & (F.array_max(p) >= least)


def thresholds(rows: DataFrame, classes: int) -> DataFrame:
    """One row: t, the mean probability of each class over the rows it labels; of a class without rows 1."""
    return rows.agg(F.array(*[F.coalesce(F.avg(F.when(F.col("label") == c, F.get("p", F.lit(c)))), F.lit(1.0)) for c in range(classes)]).alias("t"))


def confident_joint(rows: DataFrame, classes: int) -> DataFrame:
    """(label, other, n, wrong) of rows (label int, p array): how many rows of a label the model is sure to be `other`, and how many labels of the class that makes.

    A row counts for the likeliest class that reaches its threshold, if any; rows without label or p count nowhere. Pairs that don't occur have no row.
    """
    known = rows.where("label is not null and p is not null")
    sure = F.transform("p", lambda v, i: F.when(F.round(v, 9) >= F.round(F.get("t", i), 9), F.round(v, 9)))
    held = known.crossJoin(F.broadcast(thresholds(known, classes))).withColumn("s", sure)  # thresholds: one row
    told = held.withColumn("other", (F.array_position("s", F.array_max("s")) - 1).cast("int"))
    by = told.groupBy("label", "other").agg(F.count("*").alias("n"))
    of_label = Window.partitionBy("label")  # as many rows as there are classes, and one
    share = by.withColumn("all", F.sum("n").over(of_label)).withColumn("sure", F.sum(F.when(F.col("other").isNotNull(), F.col("n"))).over(of_label))
    return share.where("other is not null").select("label", "other", "n", F.floor(F.col("n") * F.col("all") / F.col("sure")).alias("wrong"))


def label_issues(rows: DataFrame, classes: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, label, other, step): rows (label, p) whose label should likely be `other`, with the margin of its probability over the label's in steps.

    Of each pair of label and other class as many as the confident joint says are told, whole steps of margin from the largest on, so that rows of one margin
    are told or not together and never more than that. A row that several classes claim is told once, for the largest margin, then the first class.
    """
    known = rows.where("label is not null and p is not null")
    wrong = confident_joint(known, classes).where("label <> other and wrong > 0").select("label", "other", "wrong")
    step = F.transform("p", lambda v, i: F.struct(i.alias("other"), F.floor(F.round((v - F.get("p", F.col("label"))) * STEPS, 6)).alias("step")))
    each = known.select(*keep, "label", F.explode(step).alias("x")).select(*keep, "label", F.col("x.other").alias("other"), F.col("x.step").alias("step")).where("other <> label")
    # a row for each pair and step at most, whatever the number of rows
    hist = each.groupBy("label", "other", "step").agg(F.count("*").alias("k"))
    so_far = F.sum("k").over(Window.partitionBy("label", "other").orderBy(F.col("step").desc()))
    least = hist.withColumn("upto", so_far).join(F.broadcast(wrong), ["label", "other"]).where("upto <= wrong").groupBy("label", "other").agg(F.min("step").alias("least"))
    found = each.join(F.broadcast(least), ["label", "other"]).where("step >= least")  # both broadcasts: a row a pair of classes
    best = F.max(F.struct("step", -F.col("other"))).alias("best")
    return found.groupBy(*keep, "label").agg(best).select(*keep, "label", (-F.col("best")["col2"]).alias("other"), F.col("best.step").alias("step"))
