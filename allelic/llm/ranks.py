"""Positions of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

_IN_TASK = 33  # monotonically_increasing_id: the number of the partition above, of the row below


def numbered(df: DataFrame, within: list[str], order: list[Column], ties: list[Column] = [], add: dict[str, Column] = {}) -> DataFrame:
    """``df`` with ``position`` (long, from 0) among the rows of equal ``within``, and their number ``rows``.

    Rows are dealt by ranges of ``within`` and ``order`` and sorted in their task, so one large
    group spreads over many tasks; only counts of a group in a task are summed across tasks. ``ties``
    sort rows of equal ``order``, which share a task. ``add`` names columns to compute after the
    exchange. ``within`` must not be null. The rows are written, so positions hold on reruns of later stages.
    """
    keys = [F.col(c) for c in within]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order, *ties)
    table = stored(dealt.withColumns({**add, "__row": F.monotonically_increasing_id()}), "ranks")
    task = F.shiftright("__row", _IN_TASK).alias("__task")
    runs = table.groupBy(task, *within).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    upto = W.partitionBy(*within).orderBy("__task").rowsBetween(W.unboundedPreceding, 0)
    runs = runs.withColumn("__shift", F.sum("__n").over(upto) - F.col("__n") - F.col("__first"))
    runs = runs.withColumn("rows", F.sum("__n").over(W.partitionBy(*within))).drop("__n", "__first")
    runs = stored(runs, "ranks-offsets")
    placed = table.withColumn("__task", task).join(runs, ["__task", *within])
    return placed.withColumn("position", F.col("__row") + F.col("__shift")).drop("__task", "__row", "__shift")
