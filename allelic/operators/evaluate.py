"""Prediction error, background t-statistics and feature means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import stored


def evaluate(pred: DataFrame, by: str = "stratified") -> DataFrame:
    """Mean squared error of ``pred`` (celltype, assay, pred, truth).

    ``overall`` is one row; ``stratified`` has the error of each cell type and each assay, and of
    the mean of all these strata under the name ``all``.
    """
    err = (F.col("pred") - F.col("truth")) * (F.col("pred") - F.col("truth"))
    if by == "overall":
        return pred.agg(F.avg(err).alias("mse"))
    sums = pred.groupBy("celltype", "assay").agg(F.sum(err).alias("s"), F.count("*").alias("n"))
    strata = sums.select(F.explode(F.array(F.struct(F.lit("celltype").alias("kind"), F.col("celltype").alias("name")), F.struct(F.lit("assay").alias("kind"), F.col("assay").alias("name")))).alias("x"), "s", "n")
    each = strata.groupBy("x.kind", "x.name").agg((F.sum("s") / F.sum("n")).alias("mse"))
    return each.unionByName(each.agg(F.lit("all").alias("kind"), F.lit("all").alias("name"), F.avg("mse").alias("mse")))


def evaluate_weighted(pred: DataFrame, weights: DataFrame, huber_delta: float | None = None) -> DataFrame:
    """Weighted error: summed over sequences and averaged over contexts, x 100 (Huber: x 1000)."""
    e = F.col("pred") - F.col("truth")
    if huber_delta is None:
        loss, scale = e * e, 100.0
    else:
        loss = F.when(F.abs(e) <= huber_delta, 0.5 * e * e).otherwise(huber_delta * (F.abs(e) - 0.5 * huber_delta))
        scale = 1000.0
    # Sums of a context before the weights: the join meets one row for each context.
    sums = pred.groupBy("celltype", "assay").agg(F.sum(loss).alias("s"))
    return sums.join(weights, ["celltype", "assay"]).agg((F.avg(F.col("s") * F.col("weight")) * scale).alias("loss"))


def _background_moments(labelled: DataFrame) -> DataFrame:
    """Of each locus and context: mean of the absolute background effects, its standard error, degrees of freedom, and the
    numbers of background and tested rows. One row each, stored so that its size is known: effects need not be dealt to meet it."""
    bg = F.col("var_label") == "background"
    x = F.when(bg, F.abs("effect"))
    return stored(
        labelled.groupBy("locus_id", "context_id").agg(
            F.avg(x).alias("__m"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("__sem"), (F.count(x) - 1).alias("dof"),
            F.count(F.when(bg, 1)).alias("__bg"), F.count(F.when(~bg, 1)).alias("__tests"),
        ),
        "moments",
    )


def _tested(labelled: DataFrame, moments: DataFrame) -> DataFrame:
    x = F.abs("effect")
    bg = moments.filter("__bg > 0").drop("__bg", "__tests")
    rest = labelled.filter(F.col("var_label") != "background").join(bg, ["locus_id", "context_id"])
    return rest.withColumn("t", (x - F.col("__m")) / F.nullif(F.col("__sem"), F.lit(0.0))).withColumn("ratio", x / F.nullif(F.col("__m"), F.lit(0.0))).drop("__m", "__sem")


def background_t(labelled: DataFrame) -> DataFrame:
    """t of each absolute effect against its background, degrees of freedom, ratio to the background mean."""
    return _tested(labelled, _background_moments(labelled))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if not (np.abs(d * c - 1) > 1e-15).any():  # the factors that follow are 1
            break
    return h


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 10."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    while (low := x < 10).any():
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def two_sided_t(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Probability of a Student t at least as large in absolute value."""
    t, dof = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(dof, float))
    x = dof / (dof + t * t)
    a, b = dof / 2, np.full_like(dof, 0.5)
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)))
    direct = x < (a + 1) / (a + b + 2)
    low = front * _beta_fraction(a, b, np.where(direct, x, 0.0)) / a
    high = 1 - front * _beta_fraction(b, a, np.where(direct, 0.0, 1 - x)) / b
    return np.clip(np.where(direct, low, high), 0, 1)


def background_ttest(labelled: DataFrame, n_tests: int | str | None = None) -> DataFrame:
    """``background_t`` with the two-sided p-value, Bonferroni-corrected on request (capped at 1)
    for ``n_tests`` tests, or for as many as there are tested effects with ``n_tests='rows'``."""

    @F.pandas_udf("double")
    def p_of(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series(two_sided_t(t.to_numpy(), dof.to_numpy()))

    moments = _background_moments(labelled)
    df = _tested(labelled, moments).withColumn("p", p_of("t", F.col("dof").cast("double")))
    if n_tests == "rows":
        # One row, so the join is a broadcast of a single number.
        number = moments.agg(F.greatest(F.coalesce(F.sum("__tests"), F.lit(0)), F.lit(1)).alias("__tests"))
        return df.crossJoin(number).withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * F.col("__tests"))).drop("__tests")
    return df.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * n_tests)) if n_tests else df


def effects_below(tested: DataFrame, p_cut: float = 0.01, p: str = "p_adj") -> DataFrame:
    """locus_id, variant_id and n_below, the effects of each variant with ``p`` below the cut."""
    return tested.groupBy("locus_id", "variant_id").agg(F.sum(F.coalesce(F.col(p) < p_cut, F.lit(False)).cast("long")).alias("n_below"))


def mean_features(features: DataFrame) -> DataFrame:
    """row_id and the mean of its feature arrays."""
    vector = array_to_vector(F.col("features").cast("array<double>"))
    means = features.filter("features IS NOT NULL").groupBy("row_id").agg(Summarizer.mean(vector).alias("mean"))
    return means.select("row_id", vector_to_array("mean").alias("mean_features"))
