"""Signal tracks: alignment, regions, bins, summaries, normalisation and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.scratch import stored

BIN = 128
EDGE = 40_960
MIDDLE = 114_688


def align_tracks(ref: DataFrame, alt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both tracks on equal (row_id, bin_idx, context), and the count of rows on one side only.

    The tracks are joined once, into a table in the shared folder that both results read. A column of ``alt`` whose name
    ``ref`` has too is renamed to ``alt_NAME``. Rows with a null key are on one side only.
    """
    keys = ["row_id", "bin_idx", "context"]
    alt = alt.withColumnsRenamed({c: f"alt_{c}" for c in alt.columns if c in ref.columns and c not in keys})
    both = stored(ref.withColumn("__in_ref", F.lit(True)).join(alt.withColumn("__in_alt", F.lit(True)), keys, "full"), "aligned")
    aligned = F.col("__in_ref").isNotNull() & F.col("__in_alt").isNotNull()
    lone = both.agg(F.count(F.when(~aligned, 1)).alias("n_unaligned"))
    return both.filter(aligned).drop("__in_ref", "__in_alt"), lone


def restrict_to_region(signals: DataFrame, variants: DataFrame) -> DataFrame:
    """Bins that overlap the row's effect region; without a region, or a line in ``variants``, all bins stay."""
    keep = F.col("effect_start").isNull() | ((F.col("bin_end") > F.col("effect_start")) & (F.col("bin_start") < F.col("effect_end")))
    return signals.join(variants.select("row_id", "effect_start", "effect_end"), "row_id", "left").filter(keep).drop("effect_start", "effect_end")


def empty_regions(restricted: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows whose region overlaps no bin."""
    return variants.join(restricted.select("row_id").distinct(), "row_id", "left_anti")


def bins(windows: DataFrame, window: int = 196_608, edge: int = EDGE, width: int = BIN) -> DataFrame:
    """row_id, chrom, bin_idx, bin_start, bin_end over the predicted middle of windows (window_start)."""
    n = (window - 2 * edge) // width
    idx = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin_idx")
    start = F.col("window_start") + edge + F.col("bin_idx") * width
    return windows.select("row_id", "chrom", "window_start", idx).select(
        "row_id", "chrom", "bin_idx", start.alias("bin_start"), (start + width).alias("bin_end")
    )


def summarise_track(signals: DataFrame, how: str, value: str = "ref_signal", cutoff: float = 6.0, k: int = 100) -> DataFrame:
    """One ``summary`` for each (row_id, context): mean, significant_fraction or top_mean."""
    keys = ["row_id", "context"]
    if how == "mean":
        return signals.groupBy(*keys).agg(F.avg(value).alias("summary"))
    if how == "significant_fraction":
        return signals.groupBy(*keys).agg(F.avg(F.when(F.col(value) > cutoff, 1.0).otherwise(0.0)).alias("summary"))
    if how == "top_mean":
        order = W.partitionBy(*keys).orderBy(F.desc(value), "bin_idx")
        top = signals.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
        return top.groupBy(*keys).agg(F.avg(value).alias("summary"))
    raise ValueError(f"unknown track summary {how!r}")


def normalise_tracks(signals: DataFrame, squared: str = "RNA-seq") -> DataFrame:
    """ref_normed and alt_normed by the REF maximum of (row_id, context), and context_rank by mean REF."""
    keys = ["row_id", "context"]
    stats = signals.groupBy(*keys).agg(F.max("ref_signal").alias("__top"), F.round(F.avg("ref_signal"), 9).alias("__m"))
    stats = stats.withColumn("context_rank", F.row_number().over(W.partitionBy("row_id").orderBy(F.desc("__m"), "context"))).drop("__m")
    square = F.col("context").contains(squared)

    def normed(c: str):
        x = F.col(c) / F.nullif(F.col("__top"), F.lit(0.0))
        return F.when(square, x * x).otherwise(x)

    df = signals.join(stats, keys)
    return df.withColumn("ref_normed", normed("ref_signal")).withColumn("alt_normed", normed("alt_signal")).drop("__top")


def diff_tracks(normed: DataFrame, keep_rna_squared: bool = False, rooted: str = "RNA") -> DataFrame:
    """Adds ``diff``: alt less ref, after a square root on names that hold ``rooted``."""
    root = F.col("context").contains(rooted) & F.lit(not keep_rna_squared)
    side = lambda c: F.when(root, F.sqrt(c)).otherwise(F.col(c))
    return normed.withColumn("diff", side("alt_normed") - side("ref_normed"))


def track_delta(tracks: DataFrame, value: str = "diff") -> DataFrame:
    """Sum of a track in percent, to two places, for each (row_id, context)."""
    return tracks.groupBy("row_id", "context").agg(F.round(F.sum(F.col(value) * 100), 2).alias("delta"))
