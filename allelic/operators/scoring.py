"""Effect scores from REF and ALT signals, effect matrices and their normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

MODES = {
    "signed_sum_abs": "signed_sum_abs",
    "sign_sum_abs": "signed_sum_abs",
    "sum_diff": "sum_diff",
    "sum_logfc": "sum_diff",
    "log_ratio": "log_ratio",
}


def score_effects(signals: DataFrame, mode: str = "signed_sum_abs", keys: tuple[str, ...] = ("row_id", "context")) -> DataFrame:
    """One ``effect`` for each of ``keys`` from ref_signal and alt_signal of its bins."""
    if mode not in MODES:
        raise ValueError(f"unknown scoring mode {mode!r}; one of {', '.join(MODES)}")
    diff = F.col("alt_signal") - F.col("ref_signal")
    ref, alt = F.sum("ref_signal"), F.sum("alt_signal")
    effect = {
        "signed_sum_abs": F.sum(F.abs(diff)) * F.signum(F.sum(diff)),
        "sum_diff": alt - ref,
        "log_ratio": F.log2(alt / F.nullif(ref, F.lit(0.0)) + 1),
    }[MODES[mode]]
    return signals.groupBy(*keys).agg(effect.alias("effect"))


def effect_of_sums(mode: str = "signed_sum_abs"):
    """The effect from a struct of sums: ref, alt, diff and size."""
    if mode not in MODES:
        raise ValueError(f"unknown scoring mode {mode!r}; one of {', '.join(MODES)}")
    return {
        "signed_sum_abs": lambda s: s["size"] * F.signum(s["diff"]),
        "sum_diff": lambda s: s["alt"] - s["ref"],
        "log_ratio": lambda s: F.log2(s["alt"] / F.nullif(s["ref"], F.lit(0.0)) + 1),
    }[MODES[mode]]


def score_sums(sums: DataFrame, mode: str = "signed_sum_abs", keys: tuple[str, ...] = ("row_id", "context")) -> DataFrame:
    """The same from sums over some of the bins: of the REF signals, the ALT signals, their differences and the sizes of these."""
    effect = effect_of_sums(mode)({c: F.sum(c) for c in ("ref", "alt", "diff", "size")})
    return sums.groupBy(*keys).agg(effect.alias("effect"))


def to_matrix(effects: DataFrame, celltypes: list[str] | None, assays: list[str]) -> DataFrame:
    """Rows are (row_id, celltype), columns the named assays; a missing pair is null, of several the largest counts.
    ``celltypes`` None: all there are.

    One aggregate with a column for each assay: a pivot groups by assay first, and keeps a row for each cell.
    """
    cells = [F.max(F.when(F.col("assay") == a, F.col("effect"))).alias(a) for a in assays]
    effects = effects if celltypes is None else effects.filter(F.col("celltype").isin(celltypes))
    return effects.groupBy("row_id", "celltype").agg(*cells)


def from_matrix(matrix: DataFrame, assays: list[str]) -> DataFrame:
    return matrix.unpivot(["row_id", "celltype"], assays, "assay", "effect").filter("effect IS NOT NULL")


def normalise_effects(effects: DataFrame, small_max: float = 0.6, squared: str = "RNA-seq") -> DataFrame:
    """Adds ``normed``: the effect over its assay's maximum within the row unless that is small,
    squared for assays whose name holds ``squared``."""
    top = effects.groupBy("row_id", "assay").agg(F.max("effect").alias("__top"))
    scaled = F.col("effect") / F.when(F.col("__top") < small_max, F.lit(1.0)).otherwise(F.col("__top"))
    square = F.col("assay").contains(squared)
    return effects.join(top, ["row_id", "assay"]).withColumn("normed", F.when(square, scaled * scaled).otherwise(scaled)).drop("__top")


def _ordered(effects: DataFrame, name: str) -> DataFrame:
    """row_id and ``__names``: the values of ``name`` that the row has, by mean absolute effect downwards, then by name."""
    size = effects.filter(F.col(name).isNotNull()).groupBy("row_id", name).agg(F.round(F.avg(F.abs("effect")), 9).alias("__m"))
    # NaN comes first and null last, as by a descending order.
    key = F.struct(F.col("__m").isNull(), ~F.isnan("__m"), -F.col("__m"), F.col(name).alias("name"))
    return size.groupBy("row_id").agg(F.array_sort(F.collect_list(key))["name"].alias("__names"))


def order_effects(effects: DataFrame, top_assays: int = 5) -> DataFrame:
    """Adds assay_rank and celltype_rank: by mean absolute effect, cell types over the top assays.

    A row's names in their order are one list, so that effects meet them by row alone, and effects that
    lie by row are neither dealt nor sorted.
    """
    rank = lambda name: F.array_position("__names", F.col(name)).cast("int")
    met = effects.join(_ordered(effects, "assay").hint("shuffle_hash"), "row_id").filter(F.col("assay").isNotNull())
    ranked = met.withColumn("assay_rank", rank("assay")).drop("__names")
    cells = _ordered(ranked.filter(F.col("assay_rank") <= top_assays), "celltype").hint("shuffle_hash")
    return ranked.join(cells, "row_id", "left").withColumn("celltype_rank", F.nullif(rank("celltype"), F.lit(0))).drop("__names")


def label_effects(labels: DataFrame, effects: DataFrame, key: str = "variant_id") -> DataFrame:
    """Effects with the labels of their variants; a variant with two labels keeps both.

    Labels are hashed, a row or two for each variant, so that the effects, one for each context, are not sorted.
    """
    return labels.select(key, "locus_id", "var_label").hint("shuffle_hash").join(effects.drop("locus_id"), key)
