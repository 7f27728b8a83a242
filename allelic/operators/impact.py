"""Fold changes, significant effects, impact calls, and tables for plots of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import gtf_attribute, neg_log10, tss
from ..sources import sinks
from ..sources.scratch import removed, stored
from . import bootstrap, intervals, scoring, stratify
from .filters import selected

KEYS = ("locus_id", "context_id")


def background_stats(labelled: DataFrame, absolute: bool = True) -> DataFrame:
    """Mean, population deviation and count of the background effects of each locus and context."""
    x = F.abs("effect") if absolute else F.col("effect")
    bg = labelled.filter(F.col("var_label") == "background")
    return bg.groupBy(*KEYS).agg(F.avg(x).alias("bg_mean"), F.stddev_pop(x).alias("bg_std"), F.count("effect").alias("bg_n"))


def fold_change(labelled: DataFrame, absolute: bool = False) -> DataFrame:
    """Adds ``fold_change``: the signed effect less the background mean (of absolute effects on request)."""
    # One row a locus and context, stored so that its size is known: the effects then need not be dealt to meet it.
    stats = stored(background_stats(labelled, absolute).select(*KEYS, "bg_mean"), "stats")
    return labelled.join(stats, list(KEYS), "left").withColumn("fold_change", F.col("effect") - F.col("bg_mean")).drop("bg_mean")


def call_effects(calls: DataFrame, p_cut: float = 0.05, fc_cut: float = 0.0) -> DataFrame:
    """Adds ``is_sig``; a null p-value or fold change is not significant."""
    sig = (F.col("p_value") < p_cut) & (F.abs("fold_change") > fc_cut)
    return calls.withColumn("is_sig", F.coalesce(sig, F.lit(False)))


def impact_calls(calls: DataFrame) -> DataFrame:
    """Significant effects of each labelled variant, and whether it has any."""
    n = F.sum(F.col("is_sig").cast("int")).cast("long")
    return calls.groupBy("locus_id", "variant_id", "var_label").agg(n.alias("n_sig_effects"), (n > 0).alias("impact_variant"))


def summarise_calls(calls: DataFrame) -> DataFrame:
    """One row for each locus: significant effects, variants with any, mean of effects per such variant."""
    some = F.col("n_sig_effects") > 0
    return impact_calls(calls).groupBy("locus_id").agg(
        F.sum("n_sig_effects").alias("total_sig"),
        F.sum(some.cast("long")).alias("variants_sig"),
        F.avg(F.when(some, F.col("n_sig_effects"))).alias("mean_sig"),
    )


@dataclass(frozen=True)
class Params:
    cuts: stratify.Cuts = field(default_factory=stratify.Cuts)
    n_boots: int = 10_000
    min_std: float = 0.01
    seed: int = 0
    p_cut: float = 0.05
    fc_cut: float = 0.0
    absolute: bool = False


def test_effects(labelled: DataFrame, params: Params = Params()) -> DataFrame:
    """``labelled`` with n_nonsig and p_value of every effect."""
    labelled = stored(labelled, "labelled")
    counted = bootstrap.count_nonsig(labelled, params.n_boots, params.min_std, params.p_cut, params.seed, source=labelled)
    return bootstrap.boot_pvalues(counted, params.n_boots)


def test_calls(labelled: DataFrame, params: Params = Params(), only: str | None = None) -> DataFrame:
    """Every effect with p_value, fold_change and is_sig, from one stored table of labelled effects; with
    ``only``, the effects of that label against all the same backgrounds and numbers of tests.

    Means of the background are one row for each locus and context, joined before the rows are dealt."""
    labelled = stored(labelled, "labelled")
    changed = fold_change(labelled, params.absolute)
    changed = changed if only is None else changed.filter(F.col("var_label") == only)
    counted = bootstrap.count_nonsig(changed, params.n_boots, params.min_std, params.p_cut, params.seed, source=labelled)
    return call_effects(bootstrap.boot_pvalues(counted, params.n_boots), params.p_cut, params.fc_cut)


def impact_map(gwas: DataFrame, effects: DataFrame, params: Params = Params()) -> DataFrame:
    """From summary statistics and effects of all loci to impact calls, in one job: labels and effects
    are put together once, drawn and called in the same tasks, and added up with partial sums."""
    labels = selected(stratify.stratify(gwas, params.cuts))
    labelled = scoring.label_effects(labels, effects).select("locus_id", "context_id", "variant_id", "var_label", "effect")
    return impact_calls(test_calls(labelled, params))


# The names of the written matrices, with the value of each.
OUTPUTS = {"boot_pvals": "p_value", "boot_counts": "n_nonsig", "sig_effects": "is_sig", "fold_changes": "fold_change"}


def write_impact(gwas: DataFrame, effects: DataFrame, prefix: str, params: Params = Params()) -> dict[str, str]:
    """Writes every table of an impact map as TSV, compressed by gzip, under its name and returns the paths by name.

    ``stratified_gwas_stats`` and ``impact_calls`` are tables, ``var_context_effects`` has a row for each variant of ``effects``, and the
    matrices of ``OUTPUTS`` have one for each labelled variant, named ``locus:variant:label``, as a variant may have two
    labels; all have a column for each context of ``effects``. Labels are made once, and calls once, gathered by labelled
    variant; what they were made of is deleted from the shared folder as soon as they are.
    """
    keys = ("locus_id", "variant_id", "var_label")
    columns = {r.context: r.context_id for r in effects.select("context", "context_id").distinct().orderBy("context").collect()}
    labels = stored(stratify.stratify(gwas, params.cuts), "labels")
    labelled = scoring.label_effects(selected(labels), effects).select("locus_id", "context_id", "variant_id", "var_label", "effect")
    calls = test_calls(labelled, params)
    rows = sinks.gathered(calls, list(OUTPUTS.values()), keys, "context_id")
    removed(calls)
    paths = {name: f"{prefix}.{name}" for name in ("stratified_gwas_stats", "impact_calls")}
    sinks.write_table(labels, paths["stratified_gwas_stats"], "tsv", "gzip")
    n = F.size(F.filter(F.map_values("cells"), lambda x: x["is_sig"])).cast("long")
    sinks.write_table(rows.select(*keys, n.alias("n_sig_effects"), (n > 0).alias("impact_variant")), paths["impact_calls"], "tsv", "gzip")
    paths["var_context_effects"] = sinks.write_matrix(effects, prefix, "var_context_effects", "effect", "variant_id", columns=list(columns), compression="gzip")
    paths |= sinks.write_gathered(rows, prefix, OUTPUTS, keys, "variant", columns, "gzip")
    removed(rows, labels)
    return paths


def volcano_table(calls: DataFrame, label: str, p_cut: float = 0.05, fc_cut: float = 0.0) -> DataFrame:
    """Effects of one label with -log10 p and the class up, down or none."""
    sig = F.coalesce((F.col("p_value") < p_cut) & (F.abs("fold_change") > fc_cut), F.lit(False))
    kind = F.when(sig & (F.col("fold_change") > 0), "up").when(sig, "down").otherwise("none")
    return calls.filter(F.col("var_label") == label).select(
        "locus_id", "variant_id", "context", "fold_change", neg_log10("p_value").alias("neg_log10_p"), kind.alias("direction")
    )


def manhattan_table(labelled: DataFrame, gtf: DataFrame) -> DataFrame:
    """Points (kind variant) in plotting order, and the genes (kind gene) over each locus's range."""
    points = intervals.order_points(labelled).select(
        "locus_id", F.lit("variant").alias("kind"), F.col("variant_id").cast("string").alias("name"), F.col("position").alias("x"),
        neg_log10("p_value", 1e-30).alias("y"), F.col("var_label").alias("color"), F.col("point_order").cast("long").alias("ord"),
    )
    span = labelled.groupBy("locus_id").agg(F.min("chromosome").alias("chrom"), F.min("position").alias("win_start"), (F.max("position") + 1).alias("win_end"))
    genes = gtf.filter(F.col("feature") == "gene").select(
        "chrom", (F.col("start_pos") - 1).alias("start0"), F.col("end_pos").alias("end0"), "strand",
        gtf_attribute("gene_name").alias("gene_name"), tss().alias("tss"),
    )
    met = intervals.overlap_join(genes, span.withColumnRenamed("locus_id", "win_id"))
    lines = met.select(
        F.col("win_id").alias("locus_id"), F.lit("gene").alias("kind"), F.col("gene_name").alias("name"), F.col("tss").alias("x"),
        F.lit(None).cast("double").alias("y"), F.col("strand").alias("color"), F.lit(None).cast("long").alias("ord"),
    )
    return points.unionByName(lines)
