"""Variant labels within each GWAS locus: candidate, rare, background and other.

All loci are labelled together. Counts and ranges of a locus are aggregates with partial sums, stored as one row
a locus, so that their size is known and rows need not be dealt to meet them; only rows that may be ranked (loci without a significant
variant, loci short of background) go through sorted windows, and none do where no locus has such: parts of a locus are
ranked first, and only the n best of each part together, so that no locus is sorted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import stored

@dataclass(frozen=True)
class Cuts:
    p_cut: float = 5e-7
    lowsig: float = 1e-3
    af_cut: float = 0.05
    n_top: int = 10
    min_bg: int = 100


PARTS = 32  # of a locus, each ranked by itself
ROWS = 1 << 17  # that a task sorts at once


def row_tasks(df: DataFrame) -> int | None:
    """Tasks for ``df`` at ``ROWS`` each, or None if there are no more of them than cores: Spark's own number is then as good."""
    tasks = -(-df.count() // ROWS)
    return tasks if tasks > df.sparkSession.sparkContext.defaultParallelism else None


def _among_first(df: DataFrame, wanted: Column, n: int, *order: Column, tasks: int | None = None) -> DataFrame:
    """Adds ``__first``: the row is among the first n of the ``wanted`` rows of its locus by ``order``, then variant_id.

    Of rows that are equal in these, any take the last places. Other rows pass by the rankings. With
    ``tasks``, rows are dealt to so many for each ranking.
    """

    def ranked(df: DataFrame, *keys: Column) -> DataFrame:
        names = [f"__key{i}" for i in range(len(keys))]
        df = df.withColumns(dict(zip(names, keys)))
        df = df if tasks is None else df.repartition(tasks, *names)
        return df.withColumn("__rank", F.row_number().over(W.partitionBy(*names).orderBy(*order, "variant_id"))).drop(*names)

    own, wanted = F.xxhash64("variant_id"), F.coalesce(wanted, F.lit(False))
    some = ranked(df.filter(wanted), F.col("locus_id"), F.pmod(own, F.lit(PARTS)))
    some = ranked(some.withColumn("__best", F.col("__rank") <= n), F.col("locus_id"), F.col("__best"), F.when(~F.col("__best"), own))
    some = some.withColumn("__first", F.col("__best") & (F.col("__rank") <= n)).drop("__best", "__rank")
    return some.unionByName(df.filter(~wanted).withColumn("__first", F.lit(False)))


def mark_candidates(gwas: DataFrame, cuts: Cuts = Cuts(), tasks: int | None = None) -> DataFrame:
    """Adds ``is_candidate``: p below the cut, or the ``n_top`` smallest p of a locus that has no such variant (null p first)."""
    significant = F.coalesce(F.col("p_value") < cuts.p_cut, F.lit(False))
    loci = stored(gwas.groupBy("locus_id").agg(F.max(significant).alias("__any_sig")), "loci")
    df = gwas.join(loci, "locus_id")
    if loci.filter(~F.col("__any_sig")).isEmpty():
        return df.withColumn("is_candidate", significant).drop("__any_sig")
    df = _among_first(df, ~F.col("__any_sig"), cuts.n_top, F.asc("p_value"), tasks=tasks)
    return df.withColumn("is_candidate", F.when(F.col("__any_sig"), significant).otherwise(F.col("__first"))).drop("__any_sig", "__first")


def signal_range(marked: DataFrame) -> DataFrame:
    """locus_id and the smallest and largest position of its candidates."""
    at = F.when(F.col("is_candidate"), F.col("position"))
    return marked.groupBy("locus_id").agg(F.min(at).alias("range_start"), F.max(at).alias("range_end"))


def mark_rare(marked: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """Adds ``is_rare``: frequency beyond the cut at either end, inside the candidate range."""
    af = F.col("allele_freq")
    inside = F.col("position").between(F.col("__low"), F.col("__high"))
    ranges = stored(signal_range(marked).toDF("locus_id", "__low", "__high"), "ranges")
    df = marked.join(ranges, "locus_id")
    return df.withColumn("is_rare", ((af < cuts.af_cut) | (af > 1 - cuts.af_cut)) & inside).drop("__low", "__high")


def mark_background(marked: DataFrame, cuts: Cuts = Cuts(), tasks: int | None = None) -> DataFrame:
    """Adds ``is_background``; needs ``is_rare``.

    Clearly non-significant common variants; where a locus has fewer than ``min_bg`` of them, the
    ``min_bg`` of largest frequency among all its clearly non-significant variants that are not rare.
    """
    af = F.col("allele_freq")
    open_ = (F.col("p_value") > cuts.lowsig) & ~F.col("is_rare")
    common = open_ & (af > cuts.af_cut) & (af < 1 - cuts.af_cut)
    df = marked.withColumn("__open", open_).withColumn("__common", common)
    loci = stored(df.groupBy("locus_id").agg((F.sum(F.col("__common").cast("int")) < cuts.min_bg).alias("__short")), "short")
    df = df.join(loci, "locus_id")
    if loci.filter("__short").isEmpty():
        return df.withColumn("is_background", F.col("__common")).drop("__open", "__common", "__short")
    df = _among_first(df, F.col("__short") & F.col("__open"), cuts.min_bg, F.desc("allele_freq"), tasks=tasks)
    # Null where it is not known whether a variant is open.
    fallback = F.when(F.col("__open").isNotNull(), F.col("__first"))
    return df.withColumn("is_background", F.when(F.col("__short"), fallback).otherwise(F.col("__common"))).drop("__open", "__common", "__short", "__first")


def stratify(gwas: DataFrame, cuts: Cuts = Cuts(), overlap: str = "keep") -> DataFrame:
    """SNVs with ``var_label``; a variant in two classes comes twice, or with ``overlap='first'`` once."""
    tasks = row_tasks(gwas)
    df = mark_background(mark_rare(mark_candidates(gwas, cuts, tasks), cuts), cuts, tasks)
    df = df.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    labels = F.filter(
        F.array(
            F.when(F.col("is_candidate"), F.lit("candidate")),
            F.when(F.col("is_rare"), F.lit("rare")),
            F.when(F.col("is_background"), F.lit("background")),
        ),
        lambda x: x.isNotNull(),
    )
    labels = F.when(F.size(labels) == 0, F.array(F.lit("other"))).otherwise(F.slice(labels, 1, 1) if overlap == "first" else labels)
    return df.select(*gwas.columns, F.explode(labels).alias("var_label"))


def stratify_simple(gwas: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """Two classes of SNVs: candidates by p, background inside their range."""
    df = gwas.withColumn("is_candidate", F.coalesce(F.col("p_value") < cuts.p_cut, F.lit(False)))
    df = df.join(signal_range(df).toDF("locus_id", "__low", "__high"), "locus_id").filter((F.length("ref") == 1) & (F.length("alt") == 1))
    inside = F.col("position").between(F.col("__low"), F.col("__high"))
    label = F.when(F.col("is_candidate"), "candidate").when((F.col("p_value") > cuts.lowsig) & inside, "background")
    return df.withColumn("var_label", label).filter("var_label IS NOT NULL").select(*gwas.columns, "var_label")


def label_counts(labelled: DataFrame) -> DataFrame:
    """Variants of each label in each locus, with the label's rank from most to least frequent."""
    counts = labelled.groupBy("locus_id", "var_label").agg(F.count("*").alias("n"))
    order = W.partitionBy("locus_id").orderBy(F.desc("n"), "var_label")
    return counts.withColumn("rank", F.row_number().over(order))
