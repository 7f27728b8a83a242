"""Row filters, projections and validations over variants and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import with_chr


def snv_only(df: DataFrame, ref: str = "ref", alt: str = "alt") -> DataFrame:
    return df.filter((F.length(ref) == 1) & (F.length(alt) == 1))


def locus_window(gwas: DataFrame, centers: DataFrame, up: int, down: int) -> DataFrame:
    """Variants strictly within ``up`` before and ``down`` behind a centre (locus_id, chrom, center).

    Variants and centres meet in position bins as wide as the window, so this is an equi-join.
    """
    width = max(up + down, 1)
    bins = F.sequence(F.floor((F.col("center") - up) / width), F.floor((F.col("center") + down) / width))
    around = centers.select(F.col("locus_id").alias("center_id"), F.col("chrom").alias("chromosome"), "center", F.explode(bins).alias("__bin"))
    placed = gwas.withColumn("__bin", F.floor(F.col("position") / width))
    inside = (F.col("position") > F.col("center") - up) & (F.col("position") < F.col("center") + down)
    return placed.join(around, ["chromosome", "__bin"]).filter(inside).drop("__bin")


def selected(df: DataFrame, label: str = "var_label") -> DataFrame:
    return df.filter(F.col(label) != "other")


def to_query(df: DataFrame, centers: DataFrame) -> DataFrame:
    """CHR, POS, REF, ALT and the constant window centre of each locus (locus_id, center)."""
    return df.join(centers.select("locus_id", "center"), "locus_id").select(
        "variant_id", with_chr("chromosome").alias("CHR"), F.col("position").alias("POS"),
        F.upper("ref").alias("REF"), F.upper("alt").alias("ALT"), F.col("center").alias("SEQ_POS"),
    )


def with_center(df: DataFrame, pos: str = "position", dist: str = "tss_dist") -> DataFrame:
    """Adds ``tss`` (position less distance) and ``seq_pos``, the midpoint of variant and TSS."""
    start = F.col(pos) - F.col(dist)
    return df.withColumn("tss", start).withColumn("seq_pos", F.floor((F.col(pos) + start) / 2).cast("long"))


def filter_contexts(df: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), celltypes: tuple[str, ...] = ()) -> DataFrame:
    """Keeps names that hold any of ``include`` and none of ``exclude``, of the named cell types."""
    name = F.col("context")
    if include:
        df = df.filter(_any([name.contains(x) for x in include]))
    if exclude:
        df = df.filter(~_any([name.contains(x) for x in exclude]))
    return df.filter(F.col("celltype").isin(*celltypes)) if celltypes else df


def _any(tests: list[Column]) -> Column:
    found = F.lit(False)
    for t in tests:
        found = found | t
    return found


def validate_contexts(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """context, status of each request that cannot be served: unknown, or asked for twice."""
    unknown = requested.select("context").distinct().join(catalog.select("context"), "context", "left_anti")
    twice = requested.groupBy("context").count().filter("count > 1").select("context")
    return unknown.withColumn("status", F.lit("unknown")).unionByName(twice.withColumn("status", F.lit("duplicate")))


def validate_center(df: DataFrame, window: int = 196608, share: float = 0.95) -> DataFrame:
    """Adds ``center_status``: ok, far (reaches share x window) or outside (reaches the window)."""
    gap = F.abs(F.col("seq_pos") - F.col("position"))
    return df.withColumn(
        "center_status", F.when(gap >= window, "outside").when(gap >= window * share, "far").otherwise("ok")
    )


def validate_same_chrom(variants: DataFrame, signals: DataFrame) -> DataFrame:
    """Variants (row_id, chrom) whose tracks lie on another chromosome, or that have none."""
    return variants.join(signals.select("row_id", "chrom").distinct(), ["row_id", "chrom"], "left_anti")
