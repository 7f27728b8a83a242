"""The catalogue of contexts (cell type x assay) and query grids over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.scalars import context_label


def context_grid(celltypes: DataFrame, assays: DataFrame) -> DataFrame:
    """All cell types with all assays: two catalogue columns, of catalogue size."""
    return celltypes.select("celltype").distinct().crossJoin(assays.select("assay").distinct()).withColumn("context", context_label())


def context_pairs(celltypes: DataFrame, assays: DataFrame) -> DataFrame:
    """The i-th cell type with the i-th assay; both have a column ``pos``."""
    return celltypes.select("pos", "celltype").join(assays.select("pos", "assay"), "pos").withColumn("context", context_label())


def query_grid(variants: DataFrame, contexts: DataFrame) -> DataFrame:
    """A row for each variant and context; the requested contexts are a parameter-sized table."""
    return variants.crossJoin(contexts.select("context_id", "context"))


def list_names(catalog: DataFrame) -> DataFrame:
    """kind, name and counts by allocation of every cell type and assay."""
    both = catalog.select(F.explode(F.array(
        F.struct(F.lit("celltype").alias("kind"), F.col("celltype").alias("name")),
        F.struct(F.lit("assay").alias("kind"), F.col("assay").alias("name")),
    )).alias("x"), "allocation")
    count = lambda a: F.sum(F.when(F.col("allocation") == a, 1).otherwise(0)).cast("long").alias(f"n_{a}")
    return both.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"), count("train"), count("test"), count("none"))


def map_tissue(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Joins each row to the biosamples of its tissue; ``mapping`` is (tissue, array of biosamples)."""
    return df.join(mapping.select("tissue", F.explode("biosamples").alias("biosample")), "tissue")


def with_context_vectors(df: DataFrame, celltypes: DataFrame, assays: DataFrame) -> DataFrame:
    """Adds ``vector``: the cell type's vector followed by the assay's; both tables are (name, vector)."""
    ct = celltypes.select(F.col("name").alias("celltype"), F.col("vector").alias("ct_vector"))
    assay = assays.select(F.col("name").alias("assay"), F.col("vector").alias("assay_vector"))
    return df.join(ct, "celltype").join(assay, "assay").withColumn("vector", F.concat("ct_vector", "assay_vector")).drop("ct_vector", "assay_vector")


def first_gene(genes: DataFrame) -> DataFrame:
    """The first row of each gene id, by start, end and feature."""
    order = W.partitionBy("gene_id").orderBy("start_pos", "end_pos", "feature")
    return genes.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def attach_gene(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """The region of each variant's gene, null where the gene is unknown."""
    region = first_gene(genes).select("gene_id", F.col("start_pos").alias("effect_start"), F.col("end_pos").alias("effect_end"))
    return variants.join(region, "gene_id", "left")
