"""Test inputs built from the star-schema tables, in SQL that Spark and DuckDB both run.

Coordinates are 0-based and half-open; there are 50 loci of 114,688 bp and 25 contexts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "events", "lineitem", "orders", "part", "documents", "embeddings")

SQL = {
    "fx_gwas": """
SELECT o_orderkey AS variant_id, o_orderkey % 50 AS locus_id,
  concat('chr', CAST((o_orderkey % 50) % 22 + 1 AS STRING)) AS chromosome,
  (o_orderkey % 50) * 1000000 + (o_orderkey * 7919) % 114688 AS position,
  CASE WHEN o_orderkey % 23 = 0 THEN 'AT' WHEN o_orderkey % 4 = 0 THEN 'A' WHEN o_orderkey % 4 = 1 THEN 'C' WHEN o_orderkey % 4 = 2 THEN 'G' ELSE 'T' END AS ref,
  CASE WHEN o_orderkey % 29 = 0 THEN 'TG' WHEN o_orderkey % 4 = 0 THEN 'C' WHEN o_orderkey % 4 = 1 THEN 'G' WHEN o_orderkey % 4 = 2 THEN 'T' ELSE 'A' END AS alt,
  CAST((o_orderkey * 13 + o_custkey * 31) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS allele_freq,
  CASE WHEN o_orderkey % 10 = 0 THEN u * u * u * u + CAST(0.0001 AS DOUBLE) ELSE u * u * u * u END AS p_value
FROM (SELECT *, CAST((o_orderkey * 104729 + 17) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS u FROM orders) q""",
    "fx_contexts": """
SELECT CAST(ct_idx * 5 + assay_idx AS BIGINT) AS context_id, concat(celltype, '---', assay) AS context, celltype, assay,
  CASE WHEN (ct_idx * 5 + assay_idx) % 3 = 0 THEN 'train' WHEN (ct_idx * 5 + assay_idx) % 3 = 1 THEN 'test' ELSE 'none' END AS allocation
FROM (SELECT c_mktsegment AS celltype, row_number() OVER (ORDER BY c_mktsegment) - 1 AS ct_idx FROM (SELECT DISTINCT c_mktsegment FROM customer) s) c
CROSS JOIN (SELECT * FROM (VALUES (0, 'ATAC-seq'), (1, 'DNase-seq'), (2, 'H3K27ac ChIP-seq'), (3, 'minus strand polyA plus RNA-seq'), (4, 'plus strand polyA plus RNA-seq')) AS t(assay_idx, assay)) a""",
    "fx_effects": """
SELECT g.variant_id, g.locus_id, c.context_id, c.context,
  CAST((g.variant_id * 7919 + c.context_id * 104729 + (g.variant_id * g.variant_id) % 9973) % 2003 - 1001 AS DOUBLE) / CAST(500 AS DOUBLE)
  * (CASE WHEN g.p_value < CAST(0.0000005 AS DOUBLE) AND (g.variant_id + c.context_id) % 4 = 0 THEN CAST(8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS effect
FROM fx_gwas g CROSS JOIN fx_contexts c""",
    "fx_signals": """
SELECT CAST(FLOOR(e.event_id / 896) AS BIGINT) AS row_id, 'chr8' AS chrom, e.event_id % 896 AS bin_idx,
  31019494 + CAST(FLOOR(e.event_id / 896) AS BIGINT) * 1000000 + (e.event_id % 896) * 128 AS bin_start,
  31019494 + CAST(FLOOR(e.event_id / 896) AS BIGINT) * 1000000 + (e.event_id % 896) * 128 + 128 AS bin_end,
  c.context_id, c.context, c.celltype, c.assay,
  e.value / CAST(100 AS DOUBLE) AS ref_signal,
  e.value / CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) + CAST((e.event_id * 7919 + c.context_id * 31) % 21 - 10 AS DOUBLE) / CAST(100 AS DOUBLE)) AS alt_signal
FROM events e CROSS JOIN fx_contexts c WHERE c.context_id IN (0, 3, 4, 7, 9)""",
    "fx_gtf": """
SELECT concat('chr', CAST((p_partkey % 50) % 22 + 1 AS STRING)) AS chrom, 'part' AS source,
  CASE WHEN p_partkey % 3 = 0 THEN 'exon' ELSE 'gene' END AS feature,
  (p_partkey % 50) * 1000000 + (p_partkey * 7919) % 114688 + 1 AS start_pos,
  (p_partkey % 50) * 1000000 + (p_partkey * 7919) % 114688 + p_size * 1000 AS end_pos,
  CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
  concat('gene_id "ENSG', CAST(p_partkey AS STRING), '.1"; gene_type "x"; gene_name "', p_name, '"; level 2;') AS attribute
FROM part""",
    "fx_windows": """
SELECT locus_id, min(chromosome) AS chrom, min(locus_id * 1000000) AS win_start, min(locus_id * 1000000 + 114688) AS win_end FROM fx_gwas GROUP BY locus_id""",
    "fx_eqtl": """
SELECT variant_id, locus_id, position, concat('ENSG', CAST(variant_id % 2100 AS STRING), '.1') AS gene_id, (variant_id * 31) % 200001 - 100000 AS tss_dist,
  CASE WHEN variant_id % 3 = 0 THEN 'Lung' WHEN variant_id % 3 = 1 THEN 'Liver' ELSE 'Nowhere' END AS tissue FROM fx_gwas""",
    "fx_reference": """
SELECT concat('doc', CAST(doc_id AS STRING)) AS contig, doc_id, CAST(length(s) AS BIGINT) AS length, s AS seq
FROM (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '' /*G*/)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTNN') AS s FROM documents) d
WHERE length(s) > 0""",
    "fx_seq_variants": """
SELECT doc_id AS row_id, contig AS chromosome, (doc_id * 7919) % length AS position,
  CASE WHEN doc_id % 10 = 0 THEN 'A' ELSE substr(seq, CAST((doc_id * 7919) % length + 1 AS INT), 1) END AS ref,
  CASE WHEN doc_id % 7 = 0 THEN 'GA' WHEN doc_id % 2 = 0 THEN 'C' ELSE 'T' END AS alt FROM fx_reference""",
    "fx_predictions": """
SELECT l_orderkey AS seq_id, l_returnflag AS celltype, l_linestatus AS assay, l_quantity AS pred,
  l_quantity + (CAST(l_linenumber AS DOUBLE) - CAST(4 AS DOUBLE)) * CAST(0.5 AS DOUBLE) AS truth FROM lineitem""",
    "fx_features": """
SELECT CAST(FLOOR(vec_id / 16) AS BIGINT) AS row_id, vec_id % 16 AS bin_idx, label, embedding AS features FROM embeddings""",
}
NEEDS = {"fx_effects": ("fx_gwas", "fx_contexts"), "fx_signals": ("fx_contexts",), "fx_windows": ("fx_gwas",), "fx_eqtl": ("fx_gwas",), "fx_seq_variants": ("fx_reference",)}


def ctes(*names: str, duckdb: bool = False) -> str:
    """``WITH`` text that defines the named inputs and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in (*NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)

    for name in names:
        add(name)
    text = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return "WITH " + text.replace("/*G*/", ", 'g'" if duckdb else "")


# Tables that an input repeats for every context, with the key of their rows and the rows of a task.
SPREAD = {"fx_effects": ("orders", "o_orderkey", 1 << 16)}


def _spread(name: str, table: str, df: DataFrame) -> DataFrame:
    """``df`` dealt by key before it is repeated, as a task may read a whole file. Effects then lie by variant."""
    of, key, rows = SPREAD.get(name, ("", "", 0))
    if of != table:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input over the tables in ``sf_dir``; only the tables it needs are opened."""
    text = ctes(name)
    for table in BASE:
        if f"FROM {table}" in text:
            _spread(name, table, spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))).createOrReplaceTempView(table)
    return spark.sql(f"{text} SELECT * FROM {name}")
