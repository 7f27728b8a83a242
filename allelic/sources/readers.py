"""Readers for the text formats of variant analysis; every result has named, typed columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.scalars import context_label, gtf_attribute

# Canonical name and type of each GWAS column.
GWAS_TYPES = {
    "locus_id": "long", "variant_id": "string", "chromosome": "string", "position": "long", "ref": "string", "alt": "string",
    "allele_freq": "double", "p_value": "double", "beta": "double", "standard_error": "double", "odds_ratio": "double",
    "ci_lower": "double", "ci_upper": "double",
}


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; the header names them. gz files are dealt out after the scan."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def read_gwas(spark: SparkSession, path: str, colmap: dict[str, str], locus_col: str | None = None, chromosome: str | None = None) -> DataFrame:
    """Summary statistics. ``colmap`` maps canonical names to the file's; other columns are kept as text."""
    df = _tsv(spark, path)
    colmap = dict(colmap) | ({"locus_id": locus_col} if locus_col else {})
    named = [F.col(f"`{src}`").cast(GWAS_TYPES.get(name, "string")).alias(name) for name, src in colmap.items()]
    df = df.select(*named, *(F.col(f"`{c}`") for c in df.columns if c not in colmap.values()))
    return df.filter(F.col("chromosome") == chromosome) if chromosome else df


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table with ``row_id``, from 0 in the order of the files' names and of the lines in them.

    Rows are counted for each block of a file; the number of a row is that of the rows in blocks before
    its own and its place in the block. Only the table of blocks, of one line for each, is ordered as a whole.
    """
    scan = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = scan.select("*", block.alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = rows.groupBy("__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    placed = blocks.select("__block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    df = rows.join(placed, "__block").withColumn("row_id", F.col("__at") + F.col("__shift"))
    return df.select(*(F.col(f"`{c}`") for c in scan.columns), "row_id")


def read_variants(spark: SparkSession, path: str, seq_pos_col: str | None = None, region_cols: tuple[str, str] | None = None, id_col: str | None = None) -> DataFrame:
    """CHR, POS, REF, ALT and the optional window centre and effect region.

    ``row_id`` is the file's ``id_col``, or else the order of the file; equal rows are all kept.
    """
    if id_col is None:
        df = _numbered(spark, path)
    else:
        df = _tsv(spark, path).withColumn("row_id", F.col(f"`{id_col}`").cast("long"))
    out = [
        F.col("row_id"), F.col("CHR").alias("chromosome"), F.col("POS").cast("long").alias("position"),
        F.upper("REF").alias("ref"), F.upper("ALT").alias("alt"),
    ]
    if seq_pos_col:
        out.append(F.col(seq_pos_col).cast("long").alias("seq_pos"))
    if region_cols:
        out += [F.col(c).cast("long").alias(n) for c, n in zip(region_cols, ("effect_start", "effect_end"))]
    return df.select(*out)


def read_contexts(spark: SparkSession, path: str, name_col: str = "celltype_assay") -> DataFrame:
    """context, celltype, assay and allocation; the cell type ends at the first ``---``."""
    parts = F.split(F.col(name_col), "---", 2)
    return _tsv(spark, path).select(F.col(name_col).alias("context"), F.get(parts, 0).alias("celltype"), F.get(parts, 1).alias("assay"), "allocation")


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """pos and name of a one-line list parted by ``,,`` (names may hold single commas)."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"[\r\n]+$", ""), ",,")).alias("pos", "name"))


def read_matrix(spark: SparkSession, path: str, value_name: str, key: str = "row_id", key_type: str = "long", value_type: str = "double") -> DataFrame:
    """A wide matrix with a key column as long rows (key, context, value)."""
    df = _tsv(spark, path)
    values = [c for c in df.columns if c != key]
    typed = df.select(F.col(key).cast(key_type), *(F.col(f"`{c}`").cast(value_type).alias(c) for c in values))
    return typed.unpivot([key], [F.col(f"`{c}`") for c in values], "context", value_name)


def read_signals(spark: SparkSession, path: str, key: str = "bin") -> DataFrame:
    """A wide track, rows named ``chrom_start_end``, as long rows; contigs may hold underscores."""
    df = _tsv(spark, path)
    values = [c for c in df.columns if c != key]
    typed = df.select(key, *(F.col(f"`{c}`").cast("double").alias(c) for c in values))
    long = typed.unpivot([key], [F.col(f"`{c}`") for c in values], "context", "signal")
    part = lambda i: F.regexp_extract(key, r"^(.*)_(\d+)_(\d+)$", i)
    return long.select(part(1).alias("chrom"), part(2).cast("long").alias("bin_start"), part(3).cast("long").alias("bin_end"), "context", "signal")


GTF = "chrom string, source string, feature string, start_pos long, end_pos long, score string, strand string, frame string, attribute string"


def gtf_intervals(gtf: DataFrame) -> DataFrame:
    """INTERVALS (0-based, half-open) of raw GTF rows (1-based, closed)."""
    return gtf.select(
        "chrom", (F.col("start_pos") - 1).alias("start0"), F.col("end_pos").alias("end0"), "feature", "strand",
        gtf_attribute("gene_id").alias("gene_id"), gtf_attribute("gene_name").alias("gene_name"),
    )


def read_gtf(spark: SparkSession, path: str, features: tuple[str, ...] | None = None) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema=GTF, comment="#", quote="")
    return gtf_intervals(raw.filter(F.col("feature").isin(*features)) if features else raw)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start0, end0 and further columns as c3, c4, ..."""
    df = spark.read.csv(path, sep="\t", header=False, comment="#")
    first = [F.col("_c0").alias("chrom"), F.col("_c1").cast("long").alias("start0"), F.col("_c2").cast("long").alias("end0")]
    return df.select(*first, *(F.col(c).alias(c[1:]) for c in df.columns[3:]))


def read_reference(spark: SparkSession, fasta: str, fai: str, chunk: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """Chunks (contig, chunk, chunk_start, seq) and contigs (contig, length) of an indexed FASTA file.

    Each task reads the byte ranges of its chunks; no contig is held whole.
    """
    index = spark.read.csv(fai, sep="\t", schema="contig string, length long, offset long, bases long, width long")
    ranges = index.filter("length > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = fs.FileSystem.from_uri(fasta)
        with store.open_input_file(path) as file:
            for pdf in batches:
                texts = []
                for r in pdf.itertuples():
                    first, last = r.chunk * chunk, min((r.chunk + 1) * chunk, r.length)
                    at = lambda p: r.offset + p // r.bases * r.width + p % r.bases  # noqa: B023, E731
                    file.seek(at(first))
                    texts.append(b"".join(file.read(at(last - 1) + 1 - at(first)).split()).decode().upper())
                yield pdf[["contig", "chunk"]].assign(chunk_start=pdf.chunk * chunk, seq=texts)

    tasks = spark.sparkContext.defaultParallelism
    chunks = ranges.repartition(tasks, "contig", "chunk").mapInPandas(run, "contig string, chunk long, chunk_start long, seq string")
    return chunks, index.select("contig", "length")


def celltype_assay(df: DataFrame) -> DataFrame:
    return df.withColumn("context", context_label())
