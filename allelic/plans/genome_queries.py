"""Queries over sequences, files and inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixtures import ctes, load
from ..functions import scalars as fn
from ..operators import blocks, contexts, filters, genome, inference, stratify
from ..sources import readers, reference, sinks
from ..sources.scratch import scratch
from .core import MATRIX_NORMED, MATRIX_TOPS, NORMED, STATS, rounded
from .registry import ORACLES, QUERIES, query

CHUNK = 128  # small, so that short contigs span several chunks
WINDOW = 64


def pieces(ref: DataFrame):
    contigs = ref.select("contig", "length")
    return genome.chunked(ref.select("contig", "seq"), CHUNK), contigs


def written(ref: DataFrame, segment: int = 1 << 14, chunk: int = 1 << 12) -> reference.Reference:
    """The contigs as indexed FASTA files, in segments short enough that many contigs have several."""
    path = scratch(ref.sparkSession, "genome")
    reference.write_reference(genome.chunked(ref.select("contig", "seq"), chunk), path, segment)
    return reference.open_reference(ref.sparkSession, path)


# Windows around each variant, as text in both engines.
def sql_windows(size: int) -> str:
    half = size // 2
    return f"""
v AS (SELECT s.row_id, s.chromosome AS chrom, s.position, s.ref, s.alt, s.position - {half} AS ws, r.length, r.seq FROM fx_seq_variants s JOIN fx_reference r ON r.contig = s.chromosome),
w AS (SELECT *, repeat('N', CAST(greatest(0, -ws) AS INTEGER)) || substr(seq, CAST(greatest(ws, 0) + 1 AS INTEGER), CAST(least(ws + {size}, length) - greatest(ws, 0) AS INTEGER)) || repeat('N', CAST(greatest(0, ws + {size} - length) AS INTEGER)) AS win FROM v),
x AS (SELECT *, substr(win, {half + 1}, length(ref)) = ref AS same FROM w),
y AS (SELECT *, substr(win, 1, {half}) || ref || substr(win, {half + 1} + length(ref)) AS fixed, substr(win, 1, {half}) || alt || substr(win, {half + 1} + length(ref)) AS spliced FROM x),
z AS (SELECT *, CASE WHEN length(spliced) > {size} THEN substr(spliced, CAST(floor((length(spliced) - {size}) / 2.0) + 1 AS INTEGER), {size}) ELSE spliced END AS alt_full FROM y)"""


SQL_WINDOWS = sql_windows(WINDOW)
SQL_WHOLE = sql_windows(196_608)  # the published size


@query("fx_reference", sql=f"SELECT contig, k AS chunk, k * {CHUNK} AS chunk_start, substr(seq, CAST(k * {CHUNK} + 1 AS INTEGER), {CHUNK}) AS seq FROM (SELECT *, unnest(range(CAST((length - 1) // {CHUNK} + 1 AS BIGINT))) AS k FROM fx_reference)")
def ref_chunks(ref):
    return pieces(ref)[0]


@query("fx_seq_variants", "fx_reference", sql="SELECT s.row_id, substr(r.seq, CAST(s.position + 1 AS INTEGER), length(s.ref)) AS found_ref, CASE WHEN substr(r.seq, CAST(s.position + 1 AS INTEGER), length(s.ref)) = s.ref THEN 'ok' ELSE 'mismatch' END AS status FROM fx_seq_variants s JOIN fx_reference r ON r.contig = s.chromosome")
def val_ref_check(variants, ref):
    return genome.validate_variants(variants, pieces(ref)[0], chunk=CHUNK).select("row_id", "found_ref", "status")


@query("fx_seq_variants", "fx_reference", sql="SELECT count(*) AS n_checked, CAST(sum(CASE WHEN substr(r.seq, CAST(s.position + 1 AS INTEGER), length(s.ref)) = s.ref THEN 0 ELSE 1 END) AS BIGINT) AS n_incorrect FROM fx_seq_variants s JOIN fx_reference r ON r.contig = s.chromosome")
def agg_validation(variants, ref):
    return genome.validation_report(genome.validate_variants(variants, pieces(ref)[0], chunk=CHUNK))


@query("fx_seq_variants", "fx_reference", more=SQL_WINDOWS, sql="SELECT row_id, chrom, ws AS window_start, CASE WHEN same THEN win END AS ref_seq, CASE WHEN same THEN alt_full END AS alt_seq, CASE WHEN same THEN 'ok' ELSE 'mismatch' END AS status FROM z")
def seq_windows(variants, ref):
    return genome.build_windows(variants, *pieces(ref), window=WINDOW, chunk=CHUNK)


@query("fx_seq_variants", "fx_reference", more=SQL_WINDOWS, sql="SELECT row_id, chrom, ws AS window_start, fixed AS ref_seq, alt_full AS alt_seq, CASE WHEN same THEN 'ok' ELSE 'corrected' END AS status FROM z")
def val_correct_ref(variants, ref):
    return genome.build_windows(variants, *pieces(ref), window=WINDOW, chunk=CHUNK, correct_ref=True)


@query("fx_seq_variants", "fx_reference", more=SQL_WINDOWS, sql="SELECT row_id, win AS text FROM z")
def join_ref_window(variants, ref):
    return genome.window_text(variants, *pieces(ref), window=WINDOW, chunk=CHUNK).select("row_id", F.col("seq").alias("text"))


@query("fx_reference", sql="SELECT doc_id, array_to_string(string_split(translate(seq, 'ACGTN', '01234'), ''), ',') AS tokens FROM fx_reference")
def fn_tokens(ref):
    return ref.select("doc_id", F.array_join(fn.dna_tokens("seq").cast("array<string>"), ",").alias("tokens"))


# The tokens of the whole sequence, as a digest.
@query("fx_reference", sql="SELECT doc_id, md5(array_to_string(string_split(translate(seq, 'ACGTN', '01234'), ''), ',')) AS tokens FROM fx_reference")
def fn_tokens_full(ref):
    return ref.select("doc_id", F.md5(F.array_join(fn.dna_tokens("seq").cast("array<string>"), ",").cast("binary")).alias("tokens"))


# The same operators over a genome in files: written by all tasks, read by ranges.


@query("fx_reference", sql="SELECT contig, k AS chunk, k * 16384 AS chunk_start, substr(seq, CAST(k * 16384 + 1 AS INTEGER), 16384) AS seq FROM (SELECT *, unnest(range(CAST((length - 1) // 16384 + 1 AS BIGINT))) AS k FROM fx_reference)")
def src_reference(ref):
    return written(ref).chunks()


@query("fx_reference", sql="SELECT contig, length FROM fx_reference")
def src_reference_contigs(ref):
    return written(ref).contigs()


@query("fx_seq_variants", "fx_reference", sql="SELECT s.row_id, substr(r.seq, CAST(s.position + 1 AS INTEGER), length(s.ref)) AS found_ref, CASE WHEN substr(r.seq, CAST(s.position + 1 AS INTEGER), length(s.ref)) = s.ref THEN 'ok' ELSE 'mismatch' END AS status FROM fx_seq_variants s JOIN fx_reference r ON r.contig = s.chromosome")
def val_ref_files(variants, ref):
    return genome.validate_variants(variants, written(ref)).select("row_id", "found_ref", "status")


@query("fx_seq_variants", "fx_reference", more=SQL_WHOLE, sql="SELECT row_id, chrom, ws AS window_start, CASE WHEN same THEN md5(win) END AS ref_md5, CASE WHEN same THEN md5(alt_full) END AS alt_md5, CASE WHEN same THEN 'ok' ELSE 'mismatch' END AS status FROM z")
def seq_windows_files(variants, ref):
    made = genome.build_windows(variants, written(ref))
    return made.select("row_id", "chrom", "window_start", F.md5(F.col("ref_seq").cast("binary")).alias("ref_md5"), F.md5(F.col("alt_seq").cast("binary")).alias("alt_md5"), "status")


@query("fx_seq_variants", "fx_reference", sql="SELECT s.row_id, md5(substr(r.seq, 1, CAST(s.position AS INTEGER)) || s.alt || substr(r.seq, CAST(s.position + 1 + length(s.ref) AS INTEGER))) AS spliced FROM fx_seq_variants s JOIN fx_reference r ON r.contig = s.chromosome")
def fn_splice(variants, ref):
    edits = variants.select("row_id", F.col("chromosome").alias("contig"), F.col("position").alias("at"), "ref", "alt")
    return written(ref).edited_md5(edits).select("row_id", F.col("md5").alias("spliced"))


# Bins of 16 over the middle 32 of the window; signals are G and C of a bin times (context + 1) / 10.
SQL_SIGNALS = SQL_WINDOWS + """,
b AS (SELECT row_id, chrom, CAST(k AS INTEGER) AS bin_idx, ws + 16 + k * 16 AS bin_start, ws + 32 + k * 16 AS bin_end, substr(win, CAST(17 + k * 16 AS INTEGER), 16) AS rb, substr(alt_full, CAST(17 + k * 16 AS INTEGER), 16) AS ab FROM z CROSS JOIN range(2) r(k) WHERE same),
sig AS (SELECT row_id, chrom, bin_idx, bin_start, bin_end, context_id, context, length(regexp_replace(rb, '[^GC]', '', 'g')) * ((context_id + 1) / 10e0) AS ref_signal, length(regexp_replace(ab, '[^GC]', '', 'g')) * ((context_id + 1) / 10e0) AS alt_signal FROM b CROSS JOIN fx_contexts)"""


@query("fx_seq_variants", "fx_reference", "fx_contexts", more=SQL_SIGNALS, sql="SELECT * FROM sig")
def inf_predict(variants, ref, ctx):
    windows = genome.build_windows(variants, *pieces(ref), window=WINDOW, chunk=CHUNK)
    return inference.predict(inference.bin_sequences(windows, WINDOW, 16, 16), ctx, inference.gc_predictor)


@query(
    "fx_seq_variants", "fx_reference", "fx_contexts", more=SQL_SIGNALS,
    sql="SELECT row_id, context_id, context, round(sum(abs(alt_signal - ref_signal)) * CASE WHEN sum(alt_signal - ref_signal) > 0 THEN 1 WHEN sum(alt_signal - ref_signal) < 0 THEN -1 ELSE 0 END, 6) AS effect FROM sig GROUP BY row_id, context_id, context",
)
def pipe_infer_effects(variants, ref, ctx):
    got = inference.infer_effects(variants, *pieces(ref), ctx, window=WINDOW, edge=16, width=16, chunk=CHUNK)
    return got.withColumn("effect", F.round("effect", 6))


# A head of whole weights, given by rule: features in 64ths, three genome outputs, four hidden ones, one output.
HEAD = {
    "genome_w": np.array([[(i * 7 + j * 3) % 5 - 2.0 for j in range(64)] for i in range(3)]),
    "genome_b": np.array([i - 1.0 for i in range(3)]),
    "layers": [(np.array([[(i * 5 + j * 2) % 7 - 3.0 for j in range(6)] for i in range(4)]), np.array([float(i) for i in range(4)]))],
    "out_w": np.array([[j % 3 - 1.0 + j // 2 for j in range(4)]]),
    "out_b": np.array([2.0]),
}


def _sql_row(weights, terms, bias) -> str:
    return " + ".join([f"{float(w)}e0 * {t}" for w, t in zip(weights, terms)] + [f"{float(bias)}e0"])


def sql_head() -> str:
    """The same head in SQL, unit by unit."""
    genome_units = ", ".join(f"greatest(0e0, list_sum(list_transform(range(64), lambda j: x[j + 1] * (({i} * 7 + j * 3) % 5 - 2))) + {b}) AS g{i}" for i, b in enumerate(HEAD["genome_b"]))
    w, b = HEAD["layers"][0]
    terms = ["length(celltype)", "1", "length(assay)", "g0", "g1", "g2"]
    hidden = ", ".join(f"greatest(0e0, {_sql_row(w[i], terms, b[i])}) AS h{i}" for i in range(4))
    out = _sql_row(HEAD["out_w"][0], ["h0", "h1", "h2", "h3"], HEAD["out_b"][0])
    return f"""
f AS (SELECT row_id, bin_idx, list_transform(features, lambda v: floor(CAST(v AS DOUBLE) * 64)) AS r FROM fx_features),
side AS (SELECT row_id, bin_idx, 'ref' AS side, r AS x FROM f UNION ALL SELECT row_id, bin_idx, 'alt', list_reverse(r) FROM f),
gen AS (SELECT row_id, bin_idx, side, {genome_units} FROM side),
hid AS (SELECT row_id, bin_idx, side, context_id, context, {hidden} FROM gen CROSS JOIN fx_contexts),
outs AS (SELECT *, greatest(0e0, {out}) AS y FROM hid),
sums AS (SELECT row_id, bin_idx, context_id, context, sum(CASE WHEN side = 'alt' THEN y ELSE -y END) AS d FROM outs GROUP BY row_id, bin_idx, context_id, context)"""


HEAD_EFFECTS = "SELECT row_id, context_id, context, sum(abs(d)) * sign(sum(d)) AS effect FROM sums GROUP BY row_id, context_id, context"


def head_inputs(features, ctx):
    ref = F.transform("features", lambda v: F.floor(v.cast("double") * 64).cast("double"))
    bins = features.select("row_id", "bin_idx", ref.alias("ref_features"), F.reverse(ref).alias("alt_features"))
    cells = ctx.select(F.col("celltype").alias("name")).distinct().withColumn("vector", F.array(F.length("name").cast("double"), F.lit(1.0)))
    assays = ctx.select(F.col("assay").alias("name")).distinct().withColumn("vector", F.array(F.length("name").cast("double")))
    return bins, contexts.with_context_vectors(ctx, cells, assays)


@query("fx_features", "fx_contexts", more=sql_head(), sql=HEAD_EFFECTS)
def inf_head(features, ctx):
    return inference.predict_effects(*head_inputs(features, ctx), inference.head_block(HEAD, activation="relu"))


# The same effects as blocks of seven contexts, made long again.
@query("fx_features", "fx_contexts", more=sql_head(), sql=HEAD_EFFECTS)
def inf_head_blocks(features, ctx):
    bins, catalogue = head_inputs(features, ctx)
    made = inference.predict_blocks(bins, catalogue, inference.head_block(HEAD, activation="relu"), width=7, held=14)
    return blocks.from_blocks(made, ctx, width=7)


# --- effect matrices in blocks ---------------------------------------------------------------------


def in_blocks(effects, ctx, *keys, width=8):
    return blocks.to_blocks(effects.withColumnRenamed("variant_id", "row_id"), ctx, ("row_id", *keys), width=width)


@query("fx_effects", "fx_contexts", more=MATRIX_TOPS, sql=MATRIX_NORMED)
def blk_norm_effects(effects, ctx):
    normed = blocks.from_blocks(blocks.normalise_blocks(in_blocks(effects, ctx), ctx, width=8), ctx, value="normed", width=8)
    return normed.join(ctx.select("context_id", "celltype", "assay"), "context_id").select("row_id", "celltype", "assay", F.round("normed", 10).alias("normed"))


@query("fx_gwas", "fx_effects", "fx_contexts", more=STATS, sql="SELECT locus_id, context_id, round(m, 9) AS bg_mean, round(sd, 6) AS bg_std, n AS bg_n, CASE WHEN abs(ms) < 1e-9 THEN 0e0 ELSE round(ms, 9) END AS bg_signed FROM st")
def blk_background(gwas, effects, ctx):
    background = filters.selected(stratify.stratify(gwas)).filter("var_label = 'background'").select(F.col("variant_id").alias("row_id"))
    table = in_blocks(effects, ctx, "locus_id").join(background, "row_id")
    made = blocks.background_blocks(table)
    cells = made.select("locus_id", "block", F.arrays_zip("bg_n", "bg_mean", "bg_std", "bg_signed").alias("cells")).select("locus_id", "block", F.posexplode("cells").alias("at", "c"))
    met = cells.withColumn("pos", F.col("block") * 8 + F.col("at")).filter("c.bg_n > 0").join(blocks.positions(ctx), "pos")
    return met.select("locus_id", "context_id", F.round("c.bg_mean", 9).alias("bg_mean"), F.round("c.bg_std", 6).alias("bg_std"), "c.bg_n", rounded(F.col("c.bg_signed")).alias("bg_signed"))


@query("fx_effects", "fx_contexts", sql="SELECT variant_id AS row_id, context_id, context, round(effect, 6) AS effect FROM fx_effects")
def src_matrix_blocks(effects, ctx):
    """Written wide from blocks, read as blocks of another width."""
    spark = effects.sparkSession
    path = blocks.write_blocks(in_blocks(effects, ctx), ctx, scratch(spark, "blocks"), "context_effects", width=8)
    return blocks.from_blocks(blocks.read_blocks(spark, path, ctx, width=6), ctx, width=6).withColumn("effect", F.round("effect", 6))


# --- sources: written as text from the tables, then read ------------------------------------------


def source(sql: str, *inputs: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = ctes(*inputs, duckdb=True) + " " + sql
        return f

    return register


@source("SELECT locus_id, CAST(variant_id AS VARCHAR) AS variant_id, chromosome, position, ref, alt, allele_freq, p_value, CAST(locus_id % 7 AS VARCHAR) AS batch FROM fx_gwas", "fx_gwas")
def src_gwas(spark: SparkSession, sf_dir: str, chromosome: str | None = None) -> DataFrame:
    path = scratch(spark, "gwas")
    columns = {"variant_id": "rsid", "chromosome": "chr", "position": "base_pair_location", "ref": "other_allele", "alt": "effect_allele", "allele_freq": "effect_allele_frequency", "p_value": "p"}
    df = load(spark, sf_dir, "fx_gwas").withColumnsRenamed(columns).withColumn("batch", F.col("locus_id") % 7)
    sinks.write_table(df, path, "tsv")
    return readers.read_gwas(spark, path, columns, locus_col="locus_id", chromosome=chromosome)


@source("SELECT locus_id, CAST(variant_id AS VARCHAR) AS variant_id, chromosome, position, ref, alt, allele_freq, p_value, CAST(locus_id % 7 AS VARCHAR) AS batch FROM fx_gwas WHERE chromosome = 'chr3'", "fx_gwas")
def src_gwas_chrom_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src_gwas(spark, sf_dir, "chr3")


@source("SELECT context, celltype, assay, allocation FROM fx_contexts", "fx_contexts")
def src_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "contexts")
    sinks.write_table(load(spark, sf_dir, "fx_contexts").select(F.col("context").alias("celltype_assay"), "allocation"), path, "tsv")
    return readers.read_contexts(spark, path)


@source("SELECT CAST(row_number() OVER (ORDER BY context_id) - 1 AS INTEGER) AS pos, context AS name FROM fx_contexts", "fx_contexts")
def src_name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "names")
    # The catalogue is of parameter size, and its file is one line.
    names = F.transform(F.array_sort(F.collect_list(F.struct("context_id", "context"))), lambda c: c["context"])
    load(spark, sf_dir, "fx_contexts").agg(F.array_join(names, ",,").alias("line")).write.text(path)
    return readers.read_name_list(spark, path)


@source("SELECT chrom, bin_start, bin_end, context, round(ref_signal, 6) AS signal FROM fx_signals", "fx_signals")
def src_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "fx_signals").withColumn("bin", fn.bin_key())
    path = sinks.write_matrix(df, scratch(spark, "tracks"), "ref_signals", "ref_signal", row="bin")
    return readers.read_signals(spark, path).withColumn("signal", F.round("signal", 6))


# Every table of an inference, written under its name and read back.
def _tracks_sql() -> str:
    signals = {"ref_signals": "ref_signal", "alt_signals": "alt_signal", "ref_signals_normed_and_ordered": "ref_normed", "alt_signals_normed_and_ordered": "alt_normed", "diff_signals": "diff"}
    parts = [f"SELECT '{name}' AS output, row_id, chrom, bin_start, bin_end, context, round({value}, 6) AS value FROM df" for name, value in signals.items()]
    effect = "round(sum(abs(alt_signal - ref_signal)) * CASE WHEN sum(alt_signal - ref_signal) > 0 THEN 1 WHEN sum(alt_signal - ref_signal) < 0 THEN -1 ELSE 0 END, 6)"
    parts.append(f"SELECT 'context_effects' AS output, row_id, NULL AS chrom, NULL AS bin_start, NULL AS bin_end, context, {effect} AS value FROM fx_signals GROUP BY row_id, context")
    return " UNION ALL ".join(parts)


@query("fx_signals", more=NORMED, sql=_tracks_sql())
def inf_tracks(signals):
    spark = signals.sparkSession
    paths = inference.write_inference(inference.infer_tracks(signals), scratch(spark, "inference"))
    effects = readers.read_matrix(spark, paths.pop("context_effects"), "value")
    no = F.lit(None)
    made = effects.select(F.lit("context_effects").alias("output"), "row_id", no.cast("string").alias("chrom"), no.cast("long").alias("bin_start"), no.cast("long").alias("bin_end"), "context", "value")
    for name, path in paths.items():
        named = F.split("chrom", ":", 2)
        rows = readers.read_signals(spark, path)
        made = made.unionByName(rows.select(F.lit(name).alias("output"), named[0].cast("long").alias("row_id"), named[1].alias("chrom"), "bin_start", "bin_end", "context", F.col("signal").alias("value")))
    return made.withColumn("value", F.round("value", 6))


@source("SELECT chrom, start_pos - 1 AS start0, end_pos AS end0, feature AS c3, strand AS c4 FROM fx_gtf", "fx_gtf")
def src_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "bed")
    rows = load(spark, sf_dir, "fx_gtf").select("chrom", F.col("start_pos") - 1, "end_pos", "feature", "strand")
    rows.write.csv(path, sep="\t")
    return readers.read_bed(spark, path)


@source("SELECT chromosome AS chrom, position AS start0, position + 1 AS end0, round(-log10(p_value), 9) AS score FROM fx_gwas WHERE p_value > 0", "fx_gwas")
def sink_bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "bedgraph")
    scored = load(spark, sf_dir, "fx_gwas").filter("p_value > 0").withColumn("y", F.round(fn.neg_log10("p_value"), 9))
    sinks.write_bedgraph(scored, "y", path)
    return readers.read_bed(spark, path).withColumn("c3", F.col("c3").cast("double")).withColumnRenamed("c3", "score")


@source("SELECT row_id, chromosome, position, ref, alt, position + 5 AS seq_pos FROM fx_seq_variants", "fx_seq_variants")
def src_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "variants")
    df = load(spark, sf_dir, "fx_seq_variants").select(
        F.col("chromosome").alias("CHR"), F.col("position").alias("POS"), F.lower("ref").alias("REF"), F.col("alt").alias("ALT"), (F.col("position") + 5).alias("SEQ_POS"), "row_id"
    )
    sinks.write_table(df, path, "tsv")
    return readers.read_variants(spark, path, seq_pos_col="SEQ_POS", id_col="row_id")


@source("SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, chromosome, position, ref, alt FROM fx_seq_variants", "fx_seq_variants")
def src_variants_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "variants")
    df = load(spark, sf_dir, "fx_seq_variants").select(F.col("chromosome").alias("CHR"), F.col("position").alias("POS"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), "row_id")
    # Ranges in order of the id are files in order of their names.
    sinks.write_table(df.repartitionByRange(7, "row_id").sortWithinPartitions("row_id"), path, "tsv")
    return readers.read_variants(spark, path)


@source("SELECT variant_id AS row_id, context, round(effect, 6) AS effect FROM fx_effects", "fx_effects")
def src_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "fx_effects").withColumnRenamed("variant_id", "row_id")
    path = sinks.write_matrix(df, scratch(spark, "matrix"), "context_effects", "effect")
    return readers.read_matrix(spark, path, "effect").withColumn("effect", F.round("effect", 6))


@source("SELECT chrom, start_pos - 1 AS start0, end_pos AS end0, feature, strand, regexp_extract(attribute, 'gene_id \"([^\"]+)\"', 1) AS gene_id, regexp_extract(attribute, 'gene_name \"([^\"]+)\"', 1) AS gene_name FROM fx_gtf", "fx_gtf")
def src_gtf_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "gtf")
    dot = F.lit(".")
    raw = load(spark, sf_dir, "fx_gtf").select("chrom", "source", "feature", "start_pos", "end_pos", dot.alias("score"), "strand", dot.alias("frame"), "attribute")
    raw.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in raw.columns))).write.text(path)
    return readers.read_gtf(spark, path)
