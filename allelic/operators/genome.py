"""Sequence windows: reference chunks, validation, REF and ALT windows around variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import splice
from ..sources.reference import Reference

CHUNK = 16_384


def chunked(contigs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """contig, chunk, chunk_start, seq of whole contigs (contig, seq), upper-cased."""
    n = F.floor((F.length("seq") - 1) / chunk)
    rows = contigs.filter(F.length("seq") > 0).select("contig", F.upper("seq").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("chunk"))
    start = F.col("chunk") * chunk
    return rows.select("contig", "chunk", start.alias("chunk_start"), F.substring("whole", (start + 1).cast("int"), F.lit(chunk)).alias("seq"))


def _pieces(spans: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """row_id and the text of [from, to) put together from the chunks it touches.

    ``spans`` is (row_id, contig, from, to) inside the contig; rows without text are left out.
    """
    touched = F.explode(F.sequence(F.floor(F.col("from") / chunk), F.floor((F.col("to") - 1) / chunk)))
    parts = spans.filter("to > from").withColumn("chunk", touched).join(reference, ["contig", "chunk"])
    first = F.greatest(F.col("from") - F.col("chunk_start"), F.lit(0))
    last = F.least(F.col("to") - F.col("chunk_start"), F.length("seq"))
    parts = parts.withColumn("part", F.substring("seq", (first + 1).cast("int"), (last - first).cast("int")))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "part")))
    return parts.groupBy("row_id").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("text"))


def validate_variants(variants: DataFrame, reference: DataFrame | Reference, index_base: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Adds ``found_ref`` and ``status`` (ok, mismatch, outside); reads only the bases of REF, from
    chunks or from the files of a ``Reference``."""
    at = F.col("position") - index_base
    if isinstance(reference, Reference):
        spans = variants.select(F.struct(*(F.col(f"`{c}`") for c in variants.columns)).alias("v"), F.col("chromosome").alias("contig"), at.alias("from"), (at + F.length("ref")).alias("to"))
        found = reference.cut(spans).select("v.*", F.col("text").alias("found_ref"))
        return found.withColumn("status", _status())
    spans = variants.select("row_id", F.col("chromosome").alias("contig"), F.greatest(at, F.lit(0)).alias("from"), (at + F.length("ref")).alias("to"))
    found = _pieces(spans, reference, chunk).withColumnRenamed("text", "found_ref")
    return variants.join(found, "row_id", "left").withColumn("status", _status())


def _status() -> Column:
    short = F.col("found_ref").isNull() | (F.length("found_ref") < F.length("ref"))
    return F.when(short, "outside").when(F.col("found_ref") == F.upper("ref"), "ok").otherwise("mismatch")


def validation_report(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("n_checked"), F.coalesce(F.sum((F.col("status") != "ok").cast("long")), F.lit(0)).alias("n_incorrect"))


def _cut(seq: Column, over: Column, window: int) -> Column:
    """Text that is longer than the window by ``over`` loses floor(over/2) on the left and ceil(over/2) on the right."""
    return F.when(over > 0, F.substring(seq, F.floor(over / 2).cast("int") + 1, F.lit(window))).otherwise(seq)


def window_text(variants: DataFrame, reference: DataFrame | Reference, contigs: DataFrame | None = None, window: int = 196_608, index_base: int = 0, chunk: int = CHUNK) -> DataFrame:
    """row_id, chrom, ref, alt, pos0, window_start (0-based) and ``seq``, the genome's text around each
    variant: centred on seq_pos where the table has it, else on the position, padded with N outside
    the contig. ``reference`` is a ``Reference``, whose files are read where the windows are cut, or
    a table of chunks with the table of ``contigs``."""
    return _windows(variants, reference, contigs, window, index_base, chunk).withColumn("seq", F.col("seq").cast("string"))


def _windows(variants: DataFrame, reference: DataFrame | Reference, contigs: DataFrame | None, window: int, index_base: int, chunk: int) -> DataFrame:
    """``window_text`` with ``seq`` as the type that cuts it fastest: bases of files are bytes, where a place
    is found without a walk over all characters before it; chunks are text."""
    center = F.coalesce("seq_pos", "position") if "seq_pos" in variants.columns else F.col("position")
    v = variants.select(
        "row_id", F.col("chromosome").alias("contig"), (F.col("position") - index_base).alias("pos0"), F.upper("ref").alias("ref"),
        F.upper("alt").alias("alt"), (center - index_base - window // 2).alias("window_start"),
    )
    if isinstance(reference, Reference):
        v = reference.cut(v.withColumn("from", F.col("window_start")).withColumn("to", F.col("window_start") + window))
        v = v.withColumn("text", F.col("text").cast("binary"))
    else:
        v = v.join(contigs.select("contig", "length"), "contig", "left")
        v = v.withColumn("from", F.greatest(F.col("window_start"), F.lit(0))).withColumn("to", F.least(F.col("window_start") + window, F.col("length")))
        v = v.join(_pieces(v.select("row_id", "contig", "from", "to"), reference, chunk), "row_id", "left")
    kind = v.schema["text"].dataType
    pad = lambda n: F.substring(F.lit("N" * window).cast(kind), F.lit(1), F.greatest(F.lit(0), F.least(n, F.lit(window))).cast("int"))
    body = F.coalesce("text", F.lit("").cast(kind))
    left = F.least(F.greatest(-F.col("window_start"), F.lit(0)), F.lit(window))
    whole = F.concat(pad(left), body, pad(F.lit(window) - left - F.length(body)))
    return v.select("row_id", F.col("contig").alias("chrom"), "ref", "alt", "pos0", "window_start", F.when(F.col("length").isNotNull(), whole).alias("seq"))


def build_windows(variants: DataFrame, reference: DataFrame | Reference, contigs: DataFrame | None = None, window: int = 196_608, index_base: int = 0, correct_ref: bool = False, chunk: int = CHUNK) -> DataFrame:
    """row_id, chrom, window_start (0-based), ref_seq, alt_seq and status of each variant.

    ``status`` is ok, mismatch (REF differs from the genome; with ``correct_ref`` REF is written in
    and the status is corrected) or outside (REF does not lie in the window, or the contig is unknown). The sequences are
    null unless the status is ok or corrected.
    """
    v = _windows(variants, reference, contigs, window, index_base, chunk).withColumn("at", F.col("pos0") - F.col("window_start"))
    ref, alt = (F.col(c).cast(v.schema["seq"].dataType) for c in ("ref", "alt"))
    inside = F.coalesce(F.col("seq").isNotNull() & (F.col("at") >= 0) & (F.col("at") + F.length("ref") <= window), F.lit(False))
    same = F.substring("seq", (F.col("at") + 1).cast("int"), F.length(ref)) == ref
    status = F.when(~inside, "outside").when(same, "ok").otherwise("corrected" if correct_ref else "mismatch")
    usable = inside & (same | F.lit(correct_ref))
    ref_seq = F.when(usable, F.when(same, F.col("seq")).otherwise(splice("seq", "at", ref, ref)))
    # A window is as long as it should be, so the two alleles say how much longer the other one is.
    alt_seq = F.when(usable, _cut(splice("seq", "at", ref, alt), F.length(alt) - F.length(ref), window))
    return v.select("row_id", "chrom", "window_start", ref_seq.cast("string").alias("ref_seq"), alt_seq.cast("string").alias("alt_seq"), status.alias("status"))
