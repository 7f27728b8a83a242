"""Overlap of annotations and windows, and annotation tables for plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import stored

BIN = 131_072
LEVELS = 5  # bins of 2^17, 2^21, 2^25, 2^29 and 2^33 bases
SALTS = 16


def overlap_join(intervals: DataFrame, windows: DataFrame, width: int = BIN, levels: int = LEVELS) -> DataFrame:
    """Rows of ``intervals`` (chrom, start0, end0, ...) with the windows (win_id, chrom, win_start,
    win_end) that they overlap; both half-open and 0-based.

    Each row lies in bins of the finest of ``levels`` whose width, ``width`` times a power of 16, is at least its
    length: in one or two, however long it is. Rows meet by equality of bins at the coarser level of the two, for
    which a row also asks the bins of those coarser levels that the other side has; of two shared bins the first counts,
    so each pair comes once and no pass removes duplicates. As many rows ask one coarse bin, those that lie
    in it are copied ``SALTS`` times and those that ask are dealt among the copies. Rows with a null place meet nothing.
    """

    def own(start: str, end: str):
        length = F.greatest(F.col(end) - F.col(start), F.lit(1))
        level = F.lit(levels - 1)
        for n in reversed(range(levels - 1)):
            level = F.when(length <= width * 16**n, n).otherwise(level)
        return level

    def keyed(df: DataFrame, start: str, end: str, present: DataFrame, asks: int) -> DataFrame:
        # Kind 0: windows of a level at least that of the interval; kind 1: intervals of a higher one, so not of the finest.
        pair = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("level"))
        lies = F.filter(F.array(pair(1 - asks, F.col("__own"))), lambda x: x["level"] >= 1 - asks)
        asked = F.transform(F.filter("__present", lambda n: n > F.col("__own") if asks else n >= F.col("__own")), lambda n: pair(asks, n))
        size = F.lit(float(width)) * F.pow(F.lit(16.0), F.col("__at.level"))  # whole below 2^53
        first = F.floor(F.col(start) / size)
        dealt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(SALTS)).cast("int")
        salt = F.when(F.col("__at.level") == 0, F.array(F.lit(0))).when(F.col("__at.kind") == asks, F.array(dealt)).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = df.withColumn("__own", own(start, end)).crossJoin(F.broadcast(present))  # one row of at most ``levels`` numbers
        found = found.withColumn("__at", F.explode(F.concat(lies, asked))).withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, F.floor((F.col(end) - 1) / size)))))
        return found.withColumn("__salt", F.explode(salt)).drop("__own", "__present")

    win = windows.select("win_id", "chrom", "win_start", "win_end")
    of_intervals = intervals.agg(F.collect_set(own("start0", "end0")).alias("__present"))
    of_windows = win.agg(F.collect_set(own("win_start", "win_end")).alias("__present"))
    met = keyed(intervals, "start0", "end0", of_windows, 0).join(keyed(win, "win_start", "win_end", of_intervals, 1), ["chrom", "__at", "__bin", "__salt"])
    overlaps = (F.col("start0") < F.col("win_end")) & (F.col("end0") > F.col("win_start"))
    size = F.lit(float(width)) * F.pow(F.lit(16.0), F.col("__at.level"))
    first = F.col("__bin") == F.floor(F.greatest("start0", "win_start") / size)
    return met.filter(overlaps & first).drop("__at", "__bin", "__salt")


def _in_ranges(df: DataFrame, by: str, *order: Column) -> DataFrame:
    """``df`` with ``__part``: numbers that rise with ``order`` within ``by``. A group of any size lies in as many parts as its
    share of all rows asks for; the table is written, as a second run of the sort might draw other bounds."""
    ranged = df.repartitionByRange(F.asc(by), *order).withColumn("__part", F.spark_partition_id())
    return stored(ranged, "ranges")


def annotation_lanes(intervals: DataFrame, by: str = "win_id") -> DataFrame:
    """Adds ``lane``: each gene takes the next lane, rows of one gene name in succession share one.

    A window's rows are dealt in ranges; each is scanned by itself, and what a range takes over from those before it, their
    number of lanes and the last gene's name, comes from one line for each range. A null window is one of its own.
    """
    order = [F.asc(c) for c in ("start0", "end0", "gene_name", "gene_id")]
    parts = _in_ranges(intervals, by, *order)
    within = W.partitionBy(by, "__part").orderBy(*order)
    starts = lambda last: (last.isNull() | (last != F.col("gene_name")) | (F.col("feature") == "gene")).cast("int")
    scanned = parts.withColumn("__at", F.row_number().over(within))
    # The first row of a range waits for the range before it.
    scanned = scanned.withColumn("__sum", F.sum(F.when(F.col("__at") > 1, starts(F.lag("gene_name").over(within)))).over(within.rowsBetween(W.unboundedPreceding, 0)))
    ends = scanned.groupBy(by, "__part").agg(
        F.max("__sum").alias("__own"), F.max_by("gene_name", "__at").alias("__last"), F.min_by("gene_name", "__at").alias("gene_name"), F.min_by("feature", "__at").alias("feature")
    )
    ranges = W.partitionBy(by).orderBy("__part")
    ends = ends.withColumn("__first", F.coalesce(starts(F.lag("__last").over(ranges)), F.lit(0)))
    ends = ends.withColumn("__total", F.sum(F.col("__first") + F.coalesce("__own", F.lit(0))).over(ranges.rowsBetween(W.unboundedPreceding, 0)))
    ends = ends.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), (F.col("__total") - F.coalesce("__own", F.lit(0))).alias("__carried"))
    met = scanned.join(ends, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    lane = F.col("__carried") + F.coalesce("__sum", F.lit(0))
    return met.withColumn("lane", lane.cast("long")).drop("__part", "__at", "__sum", "__by", "__p", "__carried")


def order_points(df: DataFrame, by: str = "frequency", label: str = "var_label", value: str = "p_value", reverse: bool = False) -> DataFrame:
    """Adds ``point_order`` within each locus: by frequency of the label, or by the value.

    A locus is dealt in ranges, which are numbered by themselves and begin after the count of those before them. By frequency, rows
    with a null label stand with their own count.
    """
    if by == "frequency":
        counts = df.groupBy(F.col("locus_id").alias("__locus"), F.col(label).alias("__label")).agg(F.count("*").alias("__freq"))
        df = df.join(counts, F.col("locus_id").eqNullSafe(F.col("__locus")) & F.col(label).eqNullSafe(F.col("__label"))).drop("__locus", "__label")
        keys = [F.asc("__freq") if reverse else F.desc("__freq"), F.asc(label), F.asc("variant_id")]
    else:
        keys = [F.desc(value) if reverse else F.asc(value), F.asc("variant_id"), F.asc(label)]
    parts = _in_ranges(df, "locus_id", *keys)
    sizes = parts.groupBy(F.col("locus_id").alias("__locus"), F.col("__part").alias("__p")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(W.partitionBy("__locus").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0)))
    met = parts.join(sizes, F.col("locus_id").eqNullSafe(F.col("__locus")) & (F.col("__part") == F.col("__p")))
    own = F.row_number().over(W.partitionBy("locus_id", "__part").orderBy(*keys))
    return met.withColumn("point_order", (F.col("__before") + own).cast("int")).drop("__freq", "__part", "__locus", "__p", "__size", "__before")
