"""Mixing sources to target weights: random keys, range-sorted buckets within each source,
distributed prefix sums, and a cut at each source's exact budget.

Only DataFrame functions. Defined cases: a null text has size 0; the null source is a source of
its own, ordered last; repeated rows are separate documents; an empty table gives an empty
table; input columns other than id, text and source play no part. Documents of equal key are
ordered by id and size, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, stored


def word_count(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row per source: its size, target and exact budget in words.

    Targets fill up like water: each is weight x level, but at most ``max_repeats`` x its size.
    With the sources ordered by cap / weight, the level is the first one within its own cap, which is the largest such.
    """
    sums = sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = W.orderBy("no_source", "source")
    by_cap = W.orderBy("ratio", "no_source", "source")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    kinds = F.array(*map(F.lit, weights))
    ranked = (
        sums.withColumn("weight", F.element_at(kinds, ((F.row_number().over(by_name) - 1) % len(weights) + 1)))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))
    return ranked.withColumn("target", target).select(
        "no_source", "source", "docs", "source_size", "target",
        F.floor(F.col("target") + 0.5).cast("long").alias("budget"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 17,
    bucket_docs: int = 4096,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source_size, target and taken (words taken, repeats counted) of each document.

    A source gives whole epochs first; the rest of its budget goes to its documents in the order
    of their random keys, the last one in part. A source is cut into key ranges of about
    ``bucket_docs`` documents, each summed in its own task, so a hot source spreads over many.
    ``carry`` names further columns of ``docs`` to return.
    """
    sized = docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        word_count("text").alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("key"),
        *(F.col(c).alias(f"carry_{c}") for c in carry),
    )
    sized = stored(sized, "mix")
    source = ["no_source", "source"]
    # Small tables of their own: read back, they tell Spark their size and carry no partitioning by
    # source that would bring a hot source's ranges together again.
    plan = stored(source_targets(sized, weights, max_repeats), "mix-plan")
    share = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / float(1 << 48)
    ranges = F.greatest(F.lit(1.0), F.ceil(F.col("docs") / F.lit(float(bucket_docs))).cast("double"))
    # One row per source: the plan joins by broadcast only while Spark's own size check allows it.
    placed = sized.join(plan, source).withColumn("bucket", F.floor(share * ranges).cast("long"))
    bucket = [*source, "bucket"]
    placed = placed.repartition(*bucket)
    inside = W.partitionBy(*bucket).orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    before_bucket = W.partitionBy(*source).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    offsets = (
        placed.groupBy(*bucket)
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("offset", F.sum("bucket_size").over(before_bucket) - F.col("bucket_size"))
        .drop("bucket_size")
    )
    offsets = stored(offsets, "mix-offsets")
    before = F.col("offset") + F.col("upto") - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return (
        placed.withColumn("upto", F.sum("size").over(inside))
        .join(offsets, bucket)
        .select(
            "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
            *(F.col(f"carry_{c}").alias(c) for c in carry),
        )
    )
