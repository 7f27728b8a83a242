"""Effect matrices in blocks: a row and a run of contexts as one array, so that tens of thousands of
contexts need no line for each cell.

A table of blocks has key columns, ``block`` and ``values``: the value of the context at position
``block * width + i`` stands at place i, null where there is none. Positions come from ``positions``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType

WIDTH = 512


def without_nan(values: str) -> Column:
    return F.transform(values, lambda x: F.when(~F.isnan(x), x))


def positions(contexts: DataFrame) -> DataFrame:
    """The catalogue with ``pos``, from 0 in order of context_id; it is of parameter size, so one task numbers it."""
    return contexts.withColumn("pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("context_id")) - 1)


@F.pandas_udf(ArrayType(DoubleType()))
def _dense(places: pd.Series, values: pd.Series, width: pd.Series) -> pd.Series:
    def one(at, found, n):
        made = np.full(n, np.nan)
        made[np.asarray(at, int)] = np.asarray(found, float)
        return made

    return pd.Series([one(*x) for x in zip(places, values, width)])


def to_blocks(effects: DataFrame, contexts: DataFrame, keys: tuple[str, ...] = ("row_id",), value: str = "effect", width: int = WIDTH) -> DataFrame:
    """Blocks of long rows (keys, context, value). Of repeated cells the largest counts; contexts that the catalogue
    lacks and null contexts are dropped; blocks without a cell are absent."""
    at = effects.select(*keys, "context", F.col(value).cast("double").alias("__value")).join(positions(contexts).select("context", "pos"), "context")
    cells = at.groupBy(*keys, F.floor(F.col("pos") / width).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("pos") % width).alias("at"), F.col("__value").alias("value")))).alias("cells")  # null values first
    )
    placed = cells.select(*keys, "block", _dense(F.col("cells.at"), F.col("cells.value"), F.lit(width)).alias("values"))
    return placed.withColumn("values", without_nan("values"))


def from_blocks(table: DataFrame, contexts: DataFrame, keys: tuple[str, ...] = ("row_id",), value: str = "effect", width: int = WIDTH) -> DataFrame:
    """Long rows (keys, context_id, context, value) of the cells that are not null."""
    long = table.select(*keys, "block", F.posexplode("values").alias("__at", value)).filter(F.col(value).isNotNull())
    long = long.withColumn("pos", F.col("block") * width + F.col("__at"))
    return long.join(positions(contexts).select("context_id", "context", "pos"), "pos").select(*keys, "context_id", "context", value)


def normalise_blocks(table: DataFrame, contexts: DataFrame, small_max: float = 0.6, squared: str = "RNA-seq", width: int = WIDTH) -> DataFrame:
    """``scoring.normalise_effects`` on blocks of (row_id, block): each effect over its assay's maximum within the row, unless
    that is small, squared for assays whose name holds ``squared``. Only maxima of a row's assays are shuffled beside the blocks."""
    # For each block one line, with the assay of every place: of catalogue size.
    named = positions(contexts).select(F.floor(F.col("pos") / width).cast("int").alias("block"), (F.col("pos") % width).alias("at"), "assay")
    assays = named.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "assay"))), lambda x: x["assay"]).alias("assays"))
    pairs = table.join(assays, "block").select("row_id", "block", F.arrays_zip("values", "assays").alias("cells"), F.array_compact(F.array_distinct("assays")).alias("names"))
    best = F.transform("names", lambda a: F.struct(a.alias("assay"), F.array_max(F.transform(F.filter("cells", lambda c: c["assays"] == a), lambda c: c["values"])).alias("top")))
    tops = pairs.select("row_id", F.explode(best).alias("t")).groupBy("row_id", "t.assay").agg(F.max("t.top").alias("top"))
    tops = tops.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("assay", "top"))).alias("tops"))

    def normed(c):
        top = F.col("tops")[c["assays"]]
        scaled = c["values"] / F.when(top < small_max, F.lit(1.0)).otherwise(top)
        return F.when(c["assays"].contains(squared), scaled * scaled).otherwise(scaled)

    met = pairs.join(tops, "row_id")
    return met.select("row_id", "block", F.transform(F.filter("cells", lambda c: c["assays"].isNotNull()), normed).alias("values"))


MOMENTS = "locus_id long, block int, n array<double>, mean array<double>, m2 array<double>, signed array<double>"


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Count, mean, squared deviations and mean of the signed values of two parts together, place by place."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    step = b[1] - a[1]
    return [n, a[1] + step * share, a[2] + b[2] + step * step * a[0] * share, a[3] + (b[3] - a[3]) * share]


def background_blocks(table: DataFrame, parts: int = 16, groups: int = 256) -> DataFrame:
    """Of blocks with locus_id, by locus and block: arrays bg_n, bg_mean and bg_std (population) of the sizes of the values, and
    bg_signed, their mean; null where no value is. Give it background rows.

    Tasks add up blocks as they come, at most ``groups`` loci and blocks at a time, and a hot locus is merged in ``parts`` first.
    """

    def frame(held: dict):
        keys = pd.DataFrame(list(held), columns=["locus_id", "block"])
        return keys.assign(**{name: [x[i] for x in held.values()] for i, name in enumerate(("n", "mean", "m2", "signed"))})

    def collected(batches, moments):
        held: dict = {}
        for pdf in batches:
            for key, found in moments(pdf):
                if key not in held and len(held) >= groups:
                    yield frame(held)
                    held = {}
                held[key] = _merged(held[key], found) if key in held else found
        if held:
            yield frame(held)

    def first(batches):
        def moments(pdf):
            for key, some in pdf.groupby(["locus_id", "block"], sort=False):
                x = np.stack([np.asarray(v, float) for v in some["values"]])
                here = ~np.isnan(x)
                n = here.sum(axis=0).astype(float)
                least = np.maximum(n, 1)
                mean, signed = np.where(here, np.abs(x), 0).sum(axis=0) / least, np.where(here, x, 0).sum(axis=0) / least
                yield key, [n, mean, (np.where(here, np.abs(x) - mean, 0) ** 2).sum(axis=0), signed]

        return collected(batches, moments)

    def again(batches):
        def moments(pdf):
            for r in pdf.itertuples(index=False):
                yield (r.locus_id, r.block), [np.asarray(x, float) for x in (r.n, r.mean, r.m2, r.signed)]

        return collected(batches, moments)

    partial = table.select("locus_id", "block", "values").filter("locus_id IS NOT NULL AND values IS NOT NULL").mapInPandas(first, MOMENTS)
    salted = partial.withColumn("part", F.spark_partition_id() % parts).repartition("locus_id", "block", "part").sortWithinPartitions("locus_id", "block", "part")
    merged = salted.drop("part").mapInPandas(again, MOMENTS)
    whole = merged.repartition("locus_id", "block").sortWithinPartitions("locus_id", "block").mapInPandas(again, MOMENTS)
    present = lambda c: F.zip_with(c, "n", lambda x, n: F.when(n > 0, x))
    return whole.select(
        "locus_id", "block", F.transform("n", lambda n: n.cast("long")).alias("bg_n"), present("mean").alias("bg_mean"),
        F.zip_with("m2", "n", lambda s, n: F.when(n > 0, F.sqrt(s / n))).alias("bg_std"), present("signed").alias("bg_signed"),
    )


def write_blocks(table: DataFrame, contexts: DataFrame, prefix: str, name: str, width: int = WIDTH) -> str:
    """Blocks of (row_id, block) as the wide matrix ``prefix.name`` with a column for each context in order of positions,
    and its path. A row's arrays meet in one line; each file begins with the header."""
    names = [r["context"] for r in positions(contexts).orderBy("pos").collect()]  # the header
    last = -(-len(names) // width)
    held = table.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "values"))).alias("held"))
    empty = F.array_repeat(F.lit(None).cast("double"), width)
    values = F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max(last - 1, 0))), lambda b: F.coalesce(F.col("held")[b], empty))), 1, max(len(names), 1))
    line = F.concat_ws("\t", F.col("row_id").cast("string"), F.array_join(values.cast("array<string>"), "\t", ""))
    path = f"{prefix}.{name}"
    plain = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    held.sortWithinPartitions("row_id").select(line.alias("\t".join(["row_id", *names]))).write.mode("overwrite").options(header=True, **plain).csv(path)
    return path


def read_blocks(spark: SparkSession, path: str, contexts: DataFrame, width: int = WIDTH) -> DataFrame:
    """A wide matrix with row_id first as blocks, whatever the order of its columns; those that the catalogue lacks are dropped,
    those that the file lacks are null."""
    plain = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines = spark.read.options(header=True, **plain).csv(path)
    header = spark.createDataFrame(list(enumerate(lines.columns[0].split("\t")))[1:], "place int, context string")
    placed = positions(contexts).join(header, "context", "left")
    of_block = placed.groupBy(F.floor(F.col("pos") / width).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "place"))).alias("places"))
    order = of_block.agg(F.collect_list(F.struct("block", F.col("places.place").alias("place"))).alias("order"))  # one row of catalogue size
    rows = lines.select(F.split(F.col(f"`{lines.columns[0]}`"), "\t", -1).alias("cells")).crossJoin(F.broadcast(order))
    rows = rows.select(F.get("cells", F.lit(0)).cast("long").alias("row_id"), "cells", F.explode("order").alias("o"))
    return rows.select("row_id", "o.block", F.transform("o.place", lambda i: F.get("cells", i).try_cast("double")).alias("values"))
