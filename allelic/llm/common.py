"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import removed, scratch  # noqa: F401  (operators take it from here)

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handled at once inside a Python task; bounds the Python objects alive.
SLICE_ROWS = 256
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Meanwhile Arrow batches hold few rows, ``batch_rows``, as texts may be long.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, min(int(before), batch_rows) if int(before) > 0 else batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list], list]],
    fields: list[T.StructField],
    text_col: str = "text",
) -> DataFrame:
    """``df`` with columns computed from whole texts in Arrow batches.

    ``make`` runs once in each task and returns a function from a list of texts to one list for
    each of ``fields``. Columns of ``df`` that bear the name of a result column are replaced.
    """
    names = [f.name for f in fields]
    kept = df.select(*[c for c in df.columns if c not in names])
    at = kept.columns.index(text_col)
    schema = T.StructType([*kept.schema.fields, *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        compute = make()
        for part in sliced(batches):
            made = compute(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))],
                names=[*part.schema.names, *names],
            )

    return kept.mapInArrow(run, schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
