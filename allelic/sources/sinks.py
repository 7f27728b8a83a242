"""Writers: long tables as Parquet, wide matrices and tables as TSV, scores as bedGraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import stored


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "none") -> None:
    """``fmt`` parquet, or tsv with a header, whose text may be compressed."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", compression=compression)


def matrix_lines(df: DataFrame, value: str, row: str = "row_id", column: str = "context", columns: list[str] | None = None) -> DataFrame:
    """One text line for each row of the wide matrix of a long table.

    No pivot: a row's values are gathered and sorted, so the number of columns is not limited.
    With ``columns`` given, missing cells are empty and that order holds.
    """
    if columns is None:
        cells = F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))))
        joined = F.array_join(F.transform(cells, lambda x: x["v"]), "\t")
    else:
        held = F.map_from_entries(F.collect_list(F.struct(F.col(column), F.coalesce(F.col(value).cast("string"), F.lit("")))))
        # Bound as ``m``, or a row's map would be made again for each of its columns.
        cells = lambda m: F.transform(F.array(*map(F.lit, columns)), lambda c: F.coalesce(m[c], F.lit("")))
        joined = F.array_join(F.get(F.transform(F.array(held), cells), F.lit(0)), "\t")
    return df.groupBy(row).agg(joined.alias("cells")).select(row, F.concat_ws("\t", F.col(row).cast("string"), "cells").alias("line"))


def _write_lines(lines: DataFrame, row: str, names: list[str], path: str, compression: str = "none") -> str:
    """Rows (key, line) as text, sorted within a file.

    The header is the first line of every file, as readers of a folder drop the first line of each;
    rows stay where they were gathered, so each file is sorted and the files are not.
    """
    held = lines.sortWithinPartitions(row).select(F.col("line").alias("\t".join([row, *names])))
    # A line is the only column of a CSV file whose separator and quote no text holds.
    plain = {"sep": "\u0001", "quote": "\u0000", "escape": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    held.write.mode("overwrite").options(header=True, compression=compression, **plain).csv(path)
    return path


def _names(df: DataFrame, column: str) -> list[str]:
    """The header: one name a column."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def write_matrix(df: DataFrame, prefix: str, name: str, value: str, row: str = "row_id", column: str = "context", columns: list[str] | None = None, compression: str = "none") -> str:
    """Writes ``prefix.name`` as text and returns the path."""
    names = columns or _names(df, column)
    return _write_lines(matrix_lines(df, value, row, column, names), row, names, f"{prefix}.{name}", compression)


def write_matrices(df: DataFrame, prefix: str, values: dict[str, str], keys: tuple[str, ...], row: str, column: str = "context", columns: list[str] | None = None) -> dict[str, str]:
    """Writes ``prefix.name`` for each of ``values``, names of matrices with the column of their values, and returns the paths.

    Cells are gathered once for all of them, by typed ``keys``, which joined by colons name the ``row``; they become text when written.
    """
    names = columns or _names(df, column)
    return write_gathered(gathered(df, list(values.values()), keys, column), prefix, values, keys, row, dict(zip(names, names)))


def gathered(df: DataFrame, values: list[str], keys: tuple[str, ...], column: str) -> DataFrame:
    """A stored row for each of ``keys`` with ``cells``: a map of its values by ``column``."""
    cells = F.map_from_entries(F.collect_list(F.struct(F.col(column), F.struct(*values))))
    return stored(df.groupBy(*keys).agg(cells.alias("cells")), "matrix")


def write_gathered(rows: DataFrame, prefix: str, values: dict[str, str], keys: tuple[str, ...], row: str, columns: dict, compression: str = "none") -> dict[str, str]:
    """Writes ``prefix.name`` for each of ``values`` from ``gathered`` rows; ``columns`` has the names of the columns, with the keys of their cells."""
    named = F.concat_ws(":", *(F.col(k).cast("string") for k in keys)).alias(row)
    held = F.transform(F.array(*map(F.lit, columns.values())), lambda c: F.col("cells")[c])
    paths = {}
    for name, value in values.items():
        text = F.array_join(F.transform(F.transform(held, lambda x: x[value].cast("string")), lambda x: F.coalesce(x, F.lit(""))), "\t")  # noqa: B023
        lines = rows.select(named, text.alias("text")).select(row, F.concat_ws("\t", row, "text").alias("line"))
        paths[name] = _write_lines(lines, row, list(columns), f"{prefix}.{name}", compression)
    return paths


def bedgraph_rows(df: DataFrame, score: str) -> DataFrame:
    return df.select(F.col("chromosome").alias("chrom"), F.col("position").alias("start"), (F.col("position") + 1).alias("end"), F.col(score).alias("score"))


def write_bedgraph(df: DataFrame, score: str, path: str) -> None:
    rows = bedgraph_rows(df, score)
    rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end").write.mode("overwrite").csv(path, sep="\t")
