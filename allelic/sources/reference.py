"""Genomes as indexed FASTA text in many files: written by all tasks, read by byte ranges.

A contig is cut into segments of a fixed number of bases. Each segment is one FASTA record in the file
of the task that wrote it, so no contig passes one task, and a line of the index (the five columns of a
.fai file, then start, segment and file) says where it is. Ranges are read by the task that needs them:
what is shuffled is where to read, never sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .scratch import stored

SEGMENT = 1 << 26  # bases in one record; a multiple of the chunk
SALTS = 16  # copies of an index line, as one contig may hold most rows
READ = 1 << 22  # bases held at once; a longer single range is read as it is
YIELD = 1 << 25  # bytes of text in one batch of results
INDEX = "contig string, length long, offset long, bases long, width long, start long, segment long, file string"


def _uri(path: str) -> str:
    """``path`` with a scheme, in the form that Arrow's file systems read."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return f"file://{path.removeprefix('file:')}"
    return path if "://" in path else f"file://{path}"


def write_reference(chunks: DataFrame, path: str, segment: int = SEGMENT, line: int = 60) -> None:
    """Writes chunks (contig, chunk_start, seq) as FASTA files and an index below ``path``.

    ``segment`` is a multiple of the chunks' length. A file is named after its attempt and counts only by the index
    lines of the attempt that ended, so a repeated task leaves an unread file and no double record.
    Null or empty sequences write nothing. A chunk that comes twice raises an error; a gap does here or when it is read.
    """
    uri = _uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{uri}/part-{task.partitionId():05d}-{task.taskAttemptId()}.fa"
        out, at, record, rest, found = None, 0, None, b"", []

        def put(text: bytes) -> None:
            nonlocal at
            out.write(text)
            at += len(text)

        def close() -> None:
            nonlocal record, rest
            if record:
                if rest:
                    put(rest + b"\n")
                found.append((record["contig"], record["length"], record["offset"], line, line + 1, record["start"], segment, name))
            record, rest = None, b""

        for batch in batches:
            for contig, start, seq in zip(*(batch.column(c).to_pylist() for c in ("contig", "chunk_start", "seq"))):
                if out is None:
                    store, file = fs.FileSystem.from_uri(name)
                    store.create_dir(file.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(file)
                if record and (record["contig"], record["start"]) != (contig, start // segment * segment):
                    close()
                if record is None:
                    first = start // segment * segment
                    put(f">{contig}".encode() + (f":{first}".encode() if first else b"") + b"\n")
                    record = {"contig": contig, "start": first, "offset": at, "length": 0}
                if start != record["start"] + record["length"] or record["length"] + len(seq) > segment:
                    raise ValueError(f"chunk of {contig} at {start} does not follow the one before it")
                record["length"] += len(seq)
                text = rest + seq.encode()
                whole = len(text) // line * line
                put(b"".join(text[i : i + line] + b"\n" for i in range(0, whole, line)))
                rest = text[whole:]
        close()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if n in (0, 7) else pa.int64()) for n, c in enumerate(zip(*found))],
                ["contig", "length", "offset", "bases", "width", "start", "segment", "file"],
            )

    held = chunks.filter("contig IS NOT NULL AND length(seq) > 0").select("contig", F.col("chunk_start").cast("long").alias("chunk_start"), "seq")
    dealt = held.repartition(_tasks(chunks.sparkSession), "contig", F.floor(F.col("chunk_start") / segment)).sortWithinPartitions("contig", "chunk_start")
    dealt.mapInArrow(run, INDEX).write.csv(f"{path}/index", sep="\t")


def _tasks(spark: SparkSession) -> int:
    """Rows here are small and what they read is large, so their partitions must not be merged by size."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@dataclass(frozen=True)
class Reference:
    """``index`` has contig, length, segment and ``segments``: file, offset, bases and width of each in order.

    The array of a contig has length / segment entries.
    """

    index: DataFrame

    def contigs(self) -> DataFrame:
        return self.index.select("contig", "length")

    def _located(self, spans: DataFrame) -> DataFrame:
        # Stored, as ranging rows samples them first: what makes them, which may read whole contigs, runs once.
        spans = stored(spans, "spans")
        salted = self.index.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"segment": "__segment", "segments": "__segments"})
        keyed = spans.withColumn("__key", F.xxhash64(*(F.col(f"`{c}`") for c in spans.columns)))
        return keyed.withColumn("__salt", F.pmod("__key", F.lit(SALTS)).cast("int")).join(salted, ["contig", "__salt"], "left")

    def cut(self, spans: DataFrame) -> DataFrame:
        """Adds ``length``, that of the contig (null: unknown), and ``text``, the bases of [from, to) that lie in it.

        Rows are ranged by where they read, and of one place by a hash, so a place that holds most rows is
        dealt to many tasks; bases that neighbours share are read once. Text is upper-case, and null where nothing is to read.
        """
        located = self._located(spans)
        low, high = F.greatest("from", F.lit(0).cast("long")), F.least("to", "length")
        first = F.floor(F.col("__low") / F.col("__segment"))
        some = F.slice("__segments", (first + 1).cast("int"), (F.floor((F.col("__high") - 1) / F.col("__segment")) - first + 1).cast("int"))
        located = located.withColumns({"__low": F.when(F.col("length").isNotNull() & F.col("from").isNotNull() & F.col("to").isNotNull(), low), "__high": high})
        reads = F.col("__low") < F.col("__high")
        located = located.withColumns({"__segments": F.when(reads, some), "__first": F.when(reads, first)}).drop("__salt")
        dealt = located.repartitionByRange(_tasks(spans.sparkSession), "contig", "__low", "__key").sortWithinPartitions("contig", "__low")
        kept = [*spans.columns, "length"]
        schema = T.StructType([*(located.schema[c] for c in kept), T.StructField("text", T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = _reader()
            for batch in batches:
                contigs, lows, highs, sizes, firsts, parts = (batch.column(c).to_pylist() for c in ("contig", "__low", "__high", "__segment", "__first", "__segments"))
                passed = batch.select(kept)
                held, texts, size, begun = (None, 0, 0, b""), [], 0, 0
                for i, contig in enumerate(contigs):
                    if parts[i] is None:
                        texts.append(None)
                    else:
                        if held[0] != contig or lows[i] < held[1] or highs[i] > held[2]:
                            end, where, j = highs[i], {}, i
                            while j < len(contigs) and contigs[j] == contig and parts[j] is not None and (j == i or (lows[j] <= end and max(end, highs[j]) - lows[i] <= READ)):
                                end = max(end, highs[j])
                                where |= {firsts[j] + k: p for k, p in enumerate(parts[j])}
                                j += 1
                            held = (contig, lows[i], end, read(where, sizes[i], lows[i], end))
                        texts.append(held[3][lows[i] - held[1] : highs[i] - held[1]].decode())
                        size += highs[i] - lows[i]
                    if size >= YIELD or i + 1 == len(contigs):
                        some = passed.slice(begun, len(texts))
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*kept, "text"])
                        texts, size, begun = [], 0, i + 1

        return dealt.mapInArrow(run, schema)

    def chunks(self, chunk: int = 16_384) -> DataFrame:
        """contig, chunk, chunk_start, seq of all contigs."""
        each = self.index.filter("length > 0").select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk))).alias("chunk"))
        spans = each.withColumn("from", F.col("chunk") * chunk).withColumn("to", F.col("from") + chunk)
        return self.cut(spans).select("contig", "chunk", F.col("from").alias("chunk_start"), F.col("text").alias("seq"))

    def edited_md5(self, edits: DataFrame) -> DataFrame:
        """Adds ``md5``, of the whole contig with [at, at + length(ref)) replaced by ``alt``.

        The contig goes through the hash range by range; the state before one edit is kept for the next one
        on the contig. Null where the contig is unknown, a field is null or REF does not lie inside.
        """
        located = self._located(edits).drop("__salt")
        dealt = located.repartitionByRange(_tasks(edits.sparkSession), "contig", "at", "__key").sortWithinPartitions("contig", "at")
        kept = edits.columns
        schema = T.StructType([*(edits.schema[c] for c in kept), T.StructField("md5", T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = _reader()

            def fed(state, where: dict, size: int, low: int, high: int):
                for at in range(low, high, READ):
                    state.update(read(where, size, at, min(at + READ, high)))
                return state

            known, done, before = None, 0, hashlib.md5()
            for batch in batches:
                made = []
                for contig, length, size, parts, at, ref, alt in zip(*(batch.column(c).to_pylist() for c in ("contig", "length", "__segment", "__segments", "at", "ref", "alt"))):
                    if None in (length, at, ref, alt) or at < 0 or at + len(ref) > length:
                        made.append(None)
                        continue
                    where = dict(enumerate(parts))
                    if contig != known or at < done:
                        known, done, before = contig, 0, hashlib.md5()
                    before, done = fed(before, where, size, done, at), at
                    state = before.copy()
                    state.update(alt.encode())
                    made.append(fed(state, where, size, at + len(ref), length).hexdigest())
                yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(made, pa.string())], [*kept, "md5"])

        return dealt.mapInArrow(run, schema)


def _reader():
    """A function that reads bases [low, high) of a contig whose segments by number are ``where``; one file stays open."""
    name, file = None, None

    def read(where: dict[int, dict], segment: int, low: int, high: int) -> bytes:
        nonlocal name, file
        got = []
        while low < high:
            k = low // segment
            part, end = where[k], min(high, (k + 1) * segment)
            if part["file"] != name:
                if file is not None:
                    file.close()
                store, path = fs.FileSystem.from_uri(part["file"])
                name, file = part["file"], store.open_input_file(path)
            first, last = (part["offset"] + p // part["bases"] * part["width"] + p % part["bases"] for p in (low - k * segment, end - 1 - k * segment))
            file.seek(first)
            got.append(file.read(last + 1 - first).translate(None, b"\r\n"))
            low = end
        return b"".join(got).upper()

    return read


def open_reference(spark: SparkSession, path: str) -> Reference:
    """What ``write_reference`` wrote below ``path``; a contig with a gap raises an error when it is read."""
    lines = spark.read.csv(f"{path}/index", sep="\t", schema=INDEX)
    parts = F.array_sort(F.collect_list(F.struct("start", "file", "offset", "bases", "width")))
    last = F.max(F.struct("start", "length"))
    whole = lines.groupBy("contig").agg(F.sum("length").alias("sum"), last.alias("last"), F.first("segment").alias("segment"), parts.alias("segments"))
    gap = F.raise_error(F.concat(F.lit("gap in contig "), "contig")).cast("long")
    length = F.when(F.col("sum") == F.col("last.start") + F.col("last.length"), F.col("sum")).otherwise(gap)
    return Reference(whole.select("contig", length.alias("length"), "segment", "segments"))


def open_fasta(spark: SparkSession, fasta: str, fai: str) -> Reference:
    """One FASTA file with the usual index; a contig is one segment."""
    uri = _uri(fasta)
    lines = spark.read.csv(fai, sep="\t", schema="contig string, length long, offset long, bases long, width long").filter("length > 0")
    part = F.struct(F.lit(0).cast("long").alias("start"), F.lit(uri).alias("file"), "offset", "bases", "width")
    return Reference(lines.select("contig", "length", F.col("length").alias("segment"), F.array(part).alias("segments")))
