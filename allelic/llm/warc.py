"""WARC archives: segmented, chunk-framed records out, and their reassembly back in.

Writing: each task writes archives (a gzip member for each record) to the shared folder under
names of its own and returns their names; only archives named in the written manifest are read,
so a repeated or lost task leaves at most unread files. Reading: archives are streamed record by
record; continuation records are brought together by origin id and ordered by segment number in
a shuffle, the total length is verified, and chunked transfer framing is decoded.

Defined cases: a null payload is an empty one; a page id that occurs in several rows gives one
record for each row; of equal payloads all rows with the largest page id are responses; an empty
table gives an empty table; input columns other than page id, url and html play no part. A
record whose segments are incomplete, repeated with other content, of the wrong total length or
badly framed comes back with ``complete`` false and the bytes that could be read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import scratch, sliced, stored

DATE = "2024-01-01T00:00:00Z"  # fixed, so that reruns write equal records
SEGMENT = "segment int, total long, kind string, target string, refers_to string, digest string, block binary"


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def chunked(payload: bytes, size: int) -> bytes:
    parts = (payload[i : i + size] for i in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> tuple[bytes, bool]:
    """The payload of a chunked body, and whether its framing is whole."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            n = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0:
            return b"".join(parts), False
        at = end + 2
        if n == 0:
            return b"".join(parts), True
        parts.append(body[at : at + n])
        if body[at + n : at + n + 2] != b"\r\n":
            return b"".join(parts), False
        at += n + 2


def records_of(key: str, uri: str, payload: bytes, digest: str, refers: str | None, segment: int, chunk: int):
    """The records of one page: a response in segments, or one revisit without payload."""
    kind = "revisit" if refers else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers:
        block = http + b"X-Payload-Length: %d\r\n\r\n" % len(payload)
    else:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    own = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{key}>"), *shared]
    own += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers:
        own += [("WARC-Refers-To", refers), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    if len(block) <= segment:
        yield record(own, block)
        return
    yield record([*own, ("WARC-Segment-Number", 1)], block[:segment])
    count = -(-len(block) // segment)
    for i in range(1, count):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *shared]
        more += [("WARC-Segment-Origin-ID", f"<urn:uuid:{key}>"), ("WARC-Segment-Number", i + 1)]
        if i == count - 1:
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield record(more, block[i * segment : (i + 1) * segment])


def write_archives(pages: DataFrame, segment: int = 16384, chunk: int = 4096, roll: int = 64 << 20) -> DataFrame:
    """Archives of ``pages`` (page_id, uri, html, digest, refers); returns their written manifest.

    ``segment`` bounds a record's block, ``chunk`` a chunk of the framing, ``roll`` an archive.
    """
    folder = scratch(pages.sparkSession, "warc")
    pages = pages.select("page_id", "uri", F.col("html").cast("binary").alias("html"), "digest", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, done, count, size = None, [], 0, 0
        for part in sliced(batches):
            for page, uri, html, digest, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                key = f"{uuid.uuid4()}"
                for data in records_of(key, f"{uri or ''}", html or b"", digest, refers, segment, chunk):
                    member = gzip.compress(data, 1, mtime=0)
                    out.write(member)
                    count, size = count + 1, size + len(member)
                if size >= roll:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            names=["archive", "records", "bytes"],
        )

    return stored(pages.mapInArrow(run, "archive string, records long, bytes long"), "warc-manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            rest = rest or stream.read(size)
            if not rest:
                if parts:
                    raise EOFError("archive ends inside a record")
                return
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    head, _, body = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = headers["WARC-Type"]
    total = headers.get("WARC-Segment-Total-Length")
    return (
        headers["WARC-Segment-Origin-ID" if kind == "continuation" else "WARC-Record-ID"],
        int(headers.get("WARC-Segment-Number", 0)),
        int(total) if total else None,
        kind,
        headers.get("WARC-Target-URI"),
        headers.get("WARC-Refers-To"),
        headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
        body[: int(headers["Content-Length"])],
    )


def payload_of(segments: list[tuple]) -> tuple:
    """From (origin, segment, total, kind, uri, refers, digest, block) of each segment: kind, uri,
    refers, digest in the header, payload, its length and digest, segments, complete."""
    segments = sorted(set(segments), key=lambda s: s[1])
    first = segments[0]
    block = b"".join(s[7] for s in segments)
    numbers = [s[1] for s in segments]
    total = segments[-1][2]
    whole = first[3] != "continuation" and (
        (numbers == [0] and total is None) or (numbers == list(range(1, len(numbers) + 1)) and total == len(block))
    )
    http, _, body = block.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:] if b": " in line)
    if first[3] == "revisit":
        return *first[3:7], None, int(fields.get(b"X-Payload-Length", 0)), first[6], len(segments), whole
    framed = True
    if fields.get(b"Transfer-Encoding") == b"chunked":
        body, framed = unchunked(body)
    digest = hashlib.sha1(body).hexdigest()
    return *first[3:7], body, len(body), digest, len(segments), whole and framed and digest == first[6]


OUT = (
    "origin string, record_type string, uri string, refers string, header_digest string, payload binary, "
    "payload_bytes long, payload_digest string, segments int, complete boolean"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The archives in ``manifest``: a finished row for each record in one piece, and for every
    segment of the others its number, total length and block, still to be put together."""

    def run(batches):
        for part in batches:
            for archive in part.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        found = parse(data)
                        if found[1] == 0:
                            made = (found[0], *payload_of([found]))
                            found = (None,) * 7
                        else:
                            made = (found[0], *(None,) * 9)
                            found = found[1:]
                        if not with_payload:
                            made = (*made[:5], None, *made[6:])
                        rows.append((*made, *found))
                        size += len(made[5] or b"") + len(found[6] or b"") + 200
                        if size > 4 << 20:
                            yield batch_of(rows, f"{OUT}, {SEGMENT}")
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows, f"{OUT}, {SEGMENT}")

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(tasks, "archive").mapInArrow(run, f"{OUT}, {SEGMENT}")


def reassemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per original record: its payload put together from all its segments.

    Rows are dealt by origin id and sorted by segment number, so a task holds the segments of one
    record at a time, whatever the number of records.
    """
    width = len(OUT.split(", "))

    def run(batches):
        held, rows, size = [], [], 0

        def close():
            nonlocal size
            made = payload_of(held)
            size += made[5]
            rows.append((held[0][0], *made[:4], made[4] if with_payload else None, *made[5:]))
            held.clear()

        for part in sliced(batches, 64):
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                if row[width] is None:
                    rows.append(row[:width])
                    size += len(row[5] or b"") + 200
                else:
                    held.append((row[0], *row[width:]))
                if size > 4 << 20:
                    yield batch_of(rows, OUT)
                    rows, size = [], 0
        if held:
            close()
        if rows:
            yield batch_of(rows, OUT)

    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(tasks, "origin").sortWithinPartitions("origin", "segment").mapInArrow(run, OUT)


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, uri, html, digest and refers: the page that holds an equal payload, for revisits."""
    own = pages.select(
        "page_id",
        F.col("html"),
        F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"),
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("uri"),
    )
    keys = own.select("page_id", "digest", "bytes").filter(F.col("bytes") >= least)
    # Of equal payloads of null ids alone none can be referred to, so all of them stay.
    holders = keys.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1 AND holder IS NOT NULL")
    revisits = (
        keys.join(holders, "digest")
        .filter("page_id IS DISTINCT FROM holder")
        .groupBy(F.col("page_id").alias("id"), F.col("digest").alias("payload"))
        .agg(F.concat(F.lit("page:"), F.max("holder").cast("string")).alias("refers"))
    )
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("payload"))
    return own.join(revisits, same, "left").select("page_id", "uri", "html", "digest", "refers")
