"""Removal of long repeated byte strings by Burrows-Wheeler interval expansion.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in the
same text or another one.

1. Deal. Every window of ``length`` bytes is dealt by its minimizer, the leftmost smallest of its
   hashed 32-grams, so equal windows meet whatever surrounds them. Neighbouring windows of one
   minimizer form a segment. A minimizer that occurs once ends there; segments with equal bytes
   are gathered into one with a count, and a count of two says that all their windows repeat.
   Bytes are compared by a 64-bit digest, and only among segments of one 64-bit minimizer.
2. Split. A minimizer with very many different segments is dealt again by narrower ranges of
   window starts and the bytes that all windows of a range share, down to single windows, so a
   passage that a third of all texts hold never meets in one task.
3. Expand. Minimizers are packed into blocks of bounded size. A block's segments are turned into
   their Burrows-Wheeler transform; breadth-first backward extension of suffix intervals yields
   the common prefixes of neighbouring suffixes by increasing value and stops at ``length``.
   Neighbours that no interval has parted by then share a string of that length.
4. Cover. The repeated windows of each text become runs, and the rest of its bytes is kept.

Defined cases: a null text counts as empty; very long texts are cut into overlapping pieces; rows
of null id are texts like others; of equal strings all go, none is kept as first; texts shorter than ``length`` keep every byte; rows
that share an id are separate texts, and rows equal in id and text get equal results; an empty
table gives an empty table; input columns other than id and text play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import sliced, stored
from .shingles import _BASE, _INVERSE, _power, mixed


@dataclass(frozen=True)
class Settings:
    length: int = 400
    gram: int = 32
    piece: int = 4 << 20  # a longer text is cut into overlapping pieces of so many bytes
    hot: int = 1024  # different segments of a minimizer that may meet in one block
    steps: tuple[int, ...] = (16, 1)  # window starts in a range, when dealt again
    block_bytes: int = 1_000_000


_BYTES = np.random.default_rng(7041776).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


class Hashed:
    """A text's prefix hashes, for the hash of any of its strings."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power(_BASE, self.n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _power(_INVERSE, self.n + 1)[start]
        return mixed(raw ^ (end - start).astype(np.uint64))


def segments(data: np.ndarray, settings: Settings) -> Iterator[tuple]:
    """Arrays (start, windows, place of the minimizer, minimizer hash, digest) of a text's segments."""
    length, gram = settings.length, settings.gram
    width = length - gram + 1
    for base in range(0, max(len(data) - length + 1, 0), settings.piece):
        part = data[base : base + settings.piece + length - 1]
        hashed = Hashed(part)
        at = np.arange(hashed.n - gram + 1)
        grams = hashed.of(at, at + gram)
        least, have = (grams & ~_LOW) | at.astype(np.uint64), 1
        while 2 * have <= width:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if rest := width - have:
            least = np.minimum(least[:-rest], least[rest:])
        place = (least & _LOW).astype(np.int64)
        first = np.append(True, place[1:] != place[:-1]).nonzero()[0]
        windows = np.diff(np.append(first, len(place)))
        place = place[first]
        yield first + base, windows, place + base, grams[place], hashed.of(first, first + windows + length - 1)


def narrower(data: np.ndarray, start, windows, place, group, step: int, length: int):
    """Segments of a text cut into ranges of ``step`` window starts, counted from the minimizer."""
    low = np.floor_divide(start - place, step)
    count = np.floor_divide(start + windows - 1 - place, step) - low + 1
    of = np.repeat(np.arange(len(start)), count)
    band = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    first = np.maximum(start[of], place[of] + band * step)
    last = np.minimum(start[of] + windows[of] - 1, place[of] + band * step + step - 1)
    hashed = Hashed(data)
    core = hashed.of(place[of] + band * step + step - 1, place[of] + band * step + length)
    key = mixed(core ^ mixed(group[of] + band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return first, last - first + 1, place[of], key, hashed.of(first, last + length)


def suffix_order(text: np.ndarray, codes: int, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions ordered by their next ``length`` symbols; the first sort's keys in that order; its depth."""
    n = len(text)
    bits = max(int(codes - 1).bit_length(), 1)
    depth = min(62 // bits, length)
    key = np.zeros(n, np.uint64)
    padded = np.append(text, np.zeros(depth, text.dtype)).astype(np.uint64)
    for i in range(depth):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    grams = key
    order, rank = _ranked(key)
    have = depth
    narrow = n < (1 << 21) - 1  # three ranks fit into one key
    while have < length:
        if 2 * have >= length or not narrow:
            steps = [min(have, length - have)]
        else:
            steps = [have, min(2 * have, length - have)]
        key = rank.astype(np.uint64)
        for s in steps:
            ahead = np.zeros(n, np.uint64)
            ahead[: max(n - s, 0)] = rank[s:] + 1
            key = (key << np.uint64(21 if narrow else 32)) | ahead
        order, rank = _ranked(key)
        have += steps[-1]
    return order, grams[order], depth


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    sorted_key = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.append(0, sorted_key[1:] != sorted_key[:-1]))
    return order, rank


def unparted(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text`` (0 separates strings), and for each place in it whether the suffix
    shares ``length`` symbols with the one before it.

    Breadth-first: the intervals of all strings of one length are extended backward by one symbol;
    an interval whose two ends were known already is not extended further. Intervals of the
    strings that the first sort compared start the search.
    """
    alphabet, codes = np.unique(np.append(text, 0), return_inverse=True)
    text = codes[:-1].astype(np.uint8)
    n = len(text)
    order, grams, depth = suffix_order(text, len(alphabet), length)
    before = text[order - 1]  # the transform
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)  # the last-to-first map
    run = np.cumsum(np.append(False, before[1:] != before[:-1]))  # of equal symbols in the transform
    known = np.zeros(n + 1, bool)  # ends of intervals: common prefix shorter than the level
    known[0] = known[n] = True
    known[1:n] = grams[1:] != grams[:-1]
    low = known[:-1].nonzero()[0]
    high = np.append(low[1:], n) - 1
    level = depth
    while len(low) and level < length:
        single = run[low] == run[high]  # one symbol only stands before all suffixes of the interval
        single_low, single_high = low[single], high[single]
        inside = before[single_low] != 0
        new_low, new_high = step[single_low[inside]], step[single_high[inside]]
        wide_low, wide_high = low[~single], high[~single]
        if len(wide_low):
            widths = wide_high - wide_low + 1
            owner = np.repeat(np.arange(len(widths)), widths)
            rows = np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths, widths) + wide_low[owner]
            keep = before[rows] != 0
            rows, owner = rows[keep], owner[keep]
            target = step[rows]
            by = np.argsort(target)
            target, owner = target[by], owner[by]
            edge = np.append(True, (owner[1:] != owner[:-1]) | (target[1:] != target[:-1] + 1)) if len(target) else np.zeros(0, bool)
            first = edge.nonzero()[0]
            new_low = np.append(new_low, target[first])
            new_high = np.append(new_high, target[np.append(first[1:], len(target)) - 1] if len(first) else first)
        fresh = ~(known[new_low] & known[new_high + 1])
        low, high = new_low[fresh], new_high[fresh]
        known[low] = known[high + 1] = True
        level += 1
    return order, ~known[:n]


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each string a flag for each of its windows: does it occur again in any of the strings?"""
    text = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int16) + 1, np.int16(0)) for p in parts])
    order, tied = unparted(text, length)
    flags = np.zeros(len(text), bool)
    flags[order[tied]] = True
    flags[order[tied.nonzero()[0] - 1]] = True
    at = np.cumsum([0] + [len(p) + 1 for p in parts])
    return [flags[a : a + max(len(p) - length + 1, 0)] for a, p in zip(at, parts)]


KEY = ["k1", "k2"]
ROWS = "k1 long, k2 long, start long, windows long, place long, grp long, digest long"


def _rows(keys: list[list], found: list[tuple]) -> pa.RecordBatch:
    counts = [len(x[0]) for x in found]
    columns = [pa.array(np.repeat(np.array(k, np.int64), counts)) for k in keys]
    for i in range(5):
        joined = np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64)
        columns.append(pa.array(joined.view(np.int64)))
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])


def keyed(docs: DataFrame) -> DataFrame:
    """Two hashes name a row's id and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(1), "doc_id").alias("k2"))


def all_segments(docs: DataFrame, settings: Settings) -> DataFrame:
    def run(batches):
        for part in sliced(batches, 64):
            k1, k2, found = [], [], []
            for a, b, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for x in segments(np.frombuffer(text.encode(), np.uint8), settings) if text else ():
                    k1.append(a), k2.append(b), found.append(x)
            yield _rows([k1, k2], found)

    return docs.filter(F.octet_length("text") >= settings.length).select(*KEY, "text").mapInArrow(run, ROWS)


def narrowed(docs: DataFrame, rows: DataFrame, step: int, settings: Settings) -> DataFrame:
    """The segments in ``rows``, cut to ranges of ``step`` window starts."""
    wanted = rows.groupBy(*KEY).agg(F.collect_set(F.struct("start", "windows", "place", "grp")).alias("cut"))
    held = docs.select(*KEY, "text").join(wanted, KEY)

    def run(batches):
        for part in sliced(batches, 64):
            k1, k2, found = [], [], []
            for a, b, text, cut in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "cut")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                columns = [np.array([x[c] for x in cut], np.int64) for c in ("start", "windows", "place", "grp")]
                k1.append(a), k2.append(b)
                found.append(narrower(data, *columns[:3], columns[3].view(np.uint64), step, settings.length))
            yield _rows([k1, k2], found)

    return held.select(*KEY, "text", "cut").mapInArrow(run, ROWS)


def expand_blocks(strings: DataFrame, blocks: int, length: int) -> DataFrame:
    """grp, digest, first and last window of every run of repeated windows (step 3)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["grp", "digest"])
        out = []
        for grp, digest, flags in zip(rows.grp, rows.digest, repeated_windows(list(rows.bytes), length)):
            edges = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
            out += [(grp, digest, int(a), int(b)) for a, b in zip((edges == 1).nonzero()[0], (edges == -1).nonzero()[0])]
        return pd.DataFrame(out, columns=["grp", "digest", "from", "to"]).astype("int64")

    block = F.pmod(F.xxhash64("grp"), F.lit(blocks))
    return strings.withColumn("block", block).groupBy("block").applyInPandas(run, "grp long, digest long, `from` long, `to` long")


def repeated_runs(docs: DataFrame, settings: Settings) -> DataFrame:
    """k1, k2, start, end: byte ranges of ``docs`` (keyed) that repeated windows cover."""
    length = settings.length
    level = stored(all_segments(docs, settings), "suffix-segments")
    covered, partial, wanted = [], [], []
    for step in (*settings.steps, None):
        copies = level.groupBy("grp", "digest").agg(F.count("*").alias("copies"), F.max("windows").alias("length"), F.min(F.struct(*KEY, "start", "place")).alias("one"))
        copies = stored(copies, "suffix-copies")
        groups = copies.groupBy("grp").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).filter("total > 1")
        groups = stored(groups, "suffix-groups")
        shared = stored(copies.join(groups, "grp"), "suffix-shared")
        several = F.col("kinds") > 1
        hot = F.col("kinds") > settings.hot if step else F.lit(False)
        # Strings of which there are two need no search; those of which there is one, in company, do.
        verdicts = shared.select("grp", "digest", (F.col("copies") > 1).alias("all"), (several & ~hot & (F.col("copies") == 1)).alias("search"))
        known = stored(level.join(verdicts, ["grp", "digest"]), "suffix-known")
        covered.append(known.filter("all").select(*KEY, "start", (F.col("start") + F.col("windows") + length - 1).alias("end")))
        partial.append(known.filter("search").select(*KEY, "start", "grp", "digest"))
        wanted.append(shared.filter(several & ~hot).select("grp", "digest", "length", "one.k1", "one.k2", "one.start"))
        if step:
            # One of equal segments stands for all: theirs are decided, others need their bytes.
            deeper = shared.filter(hot).select("one.*", F.col("length").alias("windows"), "grp")
            if deeper.isEmpty():
                break
            level = stored(narrowed(docs, deeper, step, settings), "suffix-segments")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    wanted = union(wanted)
    size = wanted.agg(F.coalesce(F.sum(F.col("length") + length), F.lit(0))).first()[0]
    needed = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("start", "length", "grp", "digest")).alias("cut"))

    def cut_out(batches):
        for part in sliced(batches, 64):
            grp, digest, strings = [], [], []
            for text, cut in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = text.encode()
                for x in cut:
                    grp.append(x["grp"]), digest.append(x["digest"])
                    strings.append(data[x["start"] : x["start"] + x["length"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(digest, pa.int64()), pa.array(strings, pa.binary())], names=["grp", "digest", "bytes"])

    strings = docs.select(*KEY, "text").join(needed, KEY).select("text", "cut").mapInArrow(cut_out, "grp long, digest long, bytes binary")
    runs = stored(expand_blocks(strings, max(8, size // settings.block_bytes), length), "suffix-runs")
    searched = union(partial).join(runs, ["grp", "digest"]).select(
        *KEY, (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to") + length - 1).alias("end")
    )
    return union(covered).unionByName(searched)


def without(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The kept bytes, the number of removed ones, and of maximal removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(ranges):
        if a > end:
            runs += 1
            kept.append(data[max(end, 0) : a])
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
    kept.append(data[max(end, 0) :])
    return b"".join(kept), removed, runs


def dedup(docs: DataFrame, settings: Settings = Settings(), with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the kept bytes of each text."""
    docs = keyed(docs)
    ranges = repeated_runs(docs, settings).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for part in sliced(batches):
            rows = []
            for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                kept, removed, spans = without(data, [(r["start"], r["end"]) for r in ranges or ()])
                rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows))
            arrays = [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))]
            if with_bytes:
                arrays.append(pa.array(columns[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["kept"] * with_bytes)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return docs.join(ranges, KEY, "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)
