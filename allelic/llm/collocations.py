"""Phrase collocation mining from sorted count streams.

Every word position gives one window, the word and up to three after it in its piece. Windows are
counted where they are read, dealt by ranges and sorted; one pass over a sorted part then has the
count of every phrase of one to four words as the run of windows that begin with it. Frequent phrases are
kept as two streams, one sorted by their words from the left (prefix order), one from the right
(suffix order). In prefix order a phrase follows its own prefixes, so a lockstep pass joins the counts
of left parts and hands each phrase the largest count of its right extensions; suffix order
gives right parts and left extensions alike. A sort-merge join brings both together. Nothing but a stack
of four open phrases is held in a task; phrases that run across the border of two parts are added up
afterwards, and a part's first phrases get the prefixes that lie in an earlier part (at most three).

A phrase inside a longer one of two more words is inside one of one more word that is at least as frequent,
so extensions by one word decide what is dropped.

Defined cases: null and empty texts have no word; a null language is ``und``; ties are settled by count and
then phrase; repeated rows count each time; very long texts are cut into pieces and counted whole, in
batches of bounded size; an empty table gives an empty table; columns other than text and lang play no part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import sliced, stored
from .ranks import numbered

LONGEST = 4
#: Bytes of text whose windows a task counts at once, and windows whose phrases it adds up at once; bounds its memory.
HELD_BYTES, HELD_ROWS = 1 << 20, 1 << 16
BATCH = 4096  # rows of an Arrow batch, of texts as of windows
#: A-Z to lower case, tab to space, and what ends a piece to a newline.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
SPACE, END = 32, 10
WINDOWS = "key string, n long"  # language, newline, window: one column, so that the sort's prefix reaches the words
COUNTS = "lang string, phrase string, size int, n long, partial boolean"
PARTS = "lang string, phrase string, n long, parts array<long>, longer long"


@dataclass(frozen=True)
class Settings:
    least: int = 30  # occurrences of a candidate
    inside: int = 80  # per cent of them that a longer candidate must reach to drop it
    first: int = 2000  # rows returned for each language


def windows_of(text: bytes, own: int | None = None) -> pa.Array:
    """The window of every word that starts in the first ``own`` bytes: the word and up to three after it
    in its piece, each followed by a space, so that all windows that begin with a phrase sort side by side."""
    data = np.frombuffer(text.translate(FOLD) + b"\n", np.uint8)
    blank = (data == SPACE) | (data == END)
    kept = ~blank
    kept[1:] |= ~blank[:-1]  # a word with the blank after it
    piece = np.cumsum(data == END, dtype=np.int32)
    starts = (~blank & np.concatenate([[True], blank[:-1]])).nonzero()[0]
    piece = piece[starts]
    packed = data[kept]
    packed[packed == END] = SPACE
    # Starts of words among the bytes kept, and the end of the last.
    at = np.append((np.cumsum(kept) - 1)[starts], len(packed))
    size = np.ones(len(starts), np.int64)
    for d in range(1, LONGEST):
        size[:-d] += piece[d:] == piece[:-d]
    n = len(starts) if own is None else np.searchsorted(starts, own)
    lengths = at[np.arange(n) + size[:n]] - at[:n]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    places = np.repeat((at[:n] - offsets[:-1]).astype(np.int32), lengths)
    places += np.arange(offsets[-1], dtype=np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(packed[places]))


def count_windows(batches):
    """Windows of (text, lang) rows with their counts within about a megabyte of a language's text;
    a longer text is cut."""
    held, sizes = defaultdict(list), Counter()

    def flush(lang):
        for part in cut(b"\n".join(held.pop(lang))):
            found = windows_of(*part).value_counts()
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang, found.field(0), "\n"), found.field(1)], names=["key", "n"])
        sizes.pop(lang)

    for batch in sliced(batches, 64):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                held[lang].append(text.encode())
                sizes[lang] += len(held[lang][-1])
                if sizes[lang] >= HELD_BYTES:
                    yield from flush(lang)
        if len(held) > 64 or sum(sizes.values()) > 4 * HELD_BYTES:  # many languages
            for lang in list(held):
                yield from flush(lang)
    for lang in list(held):
        yield from flush(lang)


def cut(data: bytes, held: int = HELD_BYTES):
    """``data`` in parts of bounded size, each with the number of bytes of its own: after them come, of
    the same piece, up to three words of the next part, which complete its last windows."""
    at = 0
    while len(data) - at > 2 * held:
        found = _WORD_END.search(data, at + held)
        if not found:
            break
        end = found.start()
        yield data[at : _NEXT_WORDS.match(data, end).end()], end - at
        at = end
    yield data[at:], None


_WORD_END = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_NEXT_WORDS = re.compile(rb"(?:[\x20\x09]+[^\x20\x09.,;:!?\x0a-\x0d]+){0,3}")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("partial", pa.bool_())])
_PARTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("parts", pa.list_(pa.int64())), ("longer", pa.int64())])


def _in_groups(batches, least: int):
    """Batches put together to at least ``least`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def phrase_counts(least: int):
    """A pass over sorted windows: every phrase of at least ``least`` occurrences, those that touch
    the border of a part whatever their count (``partial``), and under size 0 the words of each language.

    A phrase of k words is a run of windows with equal first k words; the run open at the end of a
    group of rows is carried into the next, one for each k.
    """

    def run(batches):
        open_: list = [None] * (LONGEST + 1)  # for each k: lang, phrase, count, whether it is the part's first
        for table in _in_groups(batches, HELD_ROWS):
            rows = table.num_rows
            # A window has no newline, a language may.
            keys = pc.split_pattern(table.column(0).chunk(0), "\n", max_splits=1, reverse=True).flatten()
            langs, windows = keys[::2], keys[1::2]
            n = table.column(1).to_numpy()
            # Words as numbers that are equal within these rows exactly if the words are.
            split = pc.split_pattern(windows, " ")
            numbers = split.flatten().dictionary_encode().indices.to_numpy()
            first = split.offsets.to_numpy()[:-1] - split.offsets.to_numpy()[0]
            size = np.diff(split.offsets.to_numpy()) - 1
            same = np.zeros(rows, bool)
            codes = langs.dictionary_encode().indices.to_numpy()
            same[1:] = codes[1:] == codes[:-1]
            found = []
            for k in range(LONGEST + 1):
                has = size >= k
                if k:
                    word = np.where(has, numbers[np.minimum(first + k - 1, len(numbers) - 1)], -1)
                    same[1:] &= word[1:] == word[:-1]
                    same[1:] &= has[1:] & has[:-1]
                starts = (has & ~same).nonzero()[0]
                if not len(starts):
                    continue
                sums = np.add.reduceat(np.where(has, n, 0), starts)
                phrase = lambda i: " ".join(windows[int(i)].as_py().split(" ")[:k])  # noqa: B023, E731
                name = lambda i: langs[int(i)].as_py()  # noqa: B023, E731
                before, last = open_[k], len(starts) - 1
                partial = before is None
                if before:
                    if before[:2] == (name(starts[0]), phrase(starts[0])):
                        sums[0] += before[2]
                        partial = before[3]
                    elif before[2] >= least or before[3]:
                        found.append((*before[:2], k, *before[2:]))
                # Languages (k = 0) are few, and summed over all parts in any case.
                take = sums[:last] >= (least if k else 0)
                take[:1] |= partial
                for i in take.nonzero()[0]:
                    found.append((name(starts[i]), phrase(starts[i]), k, int(sums[i]), not k or (partial and i == 0)))
                open_[k] = (name(starts[last]), phrase(starts[last]), int(sums[last]), not k or (partial and not last))
            yield _batch(found, _COUNTS)
        yield _batch([(*o[:2], k, o[2], True) for k, o in enumerate(open_) if o], _COUNTS)

    return run


def count_phrases(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, phrase, size and n of all phrases of up to four words that are frequent; size 0 counts a language's words."""
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    # Windows are made twice, for the bounds of ranges and to be dealt: less work than to write and read them.
    dealt = texts.mapInArrow(count_windows, WINDOWS).repartitionByRange("key").sortWithinPartitions("key")
    found = stored(dealt.mapInArrow(phrase_counts(settings.least), COUNTS), "phrases", BATCH)
    # At most four phrases at either border of a part, and one row a language.
    split = found.filter("partial").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return found.filter("NOT partial").drop("partial").unionByName(split.filter((F.col("n") >= settings.least) | (F.col("size") == 0)))


def lockstep(turned: bool):
    """A pass over phrases in prefix order (suffix order if ``turned``): the counts of the parts that
    lead each phrase, shortest first, and the largest count of an extension of each by one word."""

    def run(batches):
        held, words, counts, longer, carried, lang, at = [], [], [], [], [], None, None

        def close(depth):
            while len(words) > depth:
                n, ext, only = counts.pop(), longer.pop(), carried.pop()
                if len(words) > 1 and (ext or not only):
                    phrase = " ".join(reversed(words) if turned else words)
                    held.append((lang, phrase, None if only else n, None if only else list(counts), ext or None))
                words.pop()

        for batch in batches:
            for part, name, key, n, again in zip(*(c.to_pylist() for c in batch.columns)):
                new = key.split(" ")[:-1]
                same = 0
                if (part, name) == (at, lang):
                    for a, b in zip(words, new):
                        if a != b:
                            break
                        same += 1
                close(same)
                at, lang = part, name
                if same != len(new) - 1:
                    raise AssertionError(f"{key!r} came without its parts")
                if longer:
                    longer[-1] = max(longer[-1], n)
                words.append(new[-1])
                counts.append(n)
                longer.append(0)
                carried.append(again)
            if len(held) >= 1 << 14:
                yield _batch(held, _PARTS)
                held.clear()
        close(0)
        yield _batch(held, _PARTS)

    return run


def joined_parts(phrases: DataFrame, turned: bool) -> DataFrame:
    """The lockstep pass over the whole stream: PARTS, where a phrase whose extensions lie in several parts has
    a row for each of them."""
    key = F.array_join(F.reverse(F.split("phrase", " ")), " ") if turned else F.col("phrase")
    stream = phrases.select("lang", F.concat(key, F.lit(" ")).alias("key"), "n")
    stream = stream.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key").withColumn("part", F.spark_partition_id())
    stream = stored(stream, "stream")
    # The parts that lead the first phrase of a part of the stream: at most three rows for each.
    heads = stream.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("first")).select("part", "first.*")
    # Each prefix ends in a space, as keys do.
    prefix = lambda i: F.concat(F.substring_index("key", " ", i), F.lit(" "))
    leading = F.filter(F.array(*(prefix(i) for i in range(1, LONGEST))), lambda p: F.length(p) < F.length("key"))
    leading = stored(heads.select("part", "lang", F.explode(F.array_distinct(leading)).alias("key")), "leads")
    carried = stream.drop("part").join(leading, ["lang", "key"])
    both = stream.withColumn("again", F.lit(False)).unionByName(carried.withColumn("again", F.lit(True)))
    dealt = both.repartition("part").sortWithinPartitions("part", "lang", "key", F.desc("again"))
    return dealt.select("part", "lang", "key", "n", "again").mapInArrow(lockstep(turned), PARTS)


def mine(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first collocations."""
    counts = stored(count_phrases(docs, settings), "frequent")
    phrases, totals = counts.filter("size > 0"), counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    left = stored(joined_parts(phrases, False), "left-parts")
    right = stored(joined_parts(phrases, True), "right-parts")
    longer = left.select("lang", "phrase", "longer").unionByName(right.select("lang", "phrase", "longer"))
    longer = longer.filter("longer IS NOT NULL").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = left.filter("parts IS NOT NULL").select("lang", "phrase", F.col("n").alias("a"), F.col("parts").alias("ls"))
    ends = right.filter("parts IS NOT NULL").select("lang", "phrase", F.reverse("parts").alias("rs"))
    met = whole.join(ends.hint("merge"), ["lang", "phrase"]).join(longer.hint("merge"), ["lang", "phrase"], "left")
    met = met.filter(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {settings.inside}")
    # Decimals: products may pass 64 bits. Cuts are compared by score, then by the words before them.
    met = met.withColumn("cuts", F.expr(
        "transform(arrays_zip(ls, rs), (c, i) -> struct((CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(c.ls AS DECIMAL(20, 0)) + CAST(c.rs AS DECIMAL(20, 0))) AS score, i AS k, c.ls AS l, c.rs AS r))"
    ))
    scored = met.withColumn("cut", F.array_min("cuts")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score")
    )
    # Numbered by ranges: a language may hold most phrases.
    scored = stored(scored, "scored")
    ranked = numbered(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")]).filter(F.col("position") < settings.first)
    return ranked.join(totals, "lang").select("lang", (F.col("position") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
