"""Document fingerprints: a sketch that retains every shingle hash below a fixed fraction of all hashes.

The threshold is the same for every document, so the sketch grows with the document, sketches merge
by union, and containment of a short text in a very long one is estimated without bias. A shingle is a
run of five words, lower-cased in A-Z; its hash is the first 64 bits of its MD5, as 16 hex digits.

Only DataFrame functions. Defined cases: a text of fewer than five words is one shingle; of a text none of
whose hashes lies below the threshold the least hash is retained, so only texts without a word
(null, empty, blank) have an empty sketch; two empty sketches are alike (1), an empty one and another are
not (0); very long texts are sketched whole, in time linear in their words; repeated rows are
separate documents; of equal ids the order is by a 64-bit hash of the text, then text; null ids come last; a lone document is its own next one; an
empty table gives an empty table; columns other than id and text play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

SIZE, SCALE, DIGITS = 5, 4, 16
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once a row however often ``then`` reads it."""
    return F.transform(F.array(value), then)[0]


def _bound(scale: float) -> str:
    return format(min(int(2 ** (4 * DIGITS) / scale), 2 ** (4 * DIGITS) - 1), f"0{DIGITS}x")


def words(text: Column) -> Column:
    trimmed = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(BLANKS))
    return _let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def sketch(text: str | Column, scale: float = SCALE, size: int = SIZE) -> Column:
    """Sorted distinct hashes (hex) of a text's shingles: those in the lowest 1 / ``scale`` of all values, or else the least."""
    text = F.col(text) if isinstance(text, str) else text
    digest = lambda run: F.substring(F.md5(F.array_join(run, " ").cast("binary")), 1, DIGITS)

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: digest(F.slice(w, i, size)))
        return F.when(F.size(w) >= size, runs).when(F.size(w) > 0, F.array(digest(w))).otherwise(w)

    def retain(h: Column) -> Column:
        low = F.filter(h, lambda x: x < _bound(scale))
        return _let(low, lambda k: F.when((F.size(k) > 0) | (F.size(h) == 0), F.sort_array(F.array_distinct(k))).otherwise(F.array(F.array_min(h))))

    return _let(words(text), lambda w: _let(hashes(w), retain))


def merge(a: str | Column, b: str | Column, scale: float = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return _let(
        F.array_union(a, b),
        lambda u: _let(
            F.filter(u, lambda x: x < _bound(scale)),
            lambda low: F.when((F.size(low) > 0) | (F.size(u) == 0), F.sort_array(low)).otherwise(F.array(F.array_min(u))),
        ),
    )


def _ratio(common: Column, of: Column, equal: Column) -> Column:
    return F.when(of > 0, common / of).when(equal, 1.0).otherwise(0.0)


def containment(a: str | Column, b: str | Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(a), F.size(b) == 0)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    return _let(
        F.size(F.array_intersect(a, b)), lambda n: _ratio(n, F.size(a) + F.size(b) - n, F.lit(True))
    )


def packed(hashes: str | Column) -> Column:
    """A sketch as one string; equal for equal sketches."""
    return F.array_join(hashes, "")


def unpacked(text: str | Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def _block(key: Column, firsts: list[tuple]) -> Column:
    """The last of the ascending keys ``firsts`` that is at most ``key``, by number, found by halving."""
    held = F.array(*(F.struct(*map(F.lit, f)) for f in firsts)).cast("array<struct<last:boolean,turned:bigint,hash:bigint>>")

    def halve(at: Column, step: Column) -> Column:
        return F.when((at + step < len(firsts)) & (F.get(held, F.least(at + step, F.lit(len(firsts) - 1))) <= key), at + step).otherwise(at)

    steps = [1 << j for j in reversed(range(len(firsts).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def against_edits(docs: DataFrame, scale: float = SCALE, block_bytes: int = 16 << 20) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    Documents follow one another by descending id, the first after the last. The edited text is the
    first half of a document and as many code points, or all, of the next one as the second half has.

    Keys alone are sorted by ranges first; the first key of each range is a bound of a block of about
    ``block_bytes`` of text, so there are as many bounds as tasks. Texts then travel once, to their
    block, and each block also gets the first row of the next one.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("long").alias("turned"), F.xxhash64(text).alias("hash"))
    rows = docs.select("doc_id", text.alias("text"), key.alias("key"))
    keys = stored(rows.select("key.*", F.octet_length("text").alias("bytes")), "fingerprint-keys")
    size = keys.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(-(-size // block_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["last", "turned", "hash"]
    ranges = keys.repartitionByRange(blocks, *order).groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*order)).alias("first"))
    firsts = sorted({tuple(r["first"]) for r in ranges.collect()}) or [(False, 0, 0)]
    number = _block(F.col("key"), firsts)
    rows = rows.withColumn("block", number)
    # A block ends with a copy of the row that follows it; rows of equal keys follow by text.
    heads = docs.sparkSession.createDataFrame([(*f, (i or len(firsts)) - 1) for i, f in enumerate(firsts)], "last boolean, turned long, hash long, before int")
    heads = rows.join(F.broadcast(heads.select(F.struct(*order).alias("key"), "before")), "key").groupBy("before").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.col("before").alias("block"))
    dealt = rows.withColumn("own", F.lit(True)).unionByName(heads.withColumn("own", F.lit(False))).repartition("block")
    dealt = dealt.withColumn("sketch", sketch("text", scale))
    follow = W.partitionBy("block").orderBy(F.desc("own"), "key", "text")
    met = dealt.withColumn("next_text", F.lead("text").over(follow)).withColumn("next_sketch", F.lead("sketch").over(follow)).filter("own")
    half = F.floor(F.length("text") / 2).cast("int")
    met = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))

    def compare(s: Column) -> Column:
        return F.struct(packed(s).alias("fingerprint"), likeness(F.col("sketch"), s).alias("near"))

    met = met.withColumn("of_edited", _let(sketch("edited", scale), compare))
    return met.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed("sketch").alias("fingerprint"), F.col("of_edited.fingerprint").alias("edited_fingerprint"),
        F.col("of_edited.near").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
    )
