"""Merkle manifest of a table: a tree of digests over the rows of each group, and one over the groups.

Method: windows with fixed offsets. The rows of a block of consecutive leaves stay in one window;
on level j a node sits in the row of its first leaf, so its neighbours are found by lag and lead of
a multiple of arity**j rows. Masks by slot (place in the run) and run length tell which of them
are siblings; rows of first children hash the parents. A second walk from the block's top down
gives every row the siblings on its way. Roots of blocks are the leaves of the next round, so a
group of any size takes few rounds and no task sees more than a block of it.

Defined cases: a null value is written ``-``, so it differs from the empty text; a null group is a
group of its own, ordered first; leaves ascend by the order column, nulls first, then by their
digest, so repeated rows are separate leaves; a group of one leaf has that leaf as root and an empty
proof; very long texts are hashed once, where they are read, and never shuffled; an empty table gives
an empty manifest; columns other than those named play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored
from .ranks import numbered

DIGEST = 32  # bytes


def row_digest(*values: str | Column) -> Column:
    """Lower-case hex SHA-256 of the values in a form that no two lists of values share."""
    text = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(*digests: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(as_hex, digests)).cast("binary"), 256))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _shape(position: Column, count: Column, step, arity: int) -> tuple[Column, Column, Column]:
    """On the level whose nodes hold ``step`` leaves: slot and run length of the node over a leaf, and
    whether the level has more than one node."""
    nodes, node = _div(count + step - 1, step), _div(position, step)
    slot = F.pmod(node, F.lit(arity))
    return slot, F.least(F.lit(arity).cast("long"), nodes - node + slot), nodes > 1


def _climb(nodes: DataFrame, keys: list[str], arity: int, levels: int) -> DataFrame:
    """``nodes`` (keys, position, rows, digest and more) with ``path``, the siblings within the
    block from the bottom up and left to right, and in its first row ``top``, the root of the block."""
    none, size = F.lit(b""), arity**levels
    df = nodes.withColumn("block", _div(F.col("position"), size))
    window = W.partitionBy(*keys, "block").orderBy("position")
    df = df.withColumn("__d0", F.col("digest"))
    for j in range(levels):
        step, here = arity**j, f"__d{j}"
        slot, run, open_ = _shape(F.col("position"), F.col("rows"), F.lit(step), arity)
        before = {o: F.lag(here, o * step).over(window) for o in range(1, arity)}
        after = {o: F.lead(here, o * step).over(window) for o in range(1, arity)}
        df = df.withColumns({f"__b{o}": c for o, c in before.items()} | {f"__a{o}": c for o, c in after.items()})
        left = [F.when(slot >= o, F.col(f"__b{o}")).otherwise(none) for o in reversed(range(1, arity))]
        right = [F.when(slot + o < run, F.col(f"__a{o}")).otherwise(none) for o in range(1, arity)]
        is_node = F.pmod("position", F.lit(step)) == 0
        is_first = F.pmod("position", F.lit(step * arity)) == 0
        df = df.withColumns({
            f"__s{j}": F.when(is_node, F.when(open_, F.concat(*left, *right)).otherwise(none)),
            f"__d{j + 1}": F.when(is_first, F.when(open_, _parent(F.col(here), *right)).otherwise(F.col(here))),
        }).drop(here, *(f"__{side}{o}" for side in "ab" for o in range(1, arity)))
    df = df.withColumn("path", F.when(F.pmod("position", F.lit(size)) == 0, none))
    for j in reversed(range(levels)):
        step = arity**j
        slot, _, _ = _shape(F.col("position"), F.col("rows"), F.lit(step), arity)
        df = df.withColumns({f"__p{o}": F.lag("path", o * step).over(window) for o in range(1, arity)})
        above = F.when(slot == 0, F.col("path"))
        for o in range(1, arity):
            above = above.when(slot == o, F.col(f"__p{o}"))
        path = F.when(F.pmod("position", F.lit(step)) == 0, F.concat(F.col(f"__s{j}"), above))
        df = df.withColumn("path", path).drop(f"__s{j}", *(f"__p{o}" for o in range(1, arity)))
    return df.withColumnRenamed(f"__d{levels}", "top")


def tree(leaves: DataFrame, keys: list[str], arity: int = 2, levels: int = 10) -> tuple[DataFrame, DataFrame]:
    """Trees over ``leaves`` (keys, position, rows, digest binary and columns to carry), one for each of ``keys``.

    Returns the leaves with ``path`` (their siblings, bottom up) and ``root``, and a table of keys and ``root``.
    """
    most = leaves.agg(F.max("rows")).first()[0] or 0
    # Small trees need fewer levels than a block has.
    levels = max(1, min(levels, next(j for j in range(64) if arity**j >= most)))
    size, rounds, nodes = arity**levels, [], leaves
    while True:
        climbed = stored(_climb(nodes, keys, arity, levels), "merkle")
        rounds.append(climbed)
        if most <= size:
            break
        most = -(-most // size)
        count = _div(F.col("rows") + size - 1, size)
        nodes = climbed.filter("top IS NOT NULL").select(*keys, F.col("block").alias("position"), count.alias("rows"), F.col("top").alias("digest"))
    roots = rounds[-1].filter("position = 0").select(*keys, F.col("top").alias("root"))
    # The last round has at most a block of each key, so no key is hot in this join.
    found = rounds[-1].join(roots, keys).withColumnRenamed("path", "__path")
    for below in reversed(rounds[:-1]):
        upper = found.select(*keys, F.col("position").alias("block"), F.col("__path").alias("__upper"), "root")
        found = below.join(upper, [*keys, "block"]).withColumn("__path", F.concat("path", "__upper")).drop("path", "__upper")
    return found.withColumnRenamed("__path", "path").drop("top", "block"), roots


def manifest(rows: DataFrame, group: str, order: str, arity: int = 2, levels: int = 10) -> DataFrame:
    """The tree over all rows (``leaf`` lower-case hex, the ``group`` and ``order`` columns, and columns to carry).

    Adds ``subroot`` and ``root`` (hex), ``path`` (binary: siblings up to the root) and ``way``, an
    array of (step, position, rows), one for each level that a proof climbs.
    """
    taken = [c for c in rows.columns if c != group]
    named = rows.select(F.col(group).isNotNull().alias("__named"), F.coalesce(group, F.lit("")).alias("__group"), *taken)
    named = stored(named.withColumn("digest", F.unhex("leaf")), "merkle-leaves")
    keys = ["__named", "__group"]
    placed = numbered(named, keys, [F.asc_nulls_first(order)], [F.asc("digest")])
    leaves, subroots = tree(placed, keys, arity, levels)
    tops = subroots.select(F.lit(0).alias("__whole"), *keys, F.col("root").alias("digest"))
    groups, _ = tree(numbered(tops, ["__whole"], [F.asc(c) for c in keys]), ["__whole"], arity, levels)
    groups = stored(groups.select(
        *keys, F.col("digest").alias("__sub"), F.col("path").alias("__onward"), F.col("root").alias("__root"),
        F.col("position").alias("__group_position"), F.col("rows").alias("__groups"),
    ), "merkle-groups")
    # One row a group: joined by broadcast while Spark's own size check allows it.
    found = leaves.join(groups, keys)
    deepest = lambda n: [arity**j for j in range(64) if arity**j < n]
    most, wide = (placed.agg(F.max("rows")).first()[0] or 1), (groups.agg(F.max("__groups")).first()[0] or 1)

    def steps(position: str, count: str, most: int) -> Column:
        powers = deepest(most)
        if not powers:
            return F.array().cast("array<struct<step:bigint,position:bigint,rows:bigint>>")
        level = lambda p: F.struct(p.alias("step"), F.col(position).alias("position"), F.col(count).alias("rows"))
        return F.transform(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < F.col(count)), level)

    way = F.concat(steps("position", "rows", most), steps("__group_position", "__groups", wide))
    return found.select(
        *taken, as_hex(F.col("__sub")).alias("subroot"), as_hex(F.col("__root")).alias("root"),
        F.concat("path", "__onward").alias("path"), way.alias("way"),
        F.when(F.col("__named"), F.col("__group")).alias(group),
    )


def folded(leaf: str | Column, path: str = "path", way: str = "way", arity: int = 2) -> Column:
    """The root (hex) that ``leaf`` (hex) leads to with the siblings of a proof."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    start = F.struct(F.unhex(leaf).alias("digest"), F.lit(1).cast("long").alias("at"))

    def climb(s: Column, level: Column) -> Column:
        slot, run, _ = _shape(level["position"], level["rows"], level["step"], arity)
        piece = lambda at, n: F.substring(F.col(path), at.cast("int"), (n * DIGEST).cast("int"))
        left, right = piece(s["at"], slot), piece(s["at"] + slot * DIGEST, run - 1 - slot)
        return F.struct(_parent(left, s["digest"], right).alias("digest"), (s["at"] + (run - 1) * DIGEST).alias("at"))

    return as_hex(F.aggregate(F.col(way), start, climb)["digest"])
