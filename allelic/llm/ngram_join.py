"""Near-duplicate join on word shingles: exact Jaccard with adaptive multi-match prefixes.

Documents of equal shingle sets form one class; links are sought between classes.

1. Prune. If two sets reach the similarity, then under any common order of the shingles their
   prefixes, lengthened by m - 1, share m shingles at least. In hash order, with m a quarter of a
   set, a class is dropped if too few of its prefix shingles occur in any other class's prefix.
   Occurrences are counted in blocks: a task sends each distinct shingle of a chunk of documents
   once, so a shingle that a third of all documents hold costs one entry for each chunk.
2. Index. Shingles of the rest are ordered from rare to frequent. Each class takes the m that
   makes the estimated cost of its candidates least: scanning the lists of its prefix, plus
   verifying those that may reach m shared shingles. A pair needs as many shared prefix shingles
   as the smaller m of its two classes before it is verified.
3. Link. Large groups of near copies are joined to single members of each list first, verified,
   and gathered into components; only pairs across components are then enumerated, counted and
   verified. So a group of g near copies costs about g verifications, not g squared, and no link
   between components is lost.

Defined cases: a null text counts as empty; empty texts have no shingles and are components of
their own; rows that share an id are separate documents of that id; rows of null id are joined
like others; an empty table gives an empty table; input columns other than id and text play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import removed, sliced, stored
from .shingles import shingle_sets, signature


@dataclass(frozen=True)
class Settings:
    percent: int = 75  # least similarity
    chunk_shingles: int = 500_000  # held at once by a counting task
    block_shingles: int = 1_000_000  # about so many meet in one block
    max_match: int = 8  # largest m of the index
    verify_cost: int = 64  # of a candidate, in entries of a list
    star_rounds: int = 3
    hot_list: int = 256  # lists longer than this are dealt to several tasks


#: Size of the set of remainders that stands for a set of shingles in a first check of pairs.
BITS = 2048
#: Tasks to which the classes of one component are dealt when they learn its smallest id.
SALTS = 16


def least_overlap(n, percent: int):
    """Fewest shared shingles of a set of ``n`` with any set that reaches the similarity."""
    return -(-n * percent // 100)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and digest (of the shingle set; null for none) of each row."""

    def run(batches):
        for part in sliced(batches):
            sets = shingle_sets(part.column(1).to_pylist())
            nodes = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary())],
                names=["doc_id", "n_shingles", "digest"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary")


def survivors(docs: DataFrame, total: int, settings: Settings) -> DataFrame:
    """digest of the classes that may have a link (step 1)."""
    blocks = max(16, total // (2 * settings.block_shingles))
    percent = settings.percent

    def send(batches):
        task, chunk = TaskContext.get().partitionId(), 0
        sets: dict[bytes, tuple[np.ndarray, int]] = {}
        held = 0

        def emit():
            nonlocal chunk
            name = (task << 32) + chunk
            chunk += 1
            tokens = np.concatenate([s for s, _ in sets.values()])
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s, _ in sets.values()])
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            first = np.append(True, tokens[1:] != tokens[:-1])
            alone = first & np.append(first[1:], True)
            owner = np.where(alone, owner, np.uint16(65535))[first]
            tokens = tokens[first]
            block = (tokens >> np.uint64(32)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
            low = tokens.astype(np.uint32)[order]
            owner = owner[order]
            rows = [(b, name, low[i:j].tobytes(), owner[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            # The chunk's directory goes to a block too; blocks pass it on.
            rows.append((name % blocks, name, None, b"".join(sets)))
            rows.append((name % blocks, name, np.array([[len(s), n] for s, n in sets.values()], np.int64).tobytes(), None))
            for at in range(0, len(rows), 64):
                columns = zip(*rows[at : at + 64])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["block", "chunk", "a", "b"],
                )
            sets.clear()

        for part in sliced(batches):
            for found in shingle_sets(part.column(0).to_pylist()):
                n = len(found)
                if n and (node := signature(found)) not in sets:
                    prefix = found[: n - least_overlap(n, percent) + -(-n // 4)]
                    sets[node] = (prefix.copy(), n)  # a view would hold the whole set
                    held += len(prefix)
                    if held >= settings.chunk_shingles or len(sets) == 65534:
                        yield from emit()
                        held = 0
        if sets:
            yield from emit()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        """The owners, once for each, of shingles that occur in one document of one chunk only."""
        passed = rows[rows.a.isna() | rows.b.isna()][["chunk", "a", "b"]]
        rows = rows[~(rows.a.isna() | rows.b.isna())]
        if not len(rows):
            return passed
        tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.a])
        owners = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.b])
        chunks = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in rows.a])
        order = np.argsort(tokens)
        first = np.append(True, tokens[order][1:] != tokens[order][:-1])
        lone = order[first & np.append(first[1:], True)]
        lone = np.sort(lone[owners[lone] != 65535])
        cuts = np.searchsorted(chunks[lone], np.arange(len(rows) + 1))
        parts = [owners[lone[i:j]].tobytes() for i, j in zip(cuts, cuts[1:])]
        made = pd.DataFrame({"chunk": rows.chunk.to_numpy(), "a": parts, "b": [b""] * len(parts)})
        return pd.concat([passed, made[made.a.str.len() > 0]])

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows.b[rows.a.isna()].iloc[0]
        sizes = np.frombuffer(rows.a[rows.b.isna()].iloc[0], np.int64).reshape(-1, 2)
        lone = np.zeros(len(sizes), np.int64)
        for x in rows.a[rows.a.notna() & rows.b.notna()]:
            lone += np.bincount(np.frombuffer(x, np.uint16), minlength=len(sizes))
        smallest = least_overlap(sizes[:, 1], percent)  # a linked set has so many shingles at least
        keep = (sizes[:, 0] - lone) >= np.minimum(-(-smallest // 4), -(-sizes[:, 1] // 4))
        return pd.DataFrame({"digest": [nodes[16 * i : 16 * i + 16] for i in keep.nonzero()[0]]})

    return (
        docs.select("text")
        .mapInArrow(send, "block long, chunk long, a binary, b binary")
        .groupBy("block")
        .applyInPandas(meet, "chunk long, a binary, b binary")
        .groupBy("chunk")
        .applyInPandas(judge, "digest binary")
        .distinct()
    )


def sets_of(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, n, tokens (array of long) and bits of the classes in ``digests``, from any of their
    documents. ``bits`` marks the remainders of the shingles: a set of fixed size that bounds overlaps."""

    def bits(tokens: np.ndarray) -> np.ndarray:
        marks = np.zeros(BITS, np.uint8)
        marks[tokens % np.uint64(BITS)] = 1
        return np.packbits(marks).view(np.int64)

    def run(batches):
        for part in sliced(batches):
            sets = [s for s in shingle_sets(part.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([signature(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([bits(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["digest", "n", "tokens", "bits"],
            )

    found = docs.select("text").mapInArrow(run, "digest binary, n long, tokens array<long>, bits array<long>")
    one = F.first(F.struct("tokens", "bits")).alias("one")
    return found.join(digests.hint("merge"), "digest", "left_semi").groupBy("digest", "n").agg(one).select("digest", "n", "one.*")


def prefixes(sets: DataFrame, settings: Settings) -> DataFrame:
    """node, n, m, held, weight, prefix and rest of each class that can have a link (step 2).

    ``prefix`` has the shared shingles of the adaptive prefix as (df, token) in order, ``rest``
    counts the shingles behind it, ``held`` all shingles that any other class has, and ``weight``
    is their mean frequency: the original of many copies weighs most among them.
    """
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    lists = tokens.join(frequent, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    lists = lists.join(sets.select("node", "n"), "node").select("node", "n", "shared")
    percent, most, verify = settings.percent, settings.max_match, settings.verify_cost

    def choose(batches):
        for batch in batches:
            counts, sizes = batch.column(1).to_pylist(), batch.column(2).value_lengths().to_pylist()
            df = batch.column(2).flatten().field("df").to_numpy(zero_copy_only=False)
            out, at = [], 0
            for n, held in zip(counts, sizes):
                costs = np.concatenate([[0], np.cumsum(df[at : at + held] - 1)])
                lone = n - held  # shingles of no other class come first
                base = n - least_overlap(n, percent)
                best = (float("inf"), 0, 0)
                # Linked sets may share no more than their least overlap, so no more may be asked for.
                for m in range(1, min(most, n - base) + 1):
                    length = base + m - lone
                    if length < m:
                        break
                    best = min(best, (costs[length] * (1 + verify / m), m, length))
                out.append((best[1], best[2], held, costs[-1] / n))
                at += held
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["node", "n", "shared", "m", "length", "held", "weight"])

    kind = lists.schema["shared"].dataType.simpleString()
    chosen = lists.select("node", "n", "shared").mapInArrow(choose, f"node long, n long, shared {kind}, m int, length int, held long, weight double")
    return chosen.filter("length > 0").select(
        "node", "n", "m", "held", "weight", F.slice("shared", F.lit(1), F.col("length")).alias("prefix"), (F.col("held") - F.col("length")).alias("rest")
    )


def close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that may reach the similarity, by the remainders of their shingles.

    Each remainder that one set has and the other lacks is a shingle at least that they do not share.
    """
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
    most = F.least(F.col("na") - lacks("bitsa", "bitsb"), F.col("nb") - lacks("bitsb", "bitsa"))
    return both.withColumn("most", most).filter(100 * F.col("most") >= percent * (F.col("na") + F.col("nb") - F.col("most"))).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, by their full sets; a stored table."""
    pairs = stored(close(pairs, sets, percent), "ngram-close")
    if pairs.isEmpty():
        return pairs
    # Sets travel once to the pairs, as two rows of each.
    sides = pairs.withColumn("node", F.explode(F.array("a", "b")))
    both = sides.join(sets.select("node", "n", "tokens"), "node").groupBy("a", "b").agg(F.collect_list(F.struct("n", "tokens")).alias("s"))
    shared = F.size(F.array_intersect(F.col("s")[0].tokens, F.col("s")[1].tokens))
    linked = both.filter(100 * shared >= percent * (F.col("s")[0].n + F.col("s")[1].n - shared)).select("a", "b")
    found = stored(linked, "ngram-links")
    removed(pairs)
    return found


def salt_of(node: Column, df: Column, hot: int) -> Column:
    return F.pmod(F.xxhash64(node), F.ceil(df / hot).cast("long"))


def may_reach(n1, held1, n2, held2, percent: int) -> Column:
    """Can two classes reach the similarity, by their sizes and the shingles that others have at all?"""
    most = F.least(held1, held2)
    return 100 * most >= percent * (F.col(n1) + F.col(n2) - most)


def star_pairs(listed: DataFrame, round_no: int, settings: Settings) -> DataFrame:
    """Each class with one member of each of its lists, where that is in another component.

    The first round takes the member of largest weight, later ones draw one for each list.
    """
    hot = settings.hot_list
    drawn = F.xxhash64(F.lit(round_no), "token", "comp", "node")
    by = F.struct(F.negate("weight"), "node") if round_no == 0 else F.struct(drawn, "node")
    hubs = listed.groupBy("token").agg(
        F.min_by(F.struct(*(F.col(c).alias(f"hub_{c}") for c in ("node", "n", "held", "comp"))), by).alias("h"), F.max("df").alias("df")
    )
    hubs = hubs.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("df") / hot).cast("long") - 1)).alias("salt"), "h.*")
    pairs = listed.withColumn("salt", salt_of(F.col("node"), F.col("df"), hot)).join(hubs, ["token", "salt"])
    fits = may_reach("n", "held", "hub_n", "hub_held", settings.percent) & (F.col("comp") != F.col("hub_comp"))
    return pairs.filter(fits).select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()


def cross_pairs(listed: DataFrame, chosen: DataFrame, settings: Settings) -> DataFrame:
    """All pairs of classes in different components that share enough prefix shingles, each once.

    A pair counts in the list of its first shared prefix shingle. Of the class whose prefix ends
    first every prefix shingle that the other has lies in the other's prefix too, so the shared
    prefix shingles and that class's rest bound the whole overlap.
    """
    mixed = listed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    part = listed.select("token", "node", "comp").join(mixed, "token", "left_semi")
    ordered = chosen.select("node", "n", "m", "held", "rest", F.col("prefix.token").alias("tokens"), F.element_at("prefix", -1).alias("last"))
    part = stored(part.join(ordered, "node"), "ngram-mixed")
    x, y = part.alias("x"), part.alias("y")
    same = F.array_intersect("x.tokens", "y.tokens")
    overlap = F.size(same) + F.when(F.col("x.last") < F.col("y.last"), F.col("x.rest")).otherwise(F.col("y.rest"))
    fits = (
        (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
        & may_reach("x.n", "x.held", "y.n", "y.held", settings.percent)
        & (F.get(same, F.lit(0)) == F.col("x.token")) & (F.size(same) >= F.least("x.m", "y.m"))
        & (100 * overlap >= settings.percent * (F.col("x.n") + F.col("y.n") - overlap))
    )
    return x.join(y, (F.col("x.token") == F.col("y.token")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node of each node's component, by labels with shortcuts.

    Labels are written to the shared folder in every round, until none changes. Rows that meet by a
    node of many neighbours are combined before they are dealt by node.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "ngram-edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "ngram-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        step = stored(step, "ngram-step")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        moved = stored(step.join(jump, "comp").select("node", "old", F.col("root").alias("comp")), "ngram-labels")
        removed(step, labels)
        labels = moved.select("node", "comp")
        if moved.filter("comp <> old").isEmpty():
            removed(both)
            return labels


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest linked doc_id) of each document."""
    docs = docs.select("doc_id", "text")
    known = stored(signatures(docs), "ngram-signatures")
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    left = stored(survivors(docs, total, settings), "ngram-survivors")
    key = F.coalesce("doc_id", F.lit(-1).cast(docs.schema["doc_id"].dataType))
    # Copies are combined before classes meet anything, however many they are.
    classes = known.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min(key).alias("pick"))
    classes = stored(classes, "ngram-classes")
    picks = classes.join(left, "digest", "left_semi").select("pick").distinct()
    # The picked ids grow with the input, so they are never broadcast, at any size.
    picked = docs.withColumn("pick", key).join(picks.hint("merge"), "pick", "left_semi")
    sets = stored(sets_of(picked, left).withColumn("node", F.monotonically_increasing_id()), "ngram-sets")
    removed(left)
    chosen = stored(prefixes(sets, settings), "ngram-prefixes")
    lists = chosen.select("node", "n", "m", "held", "weight", F.explode("prefix").alias("p")).select("*", "p.token", "p.df").drop("p")
    listed = stored(lists.withColumn("comp", F.col("node")), "ngram-listed")
    edges, labels = None, None
    for round_no in range(settings.star_rounds):
        found = verified(star_pairs(listed, round_no, settings), sets, settings.percent)
        if found.isEmpty():
            break
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
        comp = F.coalesce(F.col("new"), F.col("node"))
        removed(listed)
        listed = stored(lists.join(labels.withColumnRenamed("comp", "new"), "node", "left").withColumn("comp", comp).drop("new"), "ngram-listed")
    found = verified(cross_pairs(listed, chosen, settings), sets, settings.percent)
    if not found.isEmpty():
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
    if labels is None:
        placed = classes.select("digest", F.col("first").alias("component_id"))
    else:
        linked = labels.join(sets.select("node", "digest"), "node").select("digest", "comp")
        linked = stored(classes.join(linked, "digest", "left"), "ngram-linked")
        # Classes of no link meet nothing; those of one large component are dealt to several tasks.
        alone, linked = linked.filter("comp IS NULL"), linked.filter("comp IS NOT NULL")
        least = linked.groupBy("comp").agg(F.min("first").alias("component_id"))
        least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        linked = linked.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(least, ["comp", "salt"])
        placed = alone.select("digest", F.col("first").alias("component_id")).unionByName(linked.select("digest", "component_id"))
    placed = stored(placed, "ngram-components")
    removed(sets, chosen, listed)
    return known.join(placed, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
