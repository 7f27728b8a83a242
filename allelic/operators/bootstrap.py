"""Bootstrap p-values of variant effects against the background of their locus.

Draws are a pure function of (locus, context, boot, i, seed), so results do not depend on
partitions, order or retries: a counter is mixed by multiplying, shifting and exclusive or in 32
bits, and the high half of the product with n is the index. Counters of a boot are a fixed odd step apart, so
that the draws of any boot are a window of one circle of 2^32 mixed counters: where boots are long, contexts of
a locus share the mixing, and draws in which windows overlap are made once. Boots never become rows on the way
to p-values: the thresholds of a locus and context are drawn once, kept as a sorted array, and
those below each effect are counted by binary search. Background effects reach their locus and context as
Arrow streams that tasks pack. Rows of the background, which count every boot, and effects that all thresholds of their locus and
context lie to one side of are not dealt at all.

Defined cases: a null effect has a null count; background rows count every boot, and so does a
group without any background; rows whose locus or context is null form groups without background.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.scalars import critical_value_sql
from ..sources.scratch import removed, stored

KEYS = ("locus_id", "context_id")
BLOCK = 1 << 14  # draws added up at once
MIXED = 1 << 16  # draws made at once, a multiple of BLOCK: with fewer, calls cost more than what they do
WIDTH = 256  # boots side by side in a block
PACKED = 1 << 20  # background effects that a task packs at once
BATCH = 1 << 18  # stored effects that a task reads at once
TASK_DRAWS, TASK_ROWS, TASKS = 1 << 32, 1 << 22, 4096  # draws and background effects of a task; most tasks for these
GROUP_ROWS = 1 << 18  # effects of one locus and context that a task takes; more are dealt to several

# Two odd multipliers of a 32-bit mixer, and an odd step between counters.
MIX_1, MIX_2, STEP, MASK = 0x21F0AAAD, 0x735A2D97, 0x1E3779B1, 0xFFFFFFFF
CIRCLE = 1 << 32  # counters, all different
STEP_INVERSE = pow(STEP, -1, CIRCLE)
SPAN = 1 << 20  # counters mixed before they are read, a multiple of MIXED
SHARED = CIRCLE  # draws of groups with equally many effects from which on they share the mixing
HELD = 1 << 24  # effects of a locus that a task holds at once
SHARE = 32  # circles of draws that share one mixing of it
COUNTS = 1 << 22  # counts of draws that are multiplied at once
# Nanoseconds of a draw that is gathered and added, of one that is counted, of an edge, of a count times an effect and its square.
GATHERED, COUNTED, EDGE, TIMES = 3.5, 6.0, 4000.0, 0.6


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers whose bits all depend on all of the input's."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX_1)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(MIX_2)
    return x ^ (x >> np.uint32(15))


def mix_sql(x: str, out: str) -> str:
    """The same as columns of a SELECT that may use columns to their left; the last is named ``out``."""
    return (
        f"xor({x}, ({x}) >> 16) AS {out}_1, ({out}_1 * {MIX_1}) & {MASK} AS {out}_2, xor({out}_2, {out}_2 >> 15) AS {out}_3, "
        f"({out}_3 * {MIX_2}) & {MASK} AS {out}_4, xor({out}_4, {out}_4 >> 15) AS {out}"
    )


def group_key(context: int, locus: int, seed: int = 0) -> np.ndarray:
    key = np.zeros(1, np.uint32)
    for value in (seed, context, locus):
        key = mix(key ^ np.uint32(value & MASK))
        key = mix(key ^ np.uint32((value >> 32) & MASK))
    return key


def draws(boots: np.ndarray, n: int, context: int, locus: int, seed: int = 0) -> np.ndarray:
    """Indices below ``n``: one row for each boot, ``n`` draws in it."""
    keys = mix(group_key(context, locus, seed) ^ boots.astype(np.uint32))
    x = mix(keys[:, None] + np.arange(n, dtype=np.uint32) * np.uint32(STEP))
    return (x.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)


def moments(xs: np.ndarray, n_boots: int, context: int, locus: int, seed: int = 0):
    """First boot, means and population deviations, some boots at a time.

    Draws are rows and boots are columns of a block, so each boot's sum takes its draws one after another
    whatever the block's size. Deviations are taken from the mean of all effects, then moved to the boot's."""
    n, key = len(xs), group_key(context, locus, seed)
    finite = xs[np.isfinite(xs)]
    centre = finite.mean() if len(finite) else 0.0
    for at in range(0, n_boots, WIDTH):
        boots = np.arange(at, min(at + WIDTH, n_boots), dtype=np.uint32)
        shape = min(n, max(1, MIXED // len(boots))), len(boots)
        steps = np.arange(shape[0], dtype=np.uint32) * np.uint32(STEP)
        counter, x, y = mix(key ^ boots) + steps[:, None], np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        index, got = np.empty(shape, np.uint64), np.empty(shape)
        total, square = np.zeros(len(boots)), np.zeros(len(boots))
        for first in range(0, n, shape[0]):
            if n - first < len(x):
                counter, x, y, index, got = (a[: n - first] for a in (counter, x, y, index, got))
            # As mix(), without new arrays.
            np.right_shift(counter, np.uint32(16), out=y)
            np.bitwise_xor(counter, y, out=x)
            np.multiply(x, np.uint32(MIX_1), out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(MIX_2), out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.copyto(index, x)
            np.multiply(index, np.uint64(n), out=index)
            np.right_shift(index, np.uint64(32), out=index)
            np.take(xs, index.view(np.int64), out=got, mode="wrap")  # all are in range
            counter += np.uint32(shape[0] * STEP & MASK)
            with np.errstate(invalid="ignore"):
                held = got[0].copy()
                got[0] += total
                np.add.reduce(got, axis=0, out=total)
                got[0] = held
                got -= centre
                square += np.einsum("ij,ij->j", got, got)
        mean = total / n
        with np.errstate(invalid="ignore"):
            yield at, mean, np.sqrt(np.maximum(square / n - (mean - centre) ** 2, 0.0))


class _Windows:
    """The boots of one group as windows of the circle, cut where any begins or ends."""

    def __init__(self, xs: np.ndarray, n_boots: int, key: np.ndarray):
        n, finite = len(xs), xs[np.isfinite(xs)]
        self.n, self.centre = n, finite.mean() if len(finite) else 0.0
        self.xs = xs - self.centre
        starts = (mix(key ^ np.arange(n_boots, dtype=np.uint32)) * np.uint32(STEP_INVERSE)).astype(np.int64)
        ends = starts + n
        self.cuts = np.unique(np.concatenate([[0], starts, ends % CIRCLE]))
        # A window that passes the end of the circle goes on in its second turn.
        self.first = np.searchsorted(self.cuts, starts)
        self.end = np.searchsorted(self.cuts, ends % CIRCLE) + np.where(ends >= CIRCLE, len(self.cuts), 0)
        size = 2 * len(self.cuts)
        depth = np.cumsum(np.bincount(self.first, minlength=size + 1) - np.bincount(self.end, minlength=size + 1))[:size]
        self.drawn = depth.reshape(2, -1).any(axis=0)
        self.totals = np.zeros((2, len(self.cuts)))  # of the effects less their centre, and of the squares

    def pieces(self, low: int, high: int):
        """Begin, end and cut of each stretch between cuts that some window covers, by blocks of counters."""
        inside = self.cuts[np.searchsorted(self.cuts, low) : np.searchsorted(self.cuts, high)]
        before = np.searchsorted(self.cuts, low, "right") - 1
        if not self.drawn[before : before + len(inside) + 1].any():
            return inside[:0], inside[:0], inside[:0]
        begin = np.union1d(inside, np.arange(low, high, BLOCK))
        cut = np.searchsorted(self.cuts, begin, "right") - 1
        kept = self.drawn[cut]
        return begin[kept], np.append(begin[1:], high)[kept], cut[kept]

    def moments(self):
        # Of two turns and a last zero, so that every window is a run.
        ends = np.column_stack([self.first, self.end]).ravel()
        total, square = (np.add.reduceat(np.concatenate([t, t, [0.0]]), ends)[::2] for t in self.totals)
        off = total / self.n
        with np.errstate(invalid="ignore"):
            return self.centre + off, np.sqrt(np.maximum(square / self.n - off**2, 0.0))


def _mixed(first: int, n: int, x: np.ndarray, y: np.ndarray, index: np.ndarray) -> None:
    """Places below ``n`` that counters ``first`` and after draw, as many as ``index`` holds; as mix(), without new arrays."""
    np.multiply(np.arange(first, first + len(index), dtype=np.uint32), np.uint32(STEP), out=x)
    np.right_shift(x, np.uint32(16), out=y)
    np.bitwise_xor(x, y, out=x)
    np.multiply(x, np.uint32(MIX_1), out=x)
    np.right_shift(x, np.uint32(15), out=y)
    np.bitwise_xor(x, y, out=x)
    np.multiply(x, np.uint32(MIX_2), out=x)
    np.right_shift(x, np.uint32(15), out=y)
    np.bitwise_xor(x, y, out=x)
    np.copyto(index, x)
    np.multiply(index, np.uint64(n), out=index)
    np.right_shift(index, np.uint64(32), out=index)


def _walk(windows: list[_Windows], low: int, high: int) -> None:
    """Adds up what the windows draw by counters [low, high), ``SPAN`` of them at a time.

    The places are mixed once and then read by one group after another, whose effects stay in cache meanwhile."""
    n = windows[0].n
    x, y = np.empty(MIXED, np.uint32), np.empty(MIXED, np.uint32)
    index, got = np.empty(min(SPAN, high - low), np.uint64), np.empty(BLOCK)
    place = index.view(np.int64)
    for span in range(low, high, SPAN):
        found = [w.pieces(span, min(span + SPAN, high)) for w in windows]
        for block in np.unique(np.concatenate([begin // MIXED for begin, _, _ in found])).tolist():
            _mixed(block * MIXED, n, x, y, index[block * MIXED - span : (block + 1) * MIXED - span])
        with np.errstate(invalid="ignore"):
            for w, pieces in zip(windows, found):
                for first, last, cut in zip(*(p.tolist() for p in pieces)):
                    drawn = np.take(w.xs, place[first - span : last - span], out=got[: last - first], mode="wrap")  # all are in range
                    w.totals[0, cut] += drawn.sum()
                    w.totals[1, cut] += drawn.dot(drawn)


def _coded(table: np.ndarray):
    """The distinct rows of ``table`` and, for each of its rows, which of them it is."""
    code = np.zeros(len(table), np.int64)
    for column in table.T:
        values, at = np.unique(column, return_inverse=True)
        found, code = np.unique(code * len(values) + at, return_inverse=True)
        if len(found) == len(table):
            return table, np.arange(len(table))
    first = np.empty(len(found), np.int64)
    first[code] = np.arange(len(table))
    return table[first], code.astype(np.uint16 if len(found) <= 1 << 16 else np.int64)


def _block_length(n: int, n_boots: int, rows: int, contexts: int) -> int | None:
    """Counters of a block for ``counted_moments``, or None where gathering each draw is less work."""
    work = {}
    length = BLOCK
    while length <= n:
        multiplied = CIRCLE // length * rows * contexts * TIMES
        work[length] = CIRCLE * COUNTED + multiplied + 2 * contexts * n_boots * (length / 4 * GATHERED + EDGE)
        length *= 2
    best = min(work, key=work.get, default=None)
    return best if best and work[best] < n * n_boots * contexts * GATHERED else None


def counted_moments(rows: np.ndarray, code: np.ndarray, n_boots: int, keys: list[np.ndarray], length: int):
    """Means and population deviations of the boots of groups that have equally many finite effects each.

    These are the draws of ``moments``. The circle is cut into blocks of ``length`` counters. How often a block draws each
    of ``rows``, the distinct rows of effects side by side, is counted once for all groups, and sums of blocks are products with
    these counts. Draws are gathered one by one only between an end of a boot and the nearest end of a block."""
    n, contexts, blocks = len(code), len(keys), CIRCLE // length
    centre = (np.bincount(code, minlength=len(rows)) @ rows) / n
    table = np.concatenate([rows - centre, (rows - centre) ** 2], axis=1)
    values = np.ascontiguousarray(table[:, :contexts].T)
    starts = np.stack([mix(key ^ np.arange(n_boots, dtype=np.uint32)) * np.uint32(STEP_INVERSE) for key in keys]).astype(np.int64)
    # Boots that pass the end of the circle go on in its second turn.
    edges = np.stack([starts, starts + n])
    nearest = (edges + length // 2) // length
    # What lies between the nearest end of a block and the edge: of effects and of squares, negative before that end.
    beside = np.zeros((2, edges.size))
    place, inside = np.divmod(edges.ravel() % CIRCLE, length)
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(blocks + 1)).tolist()
    depth = np.bincount(nearest[0].ravel(), minlength=2 * blocks + 1) - np.bincount(nearest[1].ravel(), minlength=2 * blocks + 1)
    wanted = np.flatnonzero(np.cumsum(depth)[: 2 * blocks].reshape(2, -1).any(axis=0) | (np.diff(bounds) > 0))
    held = max(1, COUNTS // len(rows))
    counts, sums = np.empty((held, len(rows))), np.zeros((2 * contexts, blocks))
    x, y, index = np.empty(MIXED, np.uint32), np.empty(MIXED, np.uint32), np.empty(MIXED, np.uint64)
    made, got, last = np.empty(max(length, MIXED), code.dtype), np.empty(length), None
    for i, block in enumerate(wanted.tolist()):
        first, at = divmod(block * length, len(made))
        if first != last:
            last = first
            for piece in range(0, len(made), MIXED):
                _mixed(first * len(made) + piece, n, x, y, index)
                np.take(code, index.view(np.int64), out=made[piece : piece + MIXED], mode="wrap")  # all are in range
        drawn = made[at : at + length]
        counts[i % held] = np.bincount(drawn, minlength=len(rows))
        if i % held == held - 1 or i == len(wanted) - 1:
            first = i - i % held
            sums[:, wanted[first : i + 1]] = (counts[: i + 1 - first] @ table).T
        for edge in order[bounds[block] : bounds[block + 1]].tolist():
            at, group = int(inside[edge]), edge // n_boots % contexts
            low, high, sign = (0, at, 1) if at < length // 2 else (at, length, -1)
            some = np.take(values[group], drawn[low:high], out=got[: high - low], mode="wrap")
            beside[0, edge] = sign * some.sum()
            beside[1, edge] = sign * some.dot(some)
    beside = beside.reshape(2, *edges.shape)
    for group in range(contexts):
        # In the order of their first blocks, so that what lies between two boots is short.
        order = np.argsort(nearest[0, group])
        first, end = nearest[:, group, order]
        # Of two turns and a last zero, so that every boot is a run; reduceat gives an empty run its first.
        ends, made = np.column_stack([first, end]).ravel(), np.empty((2, n_boots))
        for i in range(2):
            turns = np.concatenate([sums[group + i * contexts]] * 2 + [[0.0]])
            made[i, order] = np.where(first < end, np.add.reduceat(turns, ends)[::2], 0.0)
        total, square = made + beside[:, 1, group] - beside[:, 0, group]
        off = total / n
        yield centre[group] + off, np.sqrt(np.maximum(square / n - off**2, 0.0))


def window_moments(groups: list[np.ndarray], n_boots: int, keys: list[np.ndarray]):
    """Means and population deviations of the boots of groups with equally many effects each.

    These are the draws of ``moments``. The circle is walked once for all groups, by counts of blocks where ``_block_length`` says so; else each effect that windows of a group
    draw is added up once between two cuts, so the work has a bound however many boots there are."""
    finite = [place for place, xs in enumerate(groups) if np.isfinite(xs).all()]
    if len(finite) * len(groups[0]) * n_boots >= CIRCLE:
        rows, code = _coded(np.stack([groups[p] for p in finite], axis=1))
        length = _block_length(len(code), n_boots, len(rows), len(finite))
        if length:
            found = dict(zip(finite, counted_moments(rows, code, n_boots, [keys[p] for p in finite], length)))
            others = [p for p in range(len(groups)) if p not in found]
            found |= zip(others, window_moments([groups[p] for p in others], n_boots, [keys[p] for p in others]) if others else [])
            return [found[p] for p in range(len(groups))]
    windows = [_Windows(xs, n_boots, key) for xs, key in zip(groups, keys)]
    _walk(windows, 0, CIRCLE)
    return [w.moments() for w in windows]


def boot_moments(groups, n_boots: int, seed: int = 0):
    """locus, context, critical, means and deviations of all boots, of each of ``groups`` in their order.

    Groups of a locus go together, as many as ``HELD`` effects allow, where they draw so much that windows overlap."""

    def made(held):
        by_size, found = {}, {}
        for place, group in enumerate(held):
            by_size.setdefault(len(group[3]), []).append(place)
        for size, places in by_size.items():
            if size * n_boots * len(places) >= SHARED:
                keys = [group_key(held[p][1], held[p][0], seed) for p in places]
                found |= zip(places, window_moments([held[p][3] for p in places], n_boots, keys))
                continue
            for p in places:
                parts = [part[1:] for part in moments(held[p][3], n_boots, held[p][1], held[p][0], seed)]
                found[p] = tuple(np.concatenate(c) for c in zip(*parts))
        for place, (locus, context, critical, _) in enumerate(held):
            yield locus, context, critical, *found[place]

    held, n = [], 0
    for group in groups:
        if held and (group[0] != held[0][0] or n + len(group[3]) > HELD):
            yield from made(held)
            held, n = [], 0
        held.append(group)
        n += len(group[3])
    if held:
        yield from made(held)


def _is_background(name: str = "var_label"):
    return F.coalesce(F.col(name) == "background", F.lit(False))


def _stream(columns: list[pa.Array]) -> bytes:
    batch, sink = pa.RecordBatch.from_arrays(columns, names=["ids", "xs"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack(batches):
    """Rows (locus_id, context_id, variant_id, x) as one row for each locus and context among some: their number and
    an Arrow stream of ids and xs, so that what follows copies bytes and no single effects."""

    def packed(held):
        table = pa.Table.from_batches(held).combine_chunks()
        keys = [table.column(i).to_numpy() for i in range(2)]
        spans = [int(k.max()) - int(k.min()) + 1 for k in keys]
        if spans[0] * spans[1] <= 1 << 16:  # few groups: one short key
            order = np.argsort(((keys[0] - keys[0].min()) * spans[1] + keys[1] - keys[1].min()).astype(np.uint16), kind="stable")
        else:
            order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.append(starts, len(order)))
        columns = [table.column(i).take(pa.array(order)).combine_chunks() for i in (2, 3)]
        held = [_stream([c.slice(at, n) for c in columns]) for at, n in zip(starts.tolist(), sizes.tolist())]
        return pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in keys), pa.array(sizes), pa.array(held, pa.binary())], names=[*KEYS, "n", "held"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACKED:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _background_of(file: str):
    """Batches (locus_id, context_id, variant_id, x) of the background rows with an effect in a stored file."""
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        held = pq.ParquetFile(source, read_dictionary=["var_label"])
        for batch in held.iter_batches(BATCH, columns=[*KEYS, "variant_id", "effect", "var_label"], use_threads=False):
            known = pc.equal(batch.column("var_label"), "background")
            for c in (*KEYS, "effect"):
                known = pc.and_kleene(known, pc.is_valid(batch.column(c)))
            batch = batch.filter(known)  # null is dropped
            columns = [batch.column(c).cast(pa.int64()) for c in KEYS]
            columns += [batch.column("variant_id"), pc.abs(batch.column("effect").cast(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "variant_id", "x"])


def packed_background(source: DataFrame) -> DataFrame:
    """Packed rows of the background of ``source``, a stored table: tasks read its files as columns, as rows would cost
    far more to hand to Python than to pack."""
    files, spark = sorted(source.inputFiles()), source.sparkSession

    def run(batches):
        yield from pack(rows for batch in batches for i in batch.column(0).to_pylist() for rows in _background_of(files[i]))

    return spark.range(0, len(files), 1, max(len(files), 1)).mapInArrow(run, "locus_id long, context_id long, n long, held binary")


def background_arrays(labelled: DataFrame, n_boots: int, critical: DataFrame | None = None, is_stored: bool = False) -> DataFrame:
    """locus_id, context_id, n and held: the absolute background effects of each locus and context in packed
    rows, and their locus's ``critical``, dealt to tasks and sorted there for ``groups``. A table that is not stored as
    it is (``is_stored``) is stored first, its background alone."""
    if not is_stored:
        labelled = stored(labelled.filter(_is_background()).select(*KEYS, "variant_id", "effect", "var_label"), "rows")
    packed = stored(packed_background(labelled), "background")
    total, loci, pairs = packed.agg(F.sum("n"), F.countDistinct("locus_id"), F.countDistinct(*KEYS)).first()
    # Few bytes may stand for many draws.
    tasks = min(TASKS, max(-(-(total or 0) * n_boots // TASK_DRAWS), -(-(total or 0) // TASK_ROWS)))
    tasks = max(tasks, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if critical is not None:
        packed = packed.join(critical.select("locus_id", "critical"), "locus_id")
    parts = locus_parts(total or 0, loci, pairs, n_boots, labelled.sparkSession.sparkContext.defaultParallelism)
    # Contexts of a locus that draw most of the circle come to one task, others to any.
    if parts is None:
        dealt = packed.repartition(tasks, *KEYS)
    else:  # by ranges, as these are few and long: no two share a task by their hash
        dealt = packed.repartitionByRange(tasks, "locus_id", F.pmod(F.xxhash64("context_id"), F.lit(parts)))
    return dealt.sortWithinPartitions(*KEYS)


def locus_parts(effects: int, loci: int, pairs: int, n_boots: int, cores: int) -> int | None:
    """Parts into which the contexts of a locus are dealt, each mixing the circle for itself, or None if they share little."""
    circles = effects * n_boots / max(loci, 1) / CIRCLE  # drawn for a locus
    parts = max(int(-(-circles // SHARE)), -(-4 * cores // max(loci, 1)))
    return parts if effects >= BLOCK * pairs and circles >= parts else None


def groups(batches):
    """locus, context, critical (or None) and the effects in the order of variant ids, of each group of sorted packed rows."""

    def whole(key, held):
        table = pa.concat_tables(pa.ipc.open_stream(part).read_all() for part in held)
        order = pc.sort_indices(table, sort_keys=[("ids", "ascending"), ("xs", "ascending")], null_placement="at_start")
        return *key, table.column("xs").take(order).to_numpy()

    last, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in KEYS]
        columns.append(batch.column("critical").to_pylist() if "critical" in batch.schema.names else [None] * batch.num_rows)
        streams = batch.column("held")
        for row, key in enumerate(zip(*columns)):
            if held and key != last:
                yield whole(last, held)
                held = []
            last = key
            held.append(streams[row].as_py())
    if held:
        yield whole(last, held)


def bootstrap_null(labelled: DataFrame, n_boots: int = 10_000, min_std: float = 0.01, seed: int = 0) -> DataFrame:
    """locus_id, context_id, boot, boot_mean and boot_std (population, at least ``min_std``), one row a boot."""
    names = [*KEYS, "boot", "boot_mean", "boot_std"]

    def run(batches):
        for locus, context, _, mean, std in boot_moments(groups(batches), n_boots, seed):
            keys = [pa.repeat(pa.scalar(k, pa.int64()), n_boots) for k in (locus, context)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(n_boots)), pa.array(mean), pa.array(np.maximum(std, min_std))], names=names)

    return background_arrays(labelled, n_boots).mapInArrow(run, "locus_id long, context_id long, boot long, boot_mean double, boot_std double")


def critical_values(labelled: DataFrame, p_cut: float = 0.05) -> DataFrame:
    """locus_id, n_tests (non-background rows x contexts) and the two-sided critical value."""
    tests = F.sum(F.when(F.col("var_label") != "background", 1).otherwise(0)).cast("long")
    counts = labelled.groupBy("locus_id").agg(tests.alias("n_tests")).filter("n_tests > 0")
    return counts.withColumn("critical", F.expr(critical_value_sql(p_cut, "n_tests")))


def thresholds(labelled: DataFrame, critical: DataFrame, n_boots: int = 10_000, min_std: float = 0.01, seed: int = 0, is_stored: bool = False) -> DataFrame:
    """locus_id, context_id and ``limits``, the sorted thresholds mean + critical x std of the boots."""

    def run(batches):
        for locus, context, critical, mean, std in boot_moments(groups(batches), n_boots, seed):
            limits = np.sort(mean + critical * np.maximum(std, min_std))
            yield pa.RecordBatch.from_arrays([pa.array([locus]), pa.array([context]), pa.array([limits], pa.list_(pa.float64()))], names=[*KEYS, "limits"])

    return background_arrays(labelled, n_boots, critical, is_stored).mapInArrow(run, "locus_id long, context_id long, limits array<double>")


def count_nonsig(labelled: DataFrame, n_boots: int = 10_000, min_std: float = 0.01, p_cut: float = 0.05, seed: int = 0, group_rows: int = GROUP_ROWS, source: DataFrame | None = None) -> DataFrame:
    """``labelled`` with n_nonsig: the boots whose threshold the absolute effect does not exceed.

    abs(effect) is not significant in a boot if it is at most mean + critical x std. Effects up to the least threshold
    of their locus and context, or beyond the largest, are counted where they are, and so are rows of the background. Those
    between the two come to their task behind the thresholds, which are drawn once, and stream past them; a
    group of more than ``group_rows`` such rows is dealt to several tasks.
    Backgrounds and numbers of tests come from ``source``, by default ``labelled`` itself: a table from ``stored``
    with the same rows or more, as it is read several times.
    """
    is_stored, source = source is not None, labelled if source is None else source
    # One row a locus, stored so that its size is known.
    critical = stored(critical_values(source, p_cut), "critical")
    drawn = thresholds(source, critical, n_boots, min_std, seed, is_stored)
    limits = stored(drawn, "thresholds")
    removed(drawn)  # packed background and critical values
    # One row a locus and context: most effects need no more than these.
    ends = stored(limits.select(*KEYS, F.get("limits", F.lit(0)).alias("__low"), F.get("limits", F.size("limits") - 1).alias("__high")), "bounds")
    ends = ends.withColumnsRenamed({k: f"__{k}" for k in KEYS})
    # Labels that are null are tested. Only tested rows meet the ends.
    met = labelled.filter(~_is_background()).join(ends, (F.col("locus_id") == F.col("__locus_id")) & (F.col("context_id") == F.col("__context_id")), "left")
    size = F.abs("effect").cast("double")
    above, between = size > F.col("__high"), F.coalesce((size > F.col("__low")) & (size <= F.col("__high")), F.lit(False))
    beside = F.when(F.col("effect").isNotNull(), F.when(above, F.lit(0)).otherwise(F.lit(n_boots))).cast("long")
    settled = met.filter(~between).withColumn("n_nonsig", beside).select(*labelled.columns, "n_nonsig")
    settled = settled.unionByName(labelled.filter(_is_background()).withColumn("n_nonsig", F.lit(n_boots).cast("long")))
    tested = stored(met.filter(between).select(*labelled.columns), "between")
    sizes = tested.groupBy(*KEYS).agg(F.ceil(F.count("*") / group_rows).cast("int").alias("parts"))
    sizes = stored(sizes, "groups")
    # Only hot groups: at most one for each group_rows rows.
    hot = sizes.filter("parts > 1").select(*(F.col(k).alias(f"__{k}") for k in KEYS), "parts")
    of = (F.col("locus_id") == F.col("__locus_id")) & (F.col("context_id") == F.col("__context_id"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("variant_id"), F.col("parts"))).otherwise(0).cast("int")
    rows = tested.join(hot, of, "left").select(*labelled.columns, part.alias("__part"), F.lit(1).alias("__kind"))
    rows = rows.withColumn("__limits", F.lit(None).cast("array<double>"))
    heads = sizes.join(limits, list(KEYS), "left").select(
        *(F.col(c).cast(labelled.schema[c].dataType).alias(c) if c in KEYS else F.lit(None).cast(labelled.schema[c].dataType).alias(c) for c in labelled.columns),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__part"), F.lit(0).alias("__kind"), F.col("limits").alias("__limits"),
    )
    order = [*KEYS, "__part"]
    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(heads).repartition(tasks, *order).sortWithinPartitions(*order, "__kind")
    names = labelled.columns
    at = {c: i for i, c in enumerate(dealt.columns)}

    def run(batches):
        limits = np.zeros(0)
        for batch in batches:
            heads = (batch.column(at["__kind"]).to_numpy() == 0).nonzero()[0]
            size = np.abs(batch.column(at["effect"]).to_numpy(zero_copy_only=False).astype(float))
            below = np.zeros(batch.num_rows, np.int64)
            edges = [0, *heads, batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                if start in heads:
                    held = batch.column(at["__limits"])[int(start)]
                    # A copy, as the batch is released.
                    limits = held.values.to_numpy(zero_copy_only=False).copy() if held.is_valid else np.zeros(0)
                # An effect equal to a threshold does not exceed that boot.
                below[start:end] = np.searchsorted(limits, size[start:end], "left")
            count = pc.if_else(batch.column(at["effect"]).is_valid(), pa.array(n_boots - below), pa.scalar(None, pa.int64()))
            made = pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), count], names=[*names, "n_nonsig"])
            yield made.filter(pc.equal(batch.column(at["__kind"]), 1))

    counted = dealt.mapInArrow(run, T.StructType([*labelled.schema.fields, T.StructField("n_nonsig", T.LongType())]))
    return counted.unionByName(settled)


def boot_pvalues(counted: DataFrame, n_boots: int, pseudo: float = 1.0) -> DataFrame:
    return counted.withColumn("p_value", (F.col("n_nonsig") + pseudo) / (n_boots + pseudo))
