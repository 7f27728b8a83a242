"""Distributed batch inference over sequence windows with a caller-supplied predictor."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import bin_key
from ..sources import sinks
from ..sources.reference import Reference
from ..sources.scratch import stored
from . import blocks, genome, scoring, tracks

SIGNALS = "row_id long, chrom string, bin_idx int, bin_start long, bin_end long, context_id long, context string, ref_signal double, alt_signal double"


KEYS = ["row_id", "chrom", "bin_idx", "bin_start", "bin_end"]


def _in_blocks(bins: DataFrame, contexts: DataFrame, run: Callable, schema: str, block: int, held: int) -> DataFrame:
    """What ``run`` makes of each batch of bins with each block of contexts (a table and the number of its first
    line in the catalogue), inside the tasks: no bin is copied for a context on its way there. The catalogue is of
    parameter size and travels with the task, at most ``held`` lines of it; a longer one is dealt in such parts."""
    first = ["context_id", "context"]
    catalogue = contexts.select(*first, *(c for c in contexts.columns if c not in first)).orderBy("context_id").toPandas()

    def over(start: int) -> DataFrame:
        part = catalogue.iloc[start : start + held]

        def task(batches):
            for pdf in batches:
                for at in range(0, len(part) if len(pdf) else 0, block):
                    yield from run(pdf, part.iloc[at : at + block], start + at)

        return bins.mapInPandas(task, schema)

    made = [over(start) for start in range(0, max(len(catalogue), 1), held)]
    return reduce(DataFrame.unionByName, made)


def predict(bins: DataFrame, contexts: DataFrame, predictor: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], block: int = 64, held: int = 65_536, lines: int = 65_536) -> DataFrame:
    """SIGNALS of every bin in every context.

    ``bins`` has row_id, chrom, bin_idx, bin_start, bin_end and what the predictor reads; restrict
    it to the effect region first, since Spark moves no filter through Python. ``predictor`` gets
    at most about ``lines`` pairs of a bin and a context as a table, with the columns of both, and returns arrays
    of REF and ALT signals. Pairs are made inside the task; ``predict_effects`` makes none. It is pickled
    once and may keep its weights in a closure. No bins or no contexts give no rows.
    """

    def run(pdf: pd.DataFrame, some: pd.DataFrame, _: int):
        step = max(1, lines // len(some))
        for at in range(0, len(pdf), step):
            chunk = pdf.iloc[at : at + step]
            pairs = chunk.iloc[np.repeat(np.arange(len(chunk)), len(some))].reset_index(drop=True)
            pairs = pairs.assign(**{c: some[c].to_numpy()[np.tile(np.arange(len(some)), len(chunk))] for c in some.columns})
            ref, alt = predictor(pairs)
            yield pairs[[*KEYS, "context_id", "context"]].assign(ref_signal=np.asarray(ref, float), alt_signal=np.asarray(alt, float))

    return _in_blocks(bins, contexts, run, SIGNALS, block, held)


def bin_sequences(windows: DataFrame, window: int, edge: int, width: int) -> DataFrame:
    """Bins of usable windows, each with its part of the REF and the ALT sequence."""
    usable = windows.filter("ref_seq IS NOT NULL")
    n = (window - 2 * edge) // width
    bins = usable.select("row_id", "chrom", "window_start", "ref_seq", "alt_seq", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin_idx"))
    start = edge + F.col("bin_idx") * width
    part = lambda c: F.substring(c, (start + 1).cast("int"), F.lit(width))
    at = F.col("window_start") + start
    return bins.select("row_id", "chrom", "bin_idx", at.alias("bin_start"), (at + width).alias("bin_end"), part("ref_seq").alias("ref_bin"), part("alt_seq").alias("alt_bin"))


def gc_predictor(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Arithmetic stand-in for a network: G and C of a bin, scaled by the context's number."""
    scale = (batch.context_id.to_numpy() + 1) / 10.0
    count = lambda s: (s.str.count("G") + s.str.count("C")).to_numpy()
    return count(batch.ref_bin) * scale, count(batch.alt_bin) * scale


def gc_block(bins: pd.DataFrame, contexts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``gc_predictor`` for all bins of a batch in all contexts of a block at once."""
    scale = (contexts.context_id.to_numpy() + 1) / 10.0
    count = lambda s: (s.str.count("G") + s.str.count("C")).to_numpy()
    return np.multiply.outer(count(bins.ref_bin), scale), np.multiply.outer(count(bins.alt_bin), scale)


def _row_sums(pdf: pd.DataFrame, some: pd.DataFrame, predictor) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The rows of a batch of bins and, as arrays of rows x contexts, the sums over their bins."""
    pdf = pdf.sort_values("row_id", kind="stable")
    rows, firsts = np.unique(pdf["row_id"].to_numpy(), return_index=True)
    ref, alt = (np.asarray(x, float) for x in predictor(pdf, some))
    of_bins = {"ref": ref, "alt": alt, "diff": alt - ref, "size": np.abs(alt - ref)}
    return rows, {k: np.add.reduceat(x, firsts, axis=0) for k, x in of_bins.items()}


SUMS = "row_id long, context_id long, context string, ref double, alt double, diff double, size double"


def predict_effects(bins: DataFrame, contexts: DataFrame, predictor=gc_block, scoring_mode: str = "signed_sum_abs", block: int = 1024, held: int = 65_536) -> DataFrame:
    """row_id, context_id, context and effect, with bins and contexts meeting inside the task.

    ``predictor`` gets a batch of bins and a table of at most ``block`` contexts and returns REF and ALT
    signals as arrays of bins x contexts. A task sums them over the bins of each row before they leave
    it, so what is shuffled has one line for each row and context, and no line carries a sequence. The
    catalogue of contexts travels with the task, at most ``held`` of them; a longer one is dealt in
    parts of that size. A null signal makes the sums of its row null; no contexts or no bins give no rows.
    """
    def run(pdf: pd.DataFrame, some: pd.DataFrame, _: int):
        rows, sums = _row_sums(pdf, some, predictor)
        names = {c: np.tile(some[c].to_numpy(), len(rows)) for c in ("context_id", "context")}
        yield pd.DataFrame({"row_id": np.repeat(rows, len(some)), **names, **{k: x.ravel() for k, x in sums.items()}})

    sums = _in_blocks(bins, contexts, run, SUMS, block, held)
    return scoring.score_sums(sums, scoring_mode, ("row_id", "context_id", "context"))


BLOCK_SUMS = "row_id long, block int, ref array<double>, alt array<double>, diff array<double>, size array<double>"


def predict_blocks(bins: DataFrame, contexts: DataFrame, predictor=None, scoring_mode: str = "signed_sum_abs", width: int = blocks.WIDTH, held: int = 65_536) -> DataFrame:
    """The effects of ``predict_effects`` as blocks (row_id, block, values) of ``width`` contexts in the order of
    ``blocks.positions``: no line for each row and context on the way. Parts of a row, of which there are at most as many
    as it has bins, are added place by place."""
    if held % width:
        raise ValueError("held must be a multiple of width")

    def run(pdf: pd.DataFrame, some: pd.DataFrame, start: int):
        rows, sums = _row_sums(pdf, some, predictor or gc_block)
        padded = {k: np.pad(x, ((0, 0), (0, width - len(some))), constant_values=np.nan) for k, x in sums.items()}
        yield pd.DataFrame({"row_id": rows, "block": np.int32(start // width), **{k: list(x) for k, x in padded.items()}})

    sums = _in_blocks(bins, contexts, run, BLOCK_SUMS, width, held)
    names = ("ref", "alt", "diff", "size")
    parts = sums.groupBy("row_id", "block").agg(F.collect_list(F.struct(*names)).alias("parts"))

    def add(a, b):
        return F.struct(*(F.zip_with(a[n], b[n], lambda x, y: x + y).alias(n) for n in names))

    total = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0], add)
    place = F.arrays_zip(*(F.col(f"total.{n}").alias(n) for n in names))
    effect = scoring.effect_of_sums(scoring_mode)
    whole = parts.select("row_id", "block", total.alias("total")).select("row_id", "block", F.transform(place, effect).alias("values"))
    return whole.withColumn("values", blocks.without_nan("values"))


def infer_effects(variants: DataFrame, reference: DataFrame | Reference, contigs: DataFrame | None, contexts: DataFrame, predictor=gc_block, scoring_mode: str = "signed_sum_abs", window: int = 196_608, edge: int = tracks.EDGE, width: int = tracks.BIN, regions: DataFrame | None = None, **options) -> DataFrame:
    """One effect for each input row and context; ``regions`` (row_id, effect_start, effect_end) limits the bins.
    ``predictor`` is that of ``predict_effects``."""
    bins = bin_sequences(genome.build_windows(variants, reference, contigs, window, **options), window, edge, width)
    if regions is not None:
        bins = tracks.restrict_to_region(bins, regions)
    return predict_effects(bins, contexts, predictor, scoring_mode)


def infer_tracks(signals: DataFrame, scoring_mode: str = "signed_sum_abs", windows: DataFrame | None = None, features: DataFrame | None = None, regions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of an inference over predicted ``signals``: effects (within ``regions`` where they
    are given), raw tracks, normalised tracks and their difference, and, where they are given, the
    sequences (``windows`` of ``build_windows``), the ``features`` of bins and the effect ``regions``."""
    normed = tracks.normalise_tracks(signals)
    scored = signals if regions is None else tracks.restrict_to_region(signals, regions)
    made = {"effects": scoring.score_effects(scored, scoring_mode), "tracks": signals, "normed": normed, "diff": tracks.diff_tracks(normed)}
    if windows is not None:
        made["sequences"] = windows.select("row_id", "chrom", "window_start", "ref_seq", "alt_seq", "status")
    given = {"features": features, "regions": regions}
    return made | {k: v for k, v in given.items() if v is not None}


# The names of the written tables, with the table and the value of each.
OUTPUTS = {
    "context_effects": ("effects", "effect"),
    "ref_signals": ("tracks", "ref_signal"),
    "alt_signals": ("tracks", "alt_signal"),
    "ref_signals_normed_and_ordered": ("normed", "ref_normed"),
    "alt_signals_normed_and_ordered": ("normed", "alt_normed"),
    "diff_signals": ("diff", "diff"),
}


def write_inference(made: dict[str, DataFrame], prefix: str) -> dict[str, str]:
    """Writes the effects and signals of ``infer_tracks`` as wide matrices of one column for each context, and returns
    the paths by name.

    Signals have a line for each bin, named ``row:chrom_start_end``, as windows of several variants may share bins; effects
    have one for each row. Contexts stand in order of their names. Each table is computed once, from the shared folder.
    """
    held = {k: stored(made[k], k) for k in ("tracks", "normed", "diff")}
    paths = {}
    for name, (table, value) in OUTPUTS.items():
        if table == "effects":
            paths[name] = sinks.write_matrix(made[table], prefix, name, value)
        else:
            key = F.concat_ws(":", F.col("row_id").cast("string"), bin_key())
            paths[name] = sinks.write_matrix(held[table].withColumn("bin", key), prefix, name, value, row="bin")
    return paths


# Cody's rational approximations of the error function, by range of |x|.
ERF_SMALL = ((3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1), (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03))
ERF_MIDDLE = (
    (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8),
    (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function of whole arrays, to about 1e-15 (1e-8 of its distance from 1 beyond |x| = 4)."""

    def ratio(coefficients, z):
        above, below = coefficients
        top, bottom = above[-1] * z, z
        for p, q in zip(above[:-2], below[:-1]):
            top, bottom = (top + p) * z, (bottom + q) * z
        return (top + above[-2]) / (bottom + below[-1])

    y = np.abs(x)
    small = x * ratio(ERF_SMALL, np.minimum(y, 0.46875) ** 2)
    far = np.clip(y, 0.46875, 6)
    large = np.copysign(1 - np.exp(-far * far) * ratio(ERF_MIDDLE, far), x)
    return np.where(y <= 0.46875, small, large)


def head_predictor(weights: dict, activation: str = "gelu", layer_norm: bool = False, relu_out: bool = True, stage: str = "output"):
    """A predictor from the weights of a context head.

    The input of a batch is a feature array ``features`` and a context array ``vector``; the
    genome projection act(W g + b) follows the context vector into dense layers and a linear
    output. ``stage`` is output, genome (the projection) or the number of a hidden layer.
    """
    acts = {
        "relu": lambda x: np.maximum(x, 0),
        "gelu": lambda x: 0.5 * x * (1 + _erf(x / np.sqrt(2))),
    }
    act = acts[activation]

    # Dense layers; the last one is linear. The first meets the context and the genome part one after the other.
    dense = [*weights["layers"], (weights["out_w"], weights["out_b"])]
    width = weights["genome_w"].shape[0]
    first_w, first_b = dense[0]

    def genome_part(features: np.ndarray) -> np.ndarray:
        return act(features @ weights["genome_w"].T + weights["genome_b"])

    def of_genome(part: np.ndarray) -> np.ndarray:
        return part @ first_w[:, -width:].T

    def of_context(vector: np.ndarray) -> np.ndarray:
        return vector @ first_w[:, :-width].T + first_b

    def finish(x: np.ndarray) -> np.ndarray:
        for n, (w, b) in enumerate(dense):
            x = x @ w.T + b if n else x
            if n == len(dense) - 1:
                return np.maximum(x, 0) if relu_out else x
            if layer_norm:
                x = (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)
            x = act(x)
            if stage == n:
                return x

    def forward(features: np.ndarray, vector: np.ndarray) -> np.ndarray:
        part = genome_part(features)
        return part if stage == "genome" else finish(of_context(vector) + of_genome(part))

    def pairs(features: np.ndarray, vectors: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
        """Bins x contexts of the output: the first layer's products are made once for a bin and once for a context."""
        left, right = of_genome(genome_part(features)), of_context(vectors)
        step = max(1, cells // max(1, right.shape[0] * max(w.shape[0] for w, _ in dense)))
        made = [finish(left[at : at + step, None, :] + right[None, :, :])[..., 0] for at in range(0, len(left), step)]
        return np.concatenate(made) if made else np.zeros((0, len(right)))

    forward.pairs = pairs
    return forward


def head_block(weights: dict, **options):
    """A predictor for ``predict_effects`` and ``predict_blocks`` from the weights of a context head.

    Bins have the arrays ref_features and alt_features, contexts the array ``vector`` (``with_context_vectors``);
    a null array gives null signals.
    """
    forward = head_predictor(weights, **options)

    def arrays(column: pd.Series, size: int) -> np.ndarray:
        made = [np.full(size, np.nan) if x is None else np.asarray(x, float) for x in column]
        return np.stack(made) if made else np.zeros((0, size))

    def block(bins: pd.DataFrame, contexts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = weights["genome_w"].shape[1]
        first_w = weights["layers"][0][0] if weights["layers"] else weights["out_w"]
        vectors = arrays(contexts["vector"], first_w.shape[1] - weights["genome_w"].shape[0])
        return forward.pairs(arrays(bins["ref_features"], n), vectors), forward.pairs(arrays(bins["alt_features"], n), vectors)

    return block
