"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled web text train a linear model; with class prior p the risk is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)), minimised by Adam. The prior is
estimated from positives and unlabelled text alone: of a first model, fitted without a fifth of
both, the share of held-back unlabelled texts above a threshold over that of held-back positives
bounds the prior from above, and the least bound is taken. Labels of 0 are never read. A text is seen
as statistics of its characters, words and lines and as hashed trigrams of its character
classes, so scores follow form rather than topic or language.

Defined cases: a null text counts as empty and is scored like any other; rows of null id are scored
but never learned from; without positives or
unlabelled rows every score is the prior; repeated rows get equal results; an empty table gives
an empty table; input columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WORD, field, map_text

_words = re.compile(WORD).findall


@dataclass(frozen=True)
class Settings:
    """``fit_positive`` and ``fit_unlabelled`` bound, in expectation, the rows the fit sees."""

    grams: int = 512
    fit_positive: int = 4000
    fit_unlabelled: int = 6000
    rounds: int = 400
    first_rounds: int = 120  # of the model that estimates the prior
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 11


# The character classes whose trigrams are counted.
CLASSES = [" \t", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "#*$%&", "|<>", "-_/\\", "\"'()[]{}", ":;=+@"]
STATS = 18
#: Where nothing can be estimated.
DEFAULT_PRIOR = 0.5


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)  # anything else in ASCII
    for i, chars in enumerate(CLASSES):
        table[[ord(c) for c in chars]] = i
    table[128:] = 2  # bytes of longer characters count as letters
    return table


TABLE = _class_table()


def features(text: str | None, grams: int) -> np.ndarray:
    text = text or ""
    out = np.zeros(STATS + grams, np.float32)
    data = TABLE[np.frombuffer(text.encode(), np.uint8)]
    n = max(len(data), 1)
    shares = np.bincount(data, minlength=len(CLASSES) + 1)[: len(CLASSES) + 1] / n
    words = _words(text)
    lines = [x for x in text.split("\n") if x.strip()]
    count = max(len(words), 1)
    letters = max(shares[2] + shares[3], 1e-6)
    out[:STATS] = [
        np.log1p(len(words)) / 8,
        len("".join(words)) / count / 10,
        len(set(words)) / count,
        len(set(zip(words, words[1:], words[2:]))) / count,
        shares[3] / letters,
        *(np.sqrt(shares[i]) for i in (1, 4, 5, 6, 7, 8, 9, 10, 11, 12)),
        sum(x.rstrip()[-1] in ".!?:" for x in lines) / max(len(lines), 1),
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(lines)) / 6,
    ]
    if len(data) > 2:
        codes = data.astype(np.uint32)
        codes = (codes[:-2] * 16 + codes[1:-1]) * 16 + codes[2:]
        counted = np.bincount(((codes * np.uint32(2654435761)) >> 16) % grams, minlength=grams)
        out[STATS:] = np.sqrt(counted / counted.sum())
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, settings: Settings) -> Model:
    both = np.vstack([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.02
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, settings.rounds + 1):
        sp, su = sigma(p @ w + b), sigma(u @ w + b)
        # Logistic loss: l+ has the slope s - 1, l- the slope s.
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        up, uu = prior * (sp - 1) / len(p), su / len(u)
        corr = prior * sp / len(p)
        if negative >= 0:
            gp, gu = up - corr, uu
        else:  # the estimate of the negative risk has become negative: step back on it alone
            gp, gu = corr, -uu
        g = np.append(p.T @ gp + u.T @ gu + settings.decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(mean, scale, w, b, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, settings: Settings) -> float:
    """Share of positives among the unlabelled, as the least bound by any threshold (see above).

    A threshold is a score of a held-back positive; both shares are widened by the deviation that
    samples of their size show.
    """
    back = lambda x: np.arange(len(x)) % 5 == 4
    hp, hu = back(positive), back(unlabelled)
    if not hp.any() or not hu.any():
        return DEFAULT_PRIOR
    first = minimise(positive[~hp], unlabelled[~hu], DEFAULT_PRIOR, replace(settings, rounds=settings.first_rounds))
    p, u = np.sort(first.score(positive[hp])), np.sort(first.score(unlabelled[hu]))
    above = lambda x: 1 - np.searchsorted(x, p) / len(x)
    slack = lambda n: np.sqrt(np.log(4 / 0.1) / (2 * n))
    share = above(p)
    worst = (above(u) + slack(len(u)) + slack(len(p))) / share
    best = np.argmin(worst)
    return float(np.clip(above(u)[best] / share[best], 0.02, 0.98))


def fit(docs: DataFrame, positives: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from ``docs`` (doc_id, text), which are the unlabelled text, and ``positives`` (doc_id),
    the trusted ones among them; give training rows alone."""
    marked = positives.select("doc_id").distinct().withColumn("trusted", F.lit(1))
    ids = docs.select("doc_id").join(marked, "doc_id", "left")
    size = ids.agg(F.count("*").alias("n"), F.count("trusted").alias("positive")).first()
    dims = STATS + settings.grams
    nothing = Model(np.zeros(dims), np.ones(dims), np.zeros(dims), float(np.log(DEFAULT_PRIOR / (1 - DEFAULT_PRIOR))), DEFAULT_PRIOR)
    if not size.positive:
        return nothing
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(settings.seed + salt), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    as_positive = (F.col("trusted") == 1) & (draw(0) < settings.fit_positive / size.positive)
    as_unlabelled = draw(1) < settings.fit_unlabelled / size.n
    picked = ids.select(
        "doc_id", F.coalesce(as_positive, F.lit(False)).alias("positive"), as_unlabelled.alias("unlabelled")
    ).filter("positive OR unlabelled").distinct()
    # Ids alone meet the labels. What is drawn of them is bounded by the settings, whatever the
    # input, so the texts are picked by a broadcast of these ids and not shuffled.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").drop("doc_id")
    wide = map_text(
        sample,
        lambda: lambda texts: [[features(t, settings.grams) for t in texts]],
        [field("x", T.ArrayType(T.FloatType()))],
    ).drop("text")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.x.to_numpy()).astype(np.float64)
        order = np.lexsort(x.T[:STATS])  # the sums must not depend on the order of arrival
        x, positive, unlabelled = x[order], rows.positive.to_numpy()[order], rows.unlabelled.to_numpy()[order]
        if not positive.any() or not unlabelled.any():
            return pd.DataFrame({"kind": [], "x": []})
        m = minimise(x[positive], x[unlabelled], class_prior(x[positive], x[unlabelled], settings), settings)
        return pd.DataFrame({"kind": [0, 1, 2, 3], "x": [m.mean, m.scale, m.weights, np.array([m.bias, m.prior])]})

    parts = {r.kind: np.array(r.x) for r in wide.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(learn, "kind int, x array<double>").collect()}
    return Model(parts[0], parts[1], parts[2], *map(float, parts[3])) if parts else nothing


def score(docs: DataFrame, model: Model, grams: int = Settings.grams, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5); reads the text alone."""

    def compute(texts):
        found = np.round(model.score(np.stack([features(t, grams) for t in texts])), 9)
        return [found.tolist(), [int(s >= 0.5) for s in found]]

    return map_text(docs, lambda: compute, [field("score", T.DoubleType()), field("predicted", T.IntegerType())], text_col)
