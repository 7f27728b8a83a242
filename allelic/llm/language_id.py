"""Language identification by the nearest of several clustered centroids per language.

A text becomes a normalised TF-IDF vector of its letter trigrams (bytes of the lower-cased
UTF-8 text, other characters folded to one blank), hashed to a fixed number of dimensions.
Document frequencies cover all training rows; the centroids of a language come from spherical
k-means over a bounded sample of its rows. The prediction is the language of the centroid of
largest cosine; a text farther from it than the centroid's own members is marked as rejected.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and is rejected;
so is every text where nothing could be learned. Rows without a language are never learned
from. Repeated rows get equal results; an empty table gives an empty table; input columns that
bear the name of a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import field, map_text

_letter = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class Settings:
    """``fit_rows`` bounds, in expectation, the rows of one language that the clustering sees."""

    dims: int = 4096
    clusters: int = 3
    fit_rows: int = 1200
    rounds: int = 12
    reject_share: float = 0.6  # of the cosine that 99 of 100 members of a centroid reach
    seed: int = 5


def _fold_table() -> np.ndarray:
    """Bytes other than lower-case letters and parts of longer characters become blanks."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


FOLD = _fold_table()


def gram_counts(text: str, dims: int) -> np.ndarray:
    data = FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    if len(data) > 1:
        blank = data == 32
        data = data[np.append(~(blank[1:] & blank[:-1]), True)]
    codes = data.astype(np.uint32)
    codes = (codes[:-2] << 16) + (codes[1:-1] << 8) + codes[2:]
    return np.bincount(((codes * np.uint32(2654435761)) >> 15) % dims, minlength=dims)


def vectors(texts: list, idf: np.ndarray) -> np.ndarray:
    made = np.zeros((len(texts), len(idf)), np.float32)
    for row, text in zip(made, texts, strict=True):
        if text:
            row[:] = gram_counts(text, len(idf))
    np.log1p(made, out=made)
    made *= idf
    made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)
    return made


def spherical_kmeans(points: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and assignments; starts from the point nearest the mean, then the farthest ones."""
    start = [int(np.argmax(points @ points.mean(axis=0)))]
    while len(start) < min(k, len(points)):
        start.append(int(np.argmin((points @ points[start].T).max(axis=1))))
    centers = points[start].copy()
    near = np.zeros(len(points), int)
    for _ in range(rounds):
        near = np.argmax(points @ centers.T, axis=1)
        for c in range(len(centers)):
            if (own := points[near == c]).size:
                centers[c] = own.mean(axis=0)
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers, np.argmax(points @ centers.T, axis=1)


def document_frequencies(docs: DataFrame, dims: int) -> np.ndarray:
    """Documents that hold each hashed trigram, and in the last place all documents."""

    def run(batches):
        seen = np.zeros(dims + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    seen[:dims] += gram_counts(text, dims) > 0
                    seen[dims] += 1
        at = seen.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["gram", "docs"])

    found = np.zeros(dims + 1)
    sums = docs.select("text").mapInArrow(run, "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    for gram, n in sums.collect():  # at most dims + 1 rows
        found[gram] = n
    return found


@dataclass(frozen=True)
class Model:
    langs: list[str]  # of each centroid
    centers: np.ndarray
    limits: np.ndarray  # smallest cosine that is not rejected
    idf: np.ndarray


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from ``text`` and non-null ``lang`` of ``rows``."""
    rows = rows.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    seen = document_frequencies(rows, settings.dims)
    idf = (np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1).astype(np.float32)
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return Model([], np.zeros((0, settings.dims), np.float32), np.zeros(0), idf)
    share = F.create_map(*(F.lit(x) for lang, n in counts for x in (lang, min(1.0, settings.fit_rows / n))))
    draw = F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)

    def cluster(sample: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in sample.sort_values("text").text if _letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "center": [], "limit": []})
        points = vectors(texts, idf)
        centers, near = spherical_kmeans(points, settings.clusters, settings.rounds)
        cosines = np.einsum("ij,ij->i", points, centers[near])
        used = [c for c in range(len(centers)) if (near == c).any()]
        limits = [float(np.quantile(cosines[near == c], 0.01)) * settings.reject_share for c in used]
        return pd.DataFrame({"lang": sample.lang.iloc[0], "center": [centers[c].tolist() for c in used], "limit": limits})

    found = (
        rows.filter(draw < share[F.col("lang")])
        .select("lang", "text")
        .groupBy("lang")
        .applyInPandas(cluster, "lang string, center array<float>, limit double")
        .collect()  # clusters x languages rows
    )
    found.sort(key=lambda r: (r.lang, r.limit))
    return Model(
        [r.lang for r in found],
        np.array([r.center for r in found], np.float32).reshape(-1, settings.dims),
        np.array([r.limit for r in found]),
        idf,
    )


FIELDS = [field("lang_pred", T.StringType()), field("score", T.DoubleType()), field("rejected", T.BooleanType())]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the cosine, 0 to 1) and rejected; reads the text alone."""

    def compute(texts):
        known = [bool(t) and len(model.langs) > 0 and _letter(t) is not None for t in texts]
        if not any(known):
            return [["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)]
        cosines = vectors([t if k else "" for t, k in zip(texts, known)], model.idf) @ model.centers.T
        best = np.argmax(cosines, axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best].astype(float), 0, 1)
        return [
            [model.langs[b] if k else "und" for b, k in zip(best, known)],
            [float(s) if k else 0.0 for s, k in zip(score, known)],
            [not k or bool(s < model.limits[b]) for s, b, k in zip(score, best, known)],
        ]

    return map_text(docs, lambda: compute, FIELDS, text_col)


def fold(modulus: int, doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
