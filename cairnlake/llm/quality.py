"""Document quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance of the statistics, the covariance shrunk towards the pooled one and that towards
its diagonal. The score is the posterior of class 1: the difference of the class log densities, by Mahalanobis distances
with Cholesky factors that are computed once and cached with the model, plus the log prior ratio.

The model is fitted from sums (count, sum, outer products) that tasks reduce their rows to, over all labelled rows that
are not held out: nothing but those sums reaches the driver.

Defined results: null and empty texts have all-zero statistics, transformed like others, and a score; null ids are held
out; a document with several labels has the largest; rows that repeat are rows of the result; without labelled rows of
both classes every score is 0.5; labels, lang, source and doc_id are no inputs; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_rows, is_held_out, map_rows, one_label, pieces_of, released, stored, table

THRESHOLD = 0.3
#: Share of the pooled covariance in a class's, and of its own diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL = 0.1, 0.05
#: Added to the variances of the standardised statistics.
RIDGE = 1e-3
#: Standardised statistics are held within so many deviations.
CLIP = 8.0
#: Words that count as seen without any repetition, so that a few words say little.
FEW = 20

NAMES = ("words", "word_length", "distinct", "top_word", "adjacent", "pairs", "lines", "repeated_lines", "upper", "digits", "symbols", "bars", "stops", "letters")

_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123] = True, True
_HIGH = np.arange(256) >= 128
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOPS = np.isin(np.arange(256), list(b".,;:?!\"'()-"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_SYMBOLS = ~(_UPPER | _LOWER | _HIGH | _DIGIT | _STOPS | _SPACE)


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The statistics of a whole text by ``NAMES``, transformed towards normal shapes."""
    data = (text or "").encode()
    words = data.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    visible = max(1, int(counts[~_SPACE].sum()))
    share = lambda which: float(counts[which].sum()) / visible
    top = Counter(words).most_common(1)[0][1] if words else 0
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x]
    less = lambda x: float(np.log(x + 0.003))
    return (
        float(np.log1p(len(words))),
        float(np.log(visible / n)),
        less((len(words) - distinct) / (n + FEW)),
        less(top / (n + FEW)),
        less(sum(map(bytes.__eq__, words, words[1:])) / (n + FEW)),
        less(max(0, len(words) - 1 - pairs) / (n + FEW)),
        less(len(lines) / n),
        less((len(lines) - len(set(lines))) / (len(lines) + FEW / 4)),
        less(share(_UPPER)),
        less(share(_DIGIT)),
        less(share(_SYMBOLS)),
        less(counts[124] / visible),
        less(share(_STOPS)),
        less(1 - share(_UPPER | _LOWER | _HIGH)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats)."""

    def rows(got: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in got:
            yield doc_id, statistics_of(text)

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Class means and Cholesky factors over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    covariances: tuple[np.ndarray, np.ndarray]
    log_priors: tuple[float, float]
    factors: tuple[np.ndarray, np.ndarray] = field(init=False)
    log_dets: tuple[float, float] = field(init=False)

    def __post_init__(self):
        lower = tuple(np.linalg.cholesky(c) for c in self.covariances)
        object.__setattr__(self, "factors", tuple(np.linalg.inv(x) for x in lower))
        object.__setattr__(self, "log_dets", tuple(2 * float(np.log(np.diag(x)).sum()) for x in lower))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        density = [p - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d, p in zip(self.means, self.factors, self.log_dets, self.log_priors, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -40, 40)))


def fit_from_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> QuadraticDiscriminant | None:
    """The model from (count, sum, sum of outer products) by class; None without two classes."""
    if any(sums.get(y, (0,))[0] < 2 for y in (0, 1)):
        return None
    total = [sum(s[k] for s in sums.values()) for k in range(3)]
    centre = total[1] / total[0]
    scale = np.sqrt(np.maximum(np.diag(total[2]) / total[0] - centre**2, 1e-6))
    means, own = [], []
    for y in (0, 1):
        n, s, q = sums[y]
        mean = s / n
        means.append((mean - centre) / scale)
        own.append((q / n - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = sum(sums[y][0] * own[y] for y in (0, 1)) / total[0]
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    ridge = RIDGE * np.eye(len(centre))
    covariances = tuple((1 - TO_POOLED) * c + TO_POOLED * pooled + ridge for c in own)
    return QuadraticDiscriminant(centre, scale, tuple(means), covariances, tuple(float(np.log(sums[y][0] / total[0])) for y in (0, 1)))


def fit(labelled: DataFrame) -> QuadraticDiscriminant | None:
    """The model for rows (stats, y)."""
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("stats").flatten().to_numpy().reshape(-1, d)
            y = batch.column("y").to_numpy()
            for label in (0, 1):
                own = x[y == label]
                made = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                held[label] = held.get(label, 0) + made
        for label, made in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(made)), pa.array(range(len(made))), pa.array(made)], ["y", "at", "value"])

    partial = labelled.select("stats", F.col("y").cast("int").alias("y")).mapInArrow(sums, "y long, at long, value double")
    found: dict[int, np.ndarray] = {}
    for r in partial.groupBy("y", "at").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["y"], np.zeros(1 + d + d * d))[r["at"]] = r["value"]
    return fit_from_sums({y: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for y, v in found.items()})


def scored(stats: DataFrame, model: QuadraticDiscriminant | None) -> DataFrame:
    """(doc_id, score) for (doc_id, stats)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy().reshape(-1, len(NAMES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return stats.mapInArrow(rows, "doc_id long, score double")


def train(stats: DataFrame, labels: DataFrame) -> QuadraticDiscriminant | None:
    known = one_label(labels, "quality").where(~is_held_out(F.col("doc_id")))
    return fit(stats.join(known, "doc_id"))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document."""
    stats = stored(statistics(docs), "quality")
    out = scored(stats, train(stats, labels))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, whole rows.

    Statistics ride along with each row of a stored table: the model is fitted from its two columns, then rows are
    filtered by theirs, so no text is looked at twice and no row is joined.
    """
    at, width = docs.columns.index("text"), len(docs.columns)
    together = T.StructType([*docs.schema.fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                stats = pa.array([statistics_of(t) for t in piece.column(at).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*piece.columns, stats], [*piece.schema.names, "stats"])
        released()

    # Columns are taken by place, and the last is the statistics', whatever the others are called.
    places = [f"c{i}" for i in range(width)] + ["stats"]
    held = stored(docs.mapInArrow(with_statistics, together).toDF(*places), "quality")
    model = train(held.select(F.col(places[docs.columns.index("doc_id")]).alias("doc_id"), "stats"), labels)

    def good(stats: list) -> np.ndarray:
        x = np.array(stats).reshape(-1, len(NAMES))
        return model.score(x) >= threshold if model else np.full(len(x), 0.5 >= threshold)

    return filter_rows(held, good, "stats", keep=width).toDF(*docs.columns)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
