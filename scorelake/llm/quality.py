"""Quality classifier: regularised quadratic discriminant over statistics of the recognised text.

Each class gets a mean and a covariance, shrunk towards its diagonal and towards the pooled one. Both come from sums of
products that the tasks form over all labelled rows, so no row travels to the driver. A text's score is the difference
of the two log densities, computed by Mahalanobis distances with the Cholesky factors kept in the model, and mapped to
0..1 by a logistic curve fitted to the histogram of the differences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.arrays import Words, buffers, pieces
from scorelake.llm.exchange import written

STATISTICS = (
    "log_words",
    "word_bytes",
    "symbols",
    "capitals",
    "digits",
    "marks",
    "exclamations",
    "other_bytes",
    "line_words",
    "repeated_lines",
    "distinct_words",
    "repeated_triples",
    "short_words",
    "long_words",
    "capital_words",
    "stops",
)
SLICE_BYTES = 2 << 20
#: Edges of the histogram that the logistic curve is fitted to.
SPREAD, BINS = 60.0, 480


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOLS, _CAPITALS, _DIGITS = _class("#*$%&|<>{}[]\\^~_=+@"), _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_MARKS, _SHOUTS, _STOPS = _class(",;:.?\"'()-/"), _class("!"), _class(".?!")
_HIGH = (np.arange(256) >= 0x80).astype(np.int64)


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; shares are on a logarithmic scale, all are zero for an empty text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    count, size = np.diff(words.first), np.diff(offsets)
    some, bytes_ = np.maximum(count, 1), np.maximum(size, 1)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[words.first])

    def repeated(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each text, how many of its keys have come before."""
        order = np.lexsort((keys, text))
        again = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
        return np.bincount(text[order][1:][again], minlength=n)

    hashes = words.hashes()
    length = words.end - words.start
    share = lambda x, of, least: np.log((x + least * of) / ((1 + least) * of))
    at, triples = words.windows(3, hashes)
    line_break = data == 0x0A
    lines = per_text(line_break) + 1
    # a line, from its first word to the next break
    edges = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(line_break) + 1]))
    first = np.searchsorted(words.start, np.append(edges, len(data)))
    full = np.flatnonzero(np.diff(first) > 0)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * (np.arange(len(hashes)) % 2**20 + 1).astype(np.uint64))])
    shift = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
    low, high = first[:-1][full], first[1:][full]
    line_key = (prefix[high] - prefix[low]) - (shift[high] - shift[low]) * (low % 2**20).astype(np.uint64)
    line_text = words.text[low] if len(low) else low
    full_lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    capital = _CAPITALS[data[words.start]] if len(words) else length
    columns = [
        np.log1p(count),
        np.where(count > 0, np.log(np.maximum(per_word(length), 1) / some), 0),
        share(per_text(_SYMBOLS[data]), bytes_, 0.002),
        share(per_text(_CAPITALS[data]), bytes_, 0.005),
        share(per_text(_DIGITS[data]), bytes_, 0.005),
        share(per_text(_MARKS[data]), bytes_, 0.005),
        share(per_text(_SHOUTS[data]), bytes_, 0.002),
        share(per_text(_HIGH[data]), bytes_, 0.01),
        np.log1p(count / lines),
        share(repeated(line_key, line_text), full_lines, 0.02),
        share(repeated(hashes, words.text), some, 0.05),
        share(repeated(triples, words.text[at]), some, 0.02),
        share(per_word(length <= 2), some, 0.05),
        share(per_word(length >= 14), some, 0.02),
        share(per_word(capital), some, 0.05),
        share(per_text(_STOPS[data]), some, 0.02),
    ]
    out = np.stack(columns, axis=1).astype(np.float64)
    out[count == 0] = 0
    return out


@dataclass(frozen=True)
class QualityModel:
    """Means and inverse Cholesky factors of both classes, log determinants and priors, and the logistic curve."""

    mean: np.ndarray  # (2, d)
    whiten: np.ndarray  # (2, d, d): inverse of the lower Cholesky factor
    offset: np.ndarray  # (2,): log prior - log determinant / 2
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, for each row."""
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.whiten[c].T
            density.append(self.offset[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return np.clip(density[1] - density[0], -SPREAD, SPREAD)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.shift)))


def statistics_of(page_texts: DataFrame, page_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(page_id, stats array<double>) of every whole text."""
    rows = page_texts.select(F.col(page_col), F.col(text_col).alias("__text"))
    schema = rows.drop("__text").schema.add("stats", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text", SLICE_BYTES):
                x = text_statistics(*buffers(piece.column("__text")))
                stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), stats], names=[page_col, "stats"])

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def fit_quality(labelled: DataFrame, shrink: float = 0.1, pool: float = 0.1, accepted_col: str = "accepted") -> QualityModel:
    """A model from ``labelled`` (``stats`` of ``statistics_of``, ``accepted`` 0 or 1), over all its rows.

    ``shrink`` is the weight of the diagonal, ``pool`` that of the covariance of both classes together. Rows whose label
    is neither 0 nor 1 are left out. A class without rows takes mean and covariance of the other; without any labelled
    row every text scores one half.
    """
    d = len(STATISTICS)
    rows = labelled.filter(F.col(accepted_col).isin(0, 1)).select(F.col(accepted_col).cast("int").alias("c"), "stats")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            x = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch.column("stats"))])
            label = np.asarray(batch.column("c"))
            for c in (0, 1):
                part = x[label == c]
                total[c] += part.T @ part
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "value"])

    cells = rows.mapInArrow(sums, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    moment = np.zeros(2 * (d + 1) ** 2)
    for row in cells:
        moment[row.cell] = row.value
    moment = moment.reshape(2, d + 1, d + 1)
    n = moment[:, 0, 0].copy()
    if n.sum() == 0:
        return QualityModel(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    for c in (0, 1):
        if n[c] == 0:
            moment[c] = moment[1 - c]
    weight = moment[:, 0, 0]
    mean = moment[:, 0, 1:] / weight[:, None]
    scatter = moment[:, 1:, 1:] - weight[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = scatter.sum(axis=0) / weight.sum()
    whiten, offset = np.empty((2, d, d)), np.empty(2)
    for c in (0, 1):
        cov = (1 - pool) * scatter[c] / weight[c] + pool * pooled
        spread = np.diag(cov).clip(1e-4)
        cov = (1 - shrink) * cov + shrink * np.diag(spread) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten[c] = np.linalg.inv(factor)
        offset[c] = np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum()
    return _calibrated(QualityModel(mean, whiten, offset), rows)


def _calibrated(model: QualityModel, rows: DataFrame) -> QualityModel:
    """``model`` with the logistic curve that fits the labels best, from 2 x BINS counts."""
    width = 2 * SPREAD / BINS

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(2 * BINS, np.int64)
        for batch in batches:
            place = ((model.difference(_matrix(batch.column("stats"))) + SPREAD) / width).astype(int).clip(0, BINS - 1)
            count += np.bincount(place + BINS * np.asarray(batch.column("c")), minlength=2 * BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * BINS)), pa.array(count)], names=["bin", "n"])

    count = np.zeros(2 * BINS)
    for row in rows.mapInArrow(binned, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        count[row.bin] = row.n
    bad, good = count.reshape(2, BINS)
    slope, shift = logistic_curve((np.arange(BINS) + 0.5) * width - SPREAD, good, bad)
    return QualityModel(model.mean, model.whiten, model.offset, slope, shift)


def logistic_curve(at: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the counts best, held near slope 1.

    Newton steps on the penalised log likelihood, which is concave; a step is halved until it gains.
    """
    x = np.stack([at, np.ones(len(at))], axis=1)
    ridge, prior = np.diag([1.0, 0.01]), np.array([1.0, 0.0])

    def likelihood(w: np.ndarray) -> float:
        z = x @ w
        return -(good * np.logaddexp(0, -z) + bad * np.logaddexp(0, z)).sum() - 0.5 * (w - prior) @ ridge @ (w - prior)

    w = prior
    for _ in range(100):
        p = np.exp(-np.logaddexp(0, -(x @ w)))
        gradient = x.T @ (good - (good + bad) * p) - ridge @ (w - prior)
        step = np.linalg.solve(x.T @ (x * ((good + bad) * p * (1 - p))[:, None]) + ridge, gradient)
        while likelihood(w + step) < likelihood(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def score_pages(stats: DataFrame, model: QualityModel, threshold: float = 0.3, page_col: str = "page_id") -> DataFrame:
    """(page_id, score, predicted) for rows of ``statistics_of``."""
    schema = stats.select(page_col).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(page_col), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[page_col, "score", "predicted"]
            )

    return stats.select(page_col, "stats").mapInArrow(run, schema)


def grade_pages(
    page_texts: DataFrame,
    page_reviews: DataFrame,
    threshold: float = 0.3,
    shrink: float = 0.1,
    page_col: str = "page_id",
    text_col: str = "text",
    accepted_col: str = "accepted",
) -> DataFrame:
    """Score the recognised text of every page by what reviewers accepted.

    ``page_texts``: (``page_id``, ``text``), one row per page; ``page_reviews``: (``page_id``, ``accepted`` 0 or 1) for
    some pages; other columns are dropped and never enter a score. Returns (page_id, score 0..1, predicted), one row
    per row of ``page_texts``: higher means more likely accepted, predicted is 1 from ``threshold`` on. Null and empty
    texts have all statistics at zero and get the score of that point. Pages reviewed or listed several times count
    so often; a null label or id is left out of the fit. Without reviews every score is one half.
    """
    stats = written(statistics_of(page_texts, page_col, text_col), "quality")
    labelled = stats.join(page_reviews.select(page_col, accepted_col), page_col)
    return score_pages(stats, fit_quality(labelled, shrink, accepted_col=accepted_col), threshold, page_col)
