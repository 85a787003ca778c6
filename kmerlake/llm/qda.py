"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text is told by a row of statistics, transformed to be near normal.  Class
means and covariances come from sums over all labelled training rows, gathered in
Spark (one block of sums per task and class, then per cell).  A class covariance
is shrunk towards the pooled variances.  The score is the difference of the
Mahalanobis log densities, from Cholesky factors that each task keeps, put
through a logistic curve fitted to a histogram of the training rows' differences.

Learning uses ``quality`` of label rows only; language, source and id are no
inputs.  Null text counts as empty.  Labels without a quality or a document are
ignored, repeated label rows count each.  With one class only, every score is
the share of label 1.  Each input row gives one output row, so repeated rows stay
apart; a score that equals the threshold counts as 1.  Texts are measured whole, a
long one as a batch by itself.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerlake.llm.bytewords import SPACE, Words, pieces
from kmerlake.llm.tables import bounded, cut

NAMES = (
    "words", "word_length", "word_length_spread", "longest_word", "upper", "digits", "symbols", "shouts", "stops", "commas",
    "spaces", "lines", "repeated_lines", "distinct_words", "repeated_windows", "common_word", "short_words", "marked_words", "sentence", "byte_entropy",
    "lone_marks", "double_letters",
)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _table(bytes(range(0x41, 0x5B))), _table(b"0123456789")
_SYMBOL, _SHOUT, _STOP, _COMMA = _table(b"#*$%&|<>{}[]=_~^@"), _table(b"!?"), _table(b"."), _table(b",;:")
_LETTER = _table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    words = Words(texts, SPACE)
    data, at, rows = words.data, words.at, len(texts)
    n, size = words.counts(), np.diff(at)
    cum = lambda mask: np.concatenate(([0], np.cumsum(mask)))

    def share(mask: np.ndarray) -> np.ndarray:
        total = cum(mask)
        return (total[at[1:]] - total[at[:-1]]) / np.maximum(size, 1)

    lengths = (words.ends - words.starts).astype(np.float64)
    row = np.repeat(np.arange(rows), n)
    per = lambda v: np.bincount(row, weights=v, minlength=rows) / np.maximum(n, 1)
    mean = per(lengths)
    spread = np.sqrt(np.maximum(per(lengths**2) - mean**2, 0))
    longest = np.zeros(rows)
    np.maximum.at(longest, row, lengths)
    letters = _LETTER[data]
    last = data[words.ends - 1] if len(words) else np.zeros(0, np.uint8)
    marked = ~letters[words.ends - 1] if len(words) else np.zeros(0, bool)
    symbol = _SYMBOL[last]
    hashes = words.hashes()
    distinct, repeated, common = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    entropy, same_lines, lines = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    raw = data.tobytes()
    for i in range(rows):
        a, b = words.first[i], words.first[i + 1]
        if b > a:
            own = hashes[a:b]
            _, count = np.unique(own, return_counts=True)
            distinct[i], common[i] = len(count), count.max()
            if b - a > 2:
                windows = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
                repeated[i] = 1 - len(np.unique(windows)) / len(windows)
            share_of = np.bincount(data[at[i] : at[i + 1]], minlength=256)
            p = share_of[share_of > 0] / size[i]
            entropy[i] = -(p * np.log2(p)).sum()
        own_lines = raw[at[i] : at[i + 1]].split(b"\n")
        lines[i], same_lines[i] = len(own_lines), 1 - len(set(own_lines)) / len(own_lines)
    root = np.sqrt
    sentences = (lambda t: t[at[1:]] - t[at[:-1]])(cum(_STOP[data] | _SHOUT[data]))
    pair = np.concatenate((letters[1:] & (data[1:] == data[:-1]), [False])) if len(data) else letters
    lone = (lengths == 1) & marked
    out = np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), np.log1p(longest), root(share(_UPPER[data])), root(share(_DIGIT[data])),
        root(share(_SYMBOL[data])), root(share(_SHOUT[data])), root(share(_STOP[data])), root(share(_COMMA[data])),
        root(share(SPACE[data])), np.log1p(lines), root(same_lines), np.log1p(distinct) - np.log1p(n), root(repeated), root(common / np.maximum(n, 1)),
        per(lengths <= 3), root(per(symbol)), np.log1p(n / np.maximum(sentences, 1)), entropy, root(per(lone)), root(share(pair)),
    ], axis=1)
    return out


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of two classes, and the logistic curve."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        logs = [self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * squashed(self.difference(x)) + b, -30, 30)))


def squashed(d: np.ndarray) -> np.ndarray:
    """Log-density differences drawn in far from zero, where their size tells little."""
    return np.arcsinh(d)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the array of statistics, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                x = statistics(piece.column("text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), flat], ["doc_id", "x"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(NAMES))


def fit(labelled: DataFrame, shrink: float = 0.2) -> Discriminant:
    """Learn from rows of ``x`` and ``label`` (0 or 1)."""
    size = len(NAMES) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size))
        for batch in batches:
            x = np.concatenate([np.ones((batch.num_rows, 1)), _matrix(batch.column("x"))], axis=1)
            y = batch.column("label").to_numpy()
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["cell", "value"])

    cells = labelled.select("x", "label").mapInArrow(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * size * size)
    for cell, value in cells:
        total[cell] = value
    total = total.reshape(2, size, size)
    n = total[:, 0, 0]
    if not n.all():
        return Discriminant(np.zeros((2, 1)), np.zeros((2, 1, 1)), np.zeros(2), constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 0, 1:] / n[:, None]
    spread = [total[c, 1:, 1:] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.maximum((n[0] * np.diag(spread[0]) + n[1] * np.diag(spread[1])) / n.sum(), 1e-6)
    factors, offsets = [], []
    for c in (0, 1):
        keep = shrink + (1 - shrink) * len(NAMES) / (len(NAMES) + n[c])
        root = np.linalg.cholesky((1 - keep) * spread[c] + keep * np.diag(pooled) + 1e-9 * np.eye(len(NAMES)))
        factors.append(np.linalg.inv(root))
        offsets.append(-np.log(np.diag(root)).sum())
    model = Discriminant(means, np.array(factors), np.array(offsets))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.round(squashed(model.difference(_matrix(batch.column("x")))) * 20).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label")], ["at", "label"])

    bins = labelled.select("x", "label").mapInArrow(histogram, "at int, label int").groupBy("at", "label").count().collect()
    z = np.array([r[0] / 20 for r in bins])
    y, w = np.array([float(r[1]) for r in bins]), np.array([float(r[2]) for r in bins])
    curve = np.array([1.0, 0.0])
    design = np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ curve, -30, 30)))
        slope = design.T @ (w * (y - p)) - 1e-3 * curve
        bend = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        curve = curve + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.curve = float(curve[0]), float(curve[1])
    return model


def classify(stats: DataFrame, model: Discriminant) -> DataFrame:
    """The rows of ``document_statistics`` with ``score`` instead of ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted; every row whose crc32 of the id is 0 modulo 5 is held out."""
    stats = cut(document_statistics(docs))
    fold = lambda c: F.crc32(F.col(c).cast("string")) % 5 == 0
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~fold("doc_id"))
    scored = classify(stats, fit(stats.join(told, "doc_id")))
    return scored.select("doc_id", F.coalesce(fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
