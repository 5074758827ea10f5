"""Regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian whose covariance is shrunk towards the common one and towards a sphere; a cached Cholesky
factor of each gives Mahalanobis distances and log determinants. How far to shrink is chosen on folds of the training
sample, and the same folds' margins calibrate the score, since densities of dependent statistics are too sure of themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from . import arrow

#: Byte classes that are counted: white space, line ends, digits, capitals, small letters, beyond ASCII, sentence marks, cries, other marks.
_CLASSES = ("space", "line", "digit", "capital", "small", "wide", "stop", "cry", "mark")
FEATURES = ("log_words", "word_bytes", "word_spread", "line", "digit", "capital", "wide", "stop", "cry", "mark", "distinct_words", "distinct_windows", "top_word", "entropy")


def _class_of() -> np.ndarray:
    out = np.full(256, _CLASSES.index("mark"), np.int64)
    for name, members in (("space", b" \t\r\v\f"), ("line", b"\n"), ("digit", b"0123456789"), ("capital", bytes(range(65, 91))), ("small", bytes(range(97, 123))), ("wide", bytes(range(128, 256))), ("stop", b".,;:"), ("cry", b"!?")):
        out[list(members)] = _CLASSES.index(name)
    return out


_CLASS = _class_of()


def _distinct(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners: its distinct keys and the count of its most frequent one."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, o[at], np.diff(np.append(at, len(o))))
    return np.bincount(o[at], minlength=n), top


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text gives zeros. Shares are taken to their square roots, which evens their spread."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1) if len(data) else np.zeros((n, len(_CLASSES)))
    share = np.sqrt(counts / np.maximum(size, 1)[:, None])
    start, end, first = arrow.words(data, offsets)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n), n_words)
    some = np.maximum(n_words, 1)
    length = (end - start).astype(float)
    mean = np.bincount(owner, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
    hashes = arrow.word_hashes(data, start, end, 1)
    kinds, top = _distinct(owner, hashes, n)
    at, triples = arrow.windows(hashes, first, 3)
    triple_kinds, _ = _distinct(owner[at], triples, n)
    n_triples = np.maximum(np.bincount(owner[at], minlength=n), 1)
    p = share**2
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    named = dict(zip(_CLASSES, share.T, strict=True))
    named |= {"log_words": np.log1p(n_words), "word_bytes": np.log1p(mean), "word_spread": np.log1p(spread), "distinct_words": kinds / some, "distinct_windows": np.sqrt(1 - np.minimum(triple_kinds / n_triples, 1)), "top_word": np.sqrt(top / some), "entropy": entropy}
    return np.stack([named[f] for f in FEATURES], 1)


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, features array<double>) for each row; texts are read whole, and a null text is empty."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(d, o) for _, _, d, o in arrow.spans(b.column(1), 1 << 20)]
            if rows:
                x = np.concatenate(rows)
                where = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(where, pa.array(x.ravel()))], [id_col, "features"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(arrow.trimmed(run), schema)


#: How far covariances may be shrunk: towards the common one, and towards a sphere.
POOLED, RIDGE = (0.0, 0.1, 0.3, 0.6, 1.0), (0.001, 0.01, 0.05, 0.2)
FOLDS = 4


class Discriminant:
    """Class means, shrunk covariances as inverse Cholesky factors, and log priors; ``slope`` and ``offset`` calibrate the margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pooled: float, ridge: float, priors: tuple[float, float] | None = None):
        self.center, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        self.pooled, self.ridge, self.slope, self.offset = pooled, ridge, 1.0, 0.0
        z = (x - self.center) / self.scale
        classes = [z[y == k] for k in (0, 1)]
        if min(map(len, classes)) < 2:
            raise ValueError("both classes need labelled rows")
        covs = [np.cov(c.T, bias=True) for c in classes]
        common = sum(len(c) * v for c, v in zip(classes, covs, strict=True)) / len(z)
        self.parts = []
        for c, v, prior in zip(classes, covs, priors or [len(c) / len(z) for c in classes], strict=True):
            shrunk = (1 - pooled) * v + pooled * common
            shrunk = (1 - ridge) * shrunk + ridge * max(np.trace(shrunk) / len(shrunk), 1e-6) * np.eye(len(shrunk))
            factor = np.linalg.cholesky(shrunk)
            self.parts.append((c.mean(0), np.linalg.inv(factor), np.log(prior) - np.log(np.diag(factor)).sum()))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log density and prior of class 1, less those of class 0."""
        z = (x - self.center) / self.scale
        logs = [bias - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, bias in self.parts]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -500, 500)))


def calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """(slope, offset, mean loss) of the logistic curve through the margins, by Newton's steps.

    Its targets keep off 0 and 1 by one row of each class, so that no finite sample makes it sure.
    """
    n = np.bincount(y, minlength=2)
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    unit = max(float(np.abs(margin).mean()), 1e-9)
    x = np.stack([margin / unit, np.ones(len(margin))], 1)
    loss = lambda b: float((weight * (np.logaddexp(0, x @ b) - target * (x @ b))).sum() / weight.sum())
    b = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        gradient = x.T @ (weight * (p - target))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * weight.sum() * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(b[0]) / unit, 0.0), float(b[1]), loss(b)


def learned(x: np.ndarray, y: np.ndarray, priors: tuple[float, float]) -> Discriminant:
    """The discriminant of the shrinkage with the least loss on rows that it was not fitted to, calibrated on those.

    Classes weigh as in ``priors``, however many rows of each the sample has. A class of too few rows for folds has the middle of each range
    and no calibration.
    """
    if min(np.bincount(y, minlength=2)) < 2 * FOLDS:
        return Discriminant(x, y, POOLED[len(POOLED) // 2], RIDGE[len(RIDGE) // 2], priors)
    weight = np.array(priors)[y] / np.bincount(y)[y]
    fold = np.empty(len(y), np.int64)
    for k in (0, 1):
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    best = None
    for pooled in POOLED:
        for ridge in RIDGE:
            margin = np.empty(len(y))
            for f in range(FOLDS):
                margin[fold == f] = Discriminant(x[fold != f], y[fold != f], pooled, ridge, priors).margin(x[fold == f])
            found = (*calibrated(margin, y, weight), pooled, ridge)
            best = found if best is None or found[2] < best[2] else best
    slope, offset, _, pooled, ridge = best
    model = Discriminant(x, y, pooled, ridge, priors)
    model.slope, model.offset = slope, offset
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no training sees; a null id is one of the others."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> Discriminant:
    """Learns from about ``most`` labelled rows of each class: all, or those whose id hash is below that share.

    Rows held out, with a null id, or with a label other than 0 and 1 are not used. A repeated label row
    counts once where it agrees with the others; an id with both labels is left out. The driver gets
    two counts and then only the sample. Priors are the classes' shares of all these rows.
    """
    y = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    y = y.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_most")).filter("_y = _most")
    both = measured.join(y, measured[id_col] == F.col("_id")).select("features", "_y", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)).alias("_h"))
    counts = {r["_y"]: r["n"] for r in y.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = F.lit(False)
    for k, n in counts.items():
        below = below | ((F.col("_y") == k) & (F.col("_h") < int(min(1.0, most / n) * (1 << 30))))
    sample = both.filter(below).select("features", "_y").collect()
    sample.sort(key=lambda r: (r[1], r[0]))
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        raise ValueError("both classes need labelled rows")
    total = sum(counts.values())
    return learned(np.array([r[0] for r in sample]).reshape(len(sample), -1), np.array([r[1] for r in sample], np.int64), (counts[0] / total, counts[1] / total))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7,
    most: int = 10_000,
) -> DataFrame:
    """One row for each row of docs: (id, held_out, score, predicted).

    The score is the calibrated probability of label 1 from the two classes' log densities and priors. A null text
    counts as empty; null ids are scored and never learned from; repeated rows are scored each; other
    columns of either table are not read; an empty docs table gives no rows. Raises ValueError if a class
    has fewer than two labelled rows and there are documents to score. Texts are read once: the statistics are written and then joined,
    learned from and scored.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    measured = materialize(measure(docs, id_col, text_col), "statistics")
    if measured.isEmpty():
        return docs.sparkSession.createDataFrame([], schema).withColumn("predicted", F.lit(0))
    model = fit(measured, labels, id_col, label_col, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(x))], [id_col, "held_out", "score"])

    scored = measured.select(id_col, held_out(id_col).alias("held_out"), "features").mapInArrow(arrow.trimmed(run), schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
