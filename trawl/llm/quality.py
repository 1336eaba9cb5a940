"""Quality classifier: regularised quadratic discriminant analysis on transformed statistics of whole texts.

Each class has a mean and a covariance shrunk towards the pooled one and towards its diagonal. A text's score is the
logistic of the difference of the two log densities, from Mahalanobis distances by Cholesky factors that are computed
once and sent with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import kernel
from trawl.llm.labelled import fold, sample, sampled_texts, training_rows
from trawl.llm.store import bounded_batches, temporary

#: Rows of each class that a fit takes at most.
PER_CLASS = 3000
#: Weights of the pooled covariance and of the diagonal in a class's covariance, and what is added to the diagonal.
POOLED, DIAGONAL, RIDGE = 0.5, 0.2, 1e-3

_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 1
for _c in b" \t\x0b\x0c\r\n":
    _KIND[_c] = 4
for _c in b".,;:'\"-()":
    _KIND[_c] = 5
for _c in b"!?":
    _KIND[_c] = 6
_KIND[0x7C] = 7
FEATURES = ("log words", "word bytes", "upper", "digits", "spaces", "stops", "marks", "bars", "symbols", "distinct words", "distinct pairs", "distinct lines", "line bytes", "top word")


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text. Empty and null texts give a row of defined values."""
    data, offsets = kernel.buffers(column)
    size = np.diff(offsets).astype(float)
    kind = _KIND[data]
    share = {k: np.log1p(100 * _sums(kind == k, offsets) / np.maximum(size, 1)) for k in (2, 3, 4, 5, 6, 7, 0)}
    starts, ends, bounds = kernel.word_spans(data, offsets)
    words = kernel.word_hashes(kernel.LOWER[data], starts, ends)
    n = np.diff(bounds).astype(float)
    pairs, at = kernel.shingles(words, bounds, 2)
    distinct, twice, top = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i in np.flatnonzero(n > 0):
        _, counts = np.unique(words[bounds[i] : bounds[i + 1]], return_counts=True)
        distinct[i], top[i] = len(counts), counts.max() / n[i]
        twice[i] = len(np.unique(pairs[at[i] : at[i + 1]])) / (at[i + 1] - at[i])
    newline = data == 10
    lines = _sums(newline, offsets) + 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(np.concatenate(([True], newline[:-1]))[: len(data)] | edge[:-1]) if len(data) else np.zeros(0, np.int64)
    last = np.concatenate((first[1:], [len(data)])).astype(np.int64)
    codes = kernel.word_hashes(data, first, last) if len(first) else np.zeros(0, kernel.U64)
    owner = np.searchsorted(first, offsets)
    same = np.array([len(np.unique(codes[a:b])) / (b - a) if b > a else 1.0 for a, b in zip(owner[:-1], owner[1:], strict=True)])
    columns = [
        np.log1p(n),
        np.log1p((size - _sums(kind == 4, offsets)) / np.maximum(n, 1)),
        share[2],
        share[3],
        share[4],
        share[5],
        share[6],
        share[7],
        share[0],
        np.log1p(distinct) / np.maximum(np.log1p(n), 0.5),
        twice,
        same,
        np.log1p(size / lines),
        np.sqrt(top),
    ]
    return np.column_stack(columns)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and half log determinants of both classes, and the log prior odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    inverses: tuple[np.ndarray, ...]
    halves: tuple[float, ...]
    odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [-0.5 * np.square((z - m) @ inv.T).sum(axis=1) - h for m, inv, h in zip(self.means, self.inverses, self.halves, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.odds, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL, counts: tuple[int, int] | None = None) -> Discriminant:
    """counts: of both classes where x is a sample of them, for the prior odds. A class without rows takes the other's moments, so that scores stay defined; without any rows all score 0.5."""
    if not len(x):
        x, y = np.zeros((1, len(FEATURES))), np.zeros(1, int)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - centre) / scale
    own = [z[y == k] if (y == k).any() else z for k in (0, 1)]
    means = [o.mean(axis=0) for o in own]
    covariances = [(o - m).T @ (o - m) / max(len(o) - 1, 1) for o, m in zip(own, means, strict=True)]
    common = sum(c * len(o) for c, o in zip(covariances, own, strict=True)) / sum(len(o) for o in own)
    inverses, halves = [], []
    for c in covariances:
        c = (1 - pooled) * c + pooled * common
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + RIDGE * np.eye(len(c))
        low = np.linalg.cholesky(c)
        inverses.append(np.linalg.inv(low))
        halves.append(float(np.log(np.diag(low)).sum()))
    n0, n1 = counts or ((y == 0).sum(), (y == 1).sum())
    odds = float(np.log(n1 / n0)) if n0 and n1 else 0.0
    return Discriminant(centre, scale, tuple(means), tuple(inverses), tuple(halves), odds)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Fits on at most ``per_class`` labelled rows of each class outside the held-out fold; only statistics leave the executors."""
    bounded_batches(docs.sparkSession)
    chosen = sample(labels, "quality", folds, held_out, per_class)
    sizes = dict(training_rows(labels, "quality", folds, held_out).groupBy("y").count().collect())
    rows = sampled_texts(docs, chosen, id_col, text_col)
    schema = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(statistics(part.column(0))), pa.list_(pa.float64()))], schema=schema)

    found = rows.mapInArrow(run, "y int, x array<double>").toPandas()
    return fit(np.array(found["x"].tolist()).reshape(len(found), len(FEATURES)), found["y"].to_numpy(dtype=int), counts=(sizes.get(0, 0), sizes.get(1, 0)))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.5, model: Discriminant | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts are scored by their statistics like others. A null id is in no fold: held_out is false.
    Repeated rows score alike; an empty table gives no rows; other columns of docs don't matter.
    """
    if model is None:
        with temporary(docs.sparkSession):
            model = train(docs, labels, folds, held_out, id_col=id_col, text_col=text_col)
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(part.column(1))))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; decided while reading, without a shuffle."""
    with temporary(docs.sparkSession):
        model = train(docs, labels, id_col=id_col, text_col=text_col)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            renamed = batch.rename_columns([f"c{i}" for i in range(len(names))])
            for part in kernel.pieces(renamed, f"c{at}"):
                yield part.filter(pa.array(model.score(statistics(part.column(at))) >= threshold)).rename_columns(names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
