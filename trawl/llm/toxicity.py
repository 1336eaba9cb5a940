"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding homoglyphs and digit substitutions.

The lexicon starts from seed terms and takes weights, further words and word beginnings from labelled rows. Hits in an
exception phrase don't count. A text's score is the logistic of its weighted hits, as a sum and for each word.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import kernel
from trawl.llm.labelled import fold as crc_fold
from trawl.llm.labelled import sample, sampled_texts, training_rows
from trawl.llm.store import bounded_batches, temporary

#: Rows of each class that a fit takes at most, and terms that a lexicon has at most.
PER_CLASS, MOST_TERMS = 2500, 4000
#: Log odds from which a term counts as toxic, and the share of toxic rows that must have it.
LEAST_ODDS, LEAST_SHARE = 3.0, 0.004
#: Lengths of the word beginnings that may become terms.
BEGINNINGS = (4, 5, 6)
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "retard")
SEED_WEIGHT = 2.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "pond scum", "disgusting taste")

#: Letters drawn alike, and digits and signs used for letters; l, 1 and | fold to i on both sides of a match.
_ALIKE = str.maketrans(
    "авекмнорстухіјѕһԁԛԝгз" + "αβεικνοπρτυχγησω" + "013457@$!|l",
    "abekmhopctyxijshdqwre" + "abeikvonptuxynow" + "oieastasiii",
)


class _Fold(dict):
    """For str.translate: folds a character when it is first seen."""

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        plain = plain.translate(_ALIKE)
        self[code] = out = "".join(c if c.isalpha() else " " for c in plain)
        return out


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """The text in folded letters, each other character a space, with a space at both ends."""
    return f" {(text or '').translate(_FOLD)} "


@dataclass
class Lexicon:
    """weights: by " word " or " beginning", in folded letters."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    _built: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.weights, self.exceptions = state
        self._built = None

    @property
    def automaton(self):
        if self._built is None:
            a = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                a.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                a.add_word(folded(phrase), (len(phrase) + 2, None))
            a.make_automaton()
            self._built = a
        return self._built

    def hits(self, text: str) -> list[float]:
        """Weights of the words of a folded text that match, the largest for each word, without those in exceptions."""
        if not self.weights and not self.exceptions:
            return []
        found: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(text):
            start = end - length + 1
            if weight is None:
                free.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if not free:
            return list(found.values())
        # phrases in the order of their starts, with the furthest end so far: one search a hit
        free.sort()
        starts, reach = [a for a, _ in free], list(accumulate((b for _, b in free), max))
        return [w for start, w in found.items() if not (at := bisect_right(starts, start)) or reach[at - 1] <= start]

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        rows = []
        for text in texts:
            text = folded(text)
            total = sum(self.hits(text))
            rows.append((1.0, np.log1p(total), np.log1p(100 * total / max(len(text.split()), 1))))
        return np.array(rows).reshape(-1, 3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.lexicon.features(texts) @ self.coefficients, -30, 30)))


def _terms(text: str | None) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


def _specific(terms: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights by term, without beginnings nearly all of whose rows have one longer term."""
    longest: dict[str, int] = {}
    for term, p, _ in terms:
        for n in range(2, len(term)):
            longest[term[:n]] = max(longest.get(term[:n], 0), p)
    return {term: float(w) for term, p, w in terms if longest.get(term, 0) < 0.95 * p}


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from at most ``per_class`` labelled rows of each class outside the held-out fold.

    Term counts are summed on the executors; at most MOST_TERMS terms and three numbers a sampled row reach the driver.
    The intercept is moved from the sample's odds of the classes to those of all training rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = sample(labels, "toxic", folds, held_out, per_class)
    rows = sampled_texts(docs, chosen, id_col, text_col)
    schema = pa.schema([("term", pa.string()), ("y", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((t, y) for t in _terms(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    sizes = dict(rows.groupBy("y").count().collect())
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    weights = {folded(s): SEED_WEIGHT for s in SEEDS}
    if p and n:
        terms = rows.mapInArrow(count, "term string, y int, n long").groupBy("term").agg(F.sum(F.col("n") * F.col("y")).alias("p"), F.sum(F.col("n") * (1 - F.col("y"))).alias("n"))
        odds = F.log((F.col("p") + 0.5) / (p + 1)) - F.log((F.col("n") + 0.5) / (n + 1))
        terms = terms.filter(F.col("p") >= max(4, LEAST_SHARE * p)).withColumn("w", odds).filter(F.col("w") >= LEAST_ODDS)
        weights |= _specific([tuple(r) for r in terms.orderBy(F.desc("p"), "term").limit(MOST_TERMS).select("term", "p", "w").collect()])
    lexicon = Lexicon(weights)
    scored = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(lexicon.features(batch.column(0).to_pylist())), pa.list_(pa.float64()))], schema=scored)

    found = rows.mapInArrow(features, "y int, x array<double>").toPandas()
    x, y = np.array(found["x"].tolist()).reshape(-1, 3), found["y"].to_numpy(dtype=float)
    if not (p and n):
        return Model(lexicon, np.array([-3.0, 1.0, 0.5]))
    known = dict(training_rows(labels, "toxic", folds, held_out).groupBy("y").count().collect())
    return Model(lexicon, _logistic(x, y) + np.array([np.log(known[1] / known[0]) - np.log(p / n), 0.0, 0.0]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, over whole texts.

    Null and empty texts have no hits and get the score of none. A null id is in no fold: held_out is false. Repeated
    rows score alike; an empty table gives no rows; other columns of docs don't matter.
    """
    if model is None:
        with temporary(docs.sparkSession):
            model = train(docs, labels, folds, held_out, id_col=id_col, text_col=text_col)
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
