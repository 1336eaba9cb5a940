"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.store import materialise


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def training_rows(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) of all labelled rows outside the held-out fold; an id with several labels counts with the largest."""
    rows = labels.filter(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    return rows.filter(fold(F.col("doc_id"), folds) != held_out)


def sample(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, y): at most ``per_class`` training rows of each class, those whose hashed ids come first.

    Rows of the held-out fold are never taken.
    """
    rows = training_rows(labels, label, folds, held_out)
    parts = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def sampled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, y) of the sample, one row an id: of rows that repeat an id the smallest text counts, so the bound holds.

    The sample is small by construction and is broadcast; its texts alone are grouped, after a map-side minimum, and
    written, so that a fit reads the documents once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return materialise(rows.select("text", "y"), "sample")
