"""Choosing bounded training rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Rows whose id's crc32 modulo this is 0 are held out.
FOLDS = 5


def labelled(docs: DataFrame, labels: DataFrame, label: str, value: int, most: int, name: str) -> DataFrame:
    """(id, role) of at most ``most`` documents that are labelled so and are not held out.

    The choice goes by a hash of the id. Held-out rows' labels are never read on.
    """
    rows = labels.where((F.col(label) == value) & (fold("doc_id", FOLDS) != 0)).select(F.col("doc_id").alias("id"))
    rows = rows.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi").distinct()
    return _first(rows, most, name)


def unlabelled(docs: DataFrame, most: int, name: str) -> DataFrame:
    """(id, role) of at most ``most`` documents that are not held out, labels unseen."""
    return _first(docs.where(fold("doc_id", FOLDS) != 0).select(F.col("doc_id").alias("id")).distinct(), most, name)


def _first(rows: DataFrame, most: int, name: str) -> DataFrame:
    return rows.orderBy(F.xxhash64("id"), "id").limit(most).select("id", F.lit(name).alias("role"))


def with_texts(docs: DataFrame, *chosen: DataFrame) -> DataFrame:
    """(id, role, text) of the chosen ids, once each; their number is bounded, so they are broadcast."""
    ids = chosen[0]
    for more in chosen[1:]:
        ids = ids.union(more)
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id").groupBy("id", "role").agg(F.min("text").alias("text"))
