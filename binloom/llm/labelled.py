"""Bounded samples of labelled documents, and the folds of the contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id's text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, text: str = "text") -> DataFrame:
    """(doc_id, text, label, u): at most ``bound`` labelled training rows, taken by hash; u is uniform in [0, 1).

    ``train`` is a condition on doc_id. A doc_id labelled twice takes the larger label; null labels don't count.
    """
    one = labels.where(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    u = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("u", u)
    rows = docs.where("doc_id is not null").select("doc_id", F.col(text).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id")  # at most ``bound`` rows of 24 bytes
