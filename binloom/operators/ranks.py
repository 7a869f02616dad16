"""Ranks over whole tables, without one task that sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import checkpointed


def ranked(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` with ``rank``, from 1 on in the given order.

    Rows are range-partitioned and kept; each partition ranks its own and adds the rows of those before it.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition.
    before = counts.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    out = dealt.withColumn("_local", local).join(F.broadcast(before), "_range")
    return out.select(*rows.columns, (F.col("_before") + F.col("_local")).cast("int").alias("rank"))


def ranked_within(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``_rank`` from 1 on among the rows of their ``key`` in the given order, and ``_n``, how many these are.

    Rows are range-partitioned by key and order, so that the rows of one key may be in many tasks. A key that is in
    several ranges has a row for each in a small table, which tells what comes before: at most one key goes over each
    end of a range.
    """
    dealt = checkpointed(rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range", key).agg(F.count(F.lit(1)).alias("_m"))
    w = W.partitionBy(key)
    before = F.coalesce(F.sum("_m").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    several = counts.withColumns({"_before": before, "_total": F.sum("_m").over(w), "_ranges": F.count(F.lit(1)).over(w)}).where("_ranges > 1")
    inside = W.partitionBy("_range", key)
    local = dealt.withColumns({"_rank": F.row_number().over(inside.orderBy(*order)), "_n": F.count(F.lit(1)).over(inside)})
    known = several.select(F.col("_range").alias("_r"), F.col(key).alias("_k"), "_before", "_total")
    out = local.join(F.broadcast(known), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return out.select(*rows.columns, (F.col("_rank") + F.coalesce("_before", F.lit(0))).alias("_rank"), F.coalesce("_total", "_n").alias("_n"))
