"""Bin summaries: sizes, N50, marker completeness, quality tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAMILIES = 40
RECALL = 0.74


@dataclass(frozen=True)
class Tiers:
    high_completeness: float = 90
    high_redundancy: float = 5
    medium_completeness: float = 50
    medium_redundancy: float = 10


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in ``order``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def n50_l50(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n50, l50): the first length, from the longest down, at which half of the total is reached."""
    w = W.partitionBy(*keys)
    down = w.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, W.currentRow)
    sized = rows.groupBy(*keys, "length").agg(F.count(F.lit(1)).alias("c"))  # contigs of one length count at once
    run = sized.withColumns({"total": F.sum(F.col("length") * F.col("c")).over(w), "upto": F.sum(F.col("length") * F.col("c")).over(down), "rank": F.sum("c").over(down)})
    hit = run.where((2 * F.col("upto") >= F.col("total")) & (F.col("total") > 0))
    before_length, before_rank = F.col("upto") - F.col("length") * F.col("c"), F.col("rank") - F.col("c")
    nth = before_rank + F.greatest(F.lit(1), F.ceil((F.col("total") / 2 - before_length) / F.col("length")))
    first = hit.groupBy(*keys).agg(F.max_by(F.struct(F.col("length").alias("n50"), nth.cast("long").alias("l50")), "length").alias("h"))
    return first.select(*keys, "h.n50", "h.l50")


def completeness(members: DataFrame, hits: DataFrame, families: int = FAMILIES, recall: float = RECALL) -> DataFrame:
    """(bin_id, families_found, completeness, redundancy, raw_completeness) from (bin_id, contig_id) and (contig_id, family)."""
    if not 0 < recall <= 1:
        raise ValueError("recall must be above 0 and at most 1")
    expected = families * recall
    per = members.select("bin_id", "contig_id").distinct().join(hits.select("contig_id", "family").distinct(), "contig_id")
    counted = per.groupBy("bin_id", "family").agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy("bin_id").agg(F.count(F.lit(1)).alias("families_found"), F.count_if(F.col("n") > 1).alias("duplicated"))
    return found.select(
        "bin_id",
        "families_found",
        F.least(F.lit(100.0), F.col("families_found") / expected * 100).alias("completeness"),
        (F.col("duplicated") / expected * 100).alias("redundancy"),
        (F.col("families_found") / families * 100).alias("raw_completeness"),
    )


def tier(complete: Column, redundant: Column, t: Tiers = Tiers()) -> Column:
    return (
        F.when((complete > t.high_completeness) & (redundant < t.high_redundancy), "high")
        .when((complete >= t.medium_completeness) & (redundant < t.medium_redundancy), "medium")
        .otherwise("low")
    )


def bin_summary(assignment: DataFrame, contigs: DataFrame, hits: DataFrame, recall: float = RECALL, tiers: Tiers = Tiers()) -> DataFrame:
    """One row for each bin with a known contig. A contig listed twice in a bin is counted twice."""
    rows = assignment.select("contig_id", "bin_id").join(contigs.select("contig_id", "length", "gc_content"), "contig_id")
    sums = rows.groupBy("bin_id").agg(F.count(F.lit(1)).alias("contig_count"), F.sum("length").alias("total_length"), F.avg("gc_content").alias("mean_gc"))
    out = sums.join(n50_l50(rows, "bin_id"), "bin_id", "left").join(completeness(rows, hits, recall=recall), "bin_id", "left")
    out = out.fillna(0, ["n50", "l50", "families_found"]).fillna(0.0, ["completeness", "redundancy", "raw_completeness"])
    return out.withColumn("tier", tier(F.col("completeness"), F.col("redundancy"), tiers))


def preferred_hits(built_in: DataFrame, supplied: DataFrame | None) -> DataFrame:
    """(contig_id, family): hits that came with the data, and those found here for contigs without any."""
    if supplied is None:
        return built_in.select("contig_id", "family")
    rest = built_in.join(supplied.select("contig_id").distinct(), "contig_id", "left_anti")
    return supplied.select("contig_id", "family").unionByName(rest.select("contig_id", "family"))


def unmatched(assignment: DataFrame, contigs: DataFrame) -> DataFrame:
    """Assignment rows whose contig is not in the assembly; repeated rows stay."""
    return assignment.join(contigs.select("contig_id").distinct(), "contig_id", "left_anti")


def marker_contributions(members: DataFrame, hits: DataFrame) -> DataFrame:
    """(bin_id, contig_id, family, is_unique) for each hit: whether no other contig of the bin has the family."""
    rows = members.select("bin_id", "contig_id").distinct().join(hits.select("contig_id", "family"), "contig_id")
    holders = rows.groupBy("bin_id", "family").agg(F.count_distinct("contig_id").alias("n"))
    return rows.join(holders, ["bin_id", "family"]).select("bin_id", "contig_id", "family", (F.col("n") == 1).alias("is_unique"))


def assembly_summary(contigs: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for the whole assembly."""
    sums = contigs.agg(F.count(F.lit(1)).alias("contig_count"), F.sum("length").alias("total_length"), F.avg("gc_content").alias("mean_gc"))
    marks = hits.join(contigs.select("contig_id").distinct(), "contig_id", "left_semi").agg(F.count_distinct("contig_id").alias("with_markers"), F.count_distinct("family").alias("families"))
    half = n50_l50(contigs.select(F.lit(1).alias("one"), "length"), "one").select("n50", "l50")
    return sums.crossJoin(F.broadcast(marks)).crossJoin(F.broadcast(half))  # one row each


def tool_card(assignment: DataFrame) -> DataFrame:
    """Per tool: rows, bins that are not unbinned labels, share of bins with one contig, and a warning from half on."""
    from .reconcile import is_unbinned

    rows = assignment.groupBy("tool").agg(F.count(F.lit(1)).alias("n_rows"))
    per = assignment.where(~is_unbinned(F.col("bin_id"))).groupBy("tool", "bin_id").agg(F.count(F.lit(1)).alias("n"))
    bins = per.groupBy("tool").agg(F.count(F.lit(1)).alias("n_bins"), (F.count_if(F.col("n") == 1) / F.count(F.lit(1)) * 100).alias("singleton_pct"))
    out = rows.join(bins, "tool", "left").fillna(0, ["n_bins"]).fillna(0.0, ["singleton_pct"])
    return out.withColumn("fragmented", F.col("singleton_pct") >= 50)
