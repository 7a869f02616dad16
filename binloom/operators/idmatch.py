"""Repair of contig ids that differ between a bin table and the assembly."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: what CONCOCT adds to the ids of cut contigs.
CUT_SUFFIX = r"\.concoct_part_\d+$"
HIGH = 0.9




def candidates(rows: DataFrame) -> DataFrame:
    """Rows under each strategy: exact, suffix, swap."""
    kinds = F.array(
        F.struct(F.lit("exact").alias("strategy"), F.col("contig_id").alias("c"), F.col("bin_id").alias("b")),
        F.struct(F.lit("suffix").alias("strategy"), F.regexp_replace("contig_id", CUT_SUFFIX, "").alias("c"), F.col("bin_id").alias("b")),
        F.struct(F.lit("swap").alias("strategy"), F.col("bin_id").alias("c"), F.col("contig_id").alias("b")),
    )
    keep = [c for c in rows.columns if c not in ("contig_id", "bin_id")]
    return rows.select(*keep, F.explode(kinds).alias("k")).select(*keep, "k.strategy", F.col("k.c").alias("contig_id"), F.col("k.b").alias("bin_id"))


def match_rates(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """(tool, strategy, rate): share of a table's rows whose id is in the assembly, 0 if it has none."""
    known = contigs.select(F.col("contig_id").alias("known")).distinct()
    joined = candidates(rows).join(known, F.col("contig_id") == F.col("known"), "left")
    return joined.groupBy("tool", "strategy").agg((F.count("known") / F.count(F.lit(1))).alias("rate"))


def strategies(rows: DataFrame, contigs: DataFrame, high: float = HIGH) -> DataFrame:
    """(tool, strategy, applied, before, after). A repair must beat the ids as they are; suffix wins ties over swap."""
    rates = match_rates(rows, contigs).groupBy("tool").pivot("strategy", ["exact", "suffix", "swap"]).agg(F.first("rate"))
    before = F.col("exact")
    best = F.greatest("suffix", "swap")
    better = best > before
    name = F.when(F.col("suffix") >= F.col("swap"), "suffix").otherwise("swap")
    strategy = F.when(before >= high, "exact").when(better & (best >= high), name).otherwise("none")
    after = F.when((before < high) & better, best).otherwise(before)
    return rates.select("tool", strategy.alias("strategy"), strategy.isin("suffix", "swap").alias("applied"), before.alias("before"), after.alias("after"))


def majority(rows: DataFrame) -> DataFrame:
    """(tool, contig_id, bin_id, row_idx, distinct_bins): each contig's most frequent bin, the first seen on ties."""
    counts = rows.groupBy("tool", "contig_id", "bin_id").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    best = counts.groupBy("tool", "contig_id").agg(
        F.max_by("bin_id", F.struct("n", -F.col("first"))).alias("bin_id"), F.min("first").alias("row_idx"), F.count(F.lit(1)).alias("distinct_bins")
    )
    return best.select("tool", "contig_id", "bin_id", "row_idx", "distinct_bins")


def repaired(rows: DataFrame, contigs: DataFrame, high: float = HIGH) -> tuple[DataFrame, DataFrame]:
    """The tables under their strategies, and the report with collapsed contig counts. Only repaired tables collapse."""
    chosen = strategies(rows, contigs, high)
    pick = chosen.select("tool", F.when(F.col("applied"), F.col("strategy")).otherwise("exact").alias("strategy"), "applied")
    under = candidates(rows).join(F.broadcast(pick), ["tool", "strategy"])  # a row for each tool
    fixed = majority(under.where("applied"))
    same = under.where("not applied").select("tool", "contig_id", "bin_id", "row_idx")
    collapsed = fixed.groupBy("tool").agg(F.count_if(F.col("distinct_bins") > 1).alias("collapsed"))
    report = chosen.join(collapsed, "tool", "left").fillna(0, ["collapsed"])
    return same.unionByName(fixed.drop("distinct_bins")), report
