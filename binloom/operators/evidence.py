"""Evidence for where a contested contig belongs, and MAG summaries under the working assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .assignment import EXCLUDED
from .bins import bin_summary

#: A spread below this is none: distances that are alike but for rounding.
FLAT = 1e-12


def coverage_attached(contigs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Contigs with ``depths`` and ``mean_depth``, of the last coverage row; null without one."""
    last = coverage.groupBy("contig_id").agg(F.max_by("depths", "row_idx").alias("depths"))
    mean = F.aggregate("depths", F.lit(0.0), lambda s, x: s + x) / F.size("depths")
    return contigs.join(last, "contig_id", "left").withColumn("mean_depth", F.when(F.size("depths") > 0, mean))


def mag_summary(mags: DataFrame, votes: DataFrame, standing: DataFrame, state: DataFrame, contigs: DataFrame, hits: DataFrame) -> DataFrame:
    """Per putative MAG: its core, where its other contigs are held, and its live bin's quality."""
    linked = votes.select("mag_id", "contig_id").distinct().join(mags.select("mag_id"), "mag_id", "left_semi")
    core = standing.where("kind = 'core'").select("mag_id", "contig_id", F.lit(True).alias("core"))
    rows = linked.join(core, ["mag_id", "contig_id"], "left").join(state, "contig_id", "left")
    other = F.col("core").isNull()
    counts = rows.groupBy("mag_id").agg(
        F.count("core").alias("core_count"),
        F.count_if(other & (F.col("bin_id") == F.col("mag_id"))).alias("held_here"),
        F.count_if(other & (F.col("bin_id") != F.col("mag_id")) & (F.col("bin_id") != EXCLUDED)).alias("held_elsewhere"),
        F.count_if(other & F.col("bin_id").isNull()).alias("unresolved"),
        F.count_if(other & (F.col("bin_id") == EXCLUDED)).alias("excluded"),
        F.count(F.lit(1)).alias("in_network"),
    )
    counts = counts.withColumn("disputed_count", F.col("held_here") + F.col("held_elsewhere") + F.col("unresolved") + F.col("excluded"))
    live = bin_summary(state.join(mags.select(F.col("mag_id").alias("bin_id")), "bin_id", "left_semi"), contigs, hits)
    live = live.select(F.col("bin_id").alias("mag_id"), F.col("contig_count").alias("live_contigs"), F.col("total_length").alias("live_length"), F.col("n50").alias("live_n50"), "completeness", "redundancy", "tier")
    out = mags.select("mag_id", "tools").join(counts, "mag_id").join(live, "mag_id", "left")
    return out.fillna(0, ["live_contigs", "live_length", "live_n50"]).fillna(0.0, ["completeness", "redundancy"]).fillna("low", ["tier"])


def candidates(votes: DataFrame, mags: DataFrame, agreed: DataFrame) -> DataFrame:
    """(contig_id, mag_id) of contested contigs and the putative MAGs that got a vote for them."""
    contested = agreed.where("distinct_groups > 1").select("contig_id")
    return votes.select("contig_id", "mag_id").distinct().join(contested, "contig_id", "left_semi").join(mags.select("mag_id"), "mag_id", "left_semi")


def evidence(pairs: DataFrame, standing: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per contested contig and candidate MAG: differences from its core's means.

    A contested contig is in no core, so core sums need no self-exclusion; they are taken once for each MAG.
    ``contigs`` has gc_content, coding_density and mean_depth (null if unknown).
    """
    core = standing.where("kind = 'core'").select("mag_id", "contig_id").join(contigs, "contig_id")
    means = core.groupBy("mag_id").agg(
        F.count(F.lit(1)).alias("core_count"), F.avg("gc_content").alias("gc"), F.avg("coding_density").alias("coding"), F.avg("mean_depth").alias("depth")
    )
    rows = pairs.join(contigs.select("contig_id", "gc_content", "coding_density", "mean_depth"), "contig_id").join(means, "mag_id", "left")
    return rows.select(
        "contig_id", "mag_id", F.coalesce("core_count", F.lit(0)).alias("core_count"),
        (100 * F.col("gc_content") - 100 * F.col("gc")).alias("gc_diff"),
        (100 * F.col("coding_density") - 100 * F.col("coding")).alias("coding_diff"),
        F.when(F.col("depth") > 0, F.col("mean_depth") / F.col("depth")).alias("coverage_ratio"),
    )


def marker_status(pairs: DataFrame, standing: DataFrame, hits: DataFrame) -> DataFrame:
    """(contig_id, mag_id, family, redundant): whether a core contig of the MAG already has the contig's family."""
    core = standing.where("kind = 'core'").join(hits, "contig_id").select("mag_id", "family").distinct().withColumn("redundant", F.lit(True))
    rows = pairs.join(hits.select("contig_id", "family").distinct(), "contig_id")
    return rows.join(core, ["mag_id", "family"], "left").select("contig_id", "mag_id", "family", F.coalesce("redundant", F.lit(False)).alias("redundant"))


def _long(contigs: DataFrame) -> DataFrame:
    return contigs.select("contig_id", F.posexplode("composition").alias("k", "v"))


def composition_z(pairs: DataFrame, standing: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig_id, mag_id, z): distance from the core's centroid, against the core's own distances.

    Null below two core contigs, 0 if these are all alike. ``contigs`` has ``composition``, an array.
    """
    core = standing.where("kind = 'core'").select("mag_id", F.col("contig_id").alias("core_id"))
    own = core.join(_long(contigs), F.col("core_id") == F.col("contig_id")).select("mag_id", "core_id", "k", "v")
    centre = own.groupBy("mag_id", "k").agg(F.avg("v").alias("c"))
    away = own.join(centre, ["mag_id", "k"]).groupBy("mag_id", "core_id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("c"), 2))).alias("d"))
    spread = away.groupBy("mag_id").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.count(F.lit(1)).alias("n"))
    asked = pairs.join(_long(contigs), "contig_id").join(centre, ["mag_id", "k"])
    dist = asked.groupBy("contig_id", "mag_id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("c"), 2))).alias("d"))
    rows = pairs.join(dist, ["contig_id", "mag_id"], "left").join(spread, "mag_id", "left")
    z = F.when(F.coalesce("n", F.lit(0)) < 2, F.lit(None)).when(F.col("sd") < FLAT, F.lit(0.0)).otherwise((F.col("d") - F.col("mean")) / F.col("sd"))
    return rows.select("contig_id", "mag_id", z.alias("z"))


def outliers(members: DataFrame, contigs: DataFrame) -> DataFrame:
    """(bin_id, contig_id, composition_z, coverage_z, z): per bin, the larger of both; coverage only if all contigs have it."""
    rows = members.select("bin_id", "contig_id").distinct()
    long = rows.join(_long(contigs), "contig_id")
    centre = long.groupBy("bin_id", "k").agg(F.avg("v").alias("c"))
    d = long.join(centre, ["bin_id", "k"]).groupBy("bin_id", "contig_id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("c"), 2))).alias("d"))
    d = d.join(contigs.select("contig_id", "mean_depth"), "contig_id")
    stats = d.groupBy("bin_id").agg(
        F.avg("d").alias("m"), F.stddev_pop("d").alias("s"), F.avg("mean_depth").alias("cm"), F.stddev_pop("mean_depth").alias("cs"), (F.count("mean_depth") == F.count(F.lit(1))).alias("covered"), F.count(F.lit(1)).alias("n")
    )
    own = F.when(F.col("n") < 2, F.lit(None)).when(F.col("s") < FLAT, 0.0).otherwise((F.col("d") - F.col("m")) / F.col("s"))
    cov = F.when(~F.col("covered") | (F.col("n") < 2), F.lit(None)).when(F.col("cs") < FLAT, 0.0).otherwise(F.abs(F.col("mean_depth") - F.col("cm")) / F.col("cs"))
    out = d.join(stats, "bin_id").select("bin_id", "contig_id", own.alias("composition_z"), cov.alias("coverage_z"))
    return out.withColumn("z", F.greatest("composition_z", "coverage_z"))


def good_and_bad(summary: DataFrame) -> DataFrame:
    """The best and the worst bin of two contigs or more, by completeness less redundancy."""
    rows = summary.where("contig_count >= 2").withColumn("net", F.col("completeness") - F.col("redundancy"))
    best = rows.orderBy(F.desc("net"), "bin_id").limit(1).select(F.lit("good").alias("kind"), "bin_id", "net")
    return best.unionAll(rows.orderBy("net", "bin_id").limit(1).select(F.lit("bad"), "bin_id", "net"))


def similar_bins(members: DataFrame, contigs: DataFrame, most: float = 0.02, most_gc: float = 0.02) -> DataFrame:
    """(bin_a, bin_b, distance, gc_diff): bins of like mean composition and GC, paired within neighbouring GC classes."""
    rows = members.select("bin_id", "contig_id").distinct().join(contigs, "contig_id")
    centre = rows.select("bin_id", F.posexplode("composition").alias("k", "v")).groupBy("bin_id", "k").agg(F.avg("v").alias("v"))
    vectors = centre.groupBy("bin_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("c"))
    gc = rows.groupBy("bin_id").agg(F.avg("gc_content").alias("gc"))
    bins = vectors.join(gc, "bin_id").withColumn("slot", F.floor(F.col("gc") / most_gc))
    a = bins.select(F.col("bin_id").alias("bin_a"), F.col("c").alias("ca"), F.col("gc").alias("ga"), F.explode(F.array(F.col("slot") - 1, "slot", F.col("slot") + 1)).alias("slot"))
    b = bins.select(F.col("bin_id").alias("bin_b"), F.col("c").alias("cb"), F.col("gc").alias("gb"), "slot")
    pairs = a.join(b, "slot").where("bin_a < bin_b")
    distance = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    out = pairs.select("bin_a", "bin_b", distance.alias("distance"), F.abs(F.col("ga") - F.col("gb")).alias("gc_diff"))
    return out.where((F.col("distance") <= most) & (F.col("gc_diff") <= most_gc))


def majority_mismatch(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bin_id, contig_id, label, majority): contigs whose label differs from their bin's most frequent one."""
    rows = members.select("bin_id", "contig_id").distinct().join(labels, "contig_id")
    counts = rows.groupBy("bin_id", "label").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("bin_id").orderBy(F.desc("n"), "label")
    top = counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("bin_id", F.col("label").alias("majority"))
    return rows.join(top, "bin_id").where("label <> majority").select("bin_id", "contig_id", "label", "majority")


def flag_counts(outlier: DataFrame, mismatch: DataFrame, limit: float = 2.0) -> DataFrame:
    """(bin_id, contig_id, flags): how many checks a contig fails, those that fail any."""
    a = outlier.where(F.col("composition_z") > limit).select("bin_id", "contig_id", F.lit(1).alias("flag"))
    b = outlier.where(F.col("coverage_z") > limit).select("bin_id", "contig_id", F.lit(1).alias("flag"))
    rows = a.unionAll(b).unionAll(mismatch.select("bin_id", "contig_id", F.lit(1)))
    return rows.groupBy("bin_id", "contig_id").agg(F.sum("flag").alias("flags"))
