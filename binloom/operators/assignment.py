"""The working assignment: a base, an append-only edit log, and the state they fold to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import checkpointed

EXCLUDED = "excluded"


def initial(assignment: DataFrame, agreed: DataFrame | None, tools: int) -> DataFrame:
    """(contig_id, bin_id): the majority of the tools; of a single table, each contig's last row; else nothing."""
    if agreed is not None:
        return agreed.where("majority_mag is not null").select("contig_id", F.col("majority_mag").alias("bin_id"))
    if tools == 1:
        return assignment.groupBy("contig_id").agg(F.max_by("bin_id", "row_idx").alias("bin_id"))
    return assignment.where("false").select("contig_id", "bin_id")


def fold(base: DataFrame, edits: DataFrame) -> DataFrame:
    """(contig_id, bin_id) after edits (seq, contig_id, bin_id), the last of which wins."""
    rows = base.select("contig_id", "bin_id", F.lit(-1).cast("long").alias("seq")).unionByName(edits.select("contig_id", "bin_id", F.col("seq").cast("long")))
    return rows.groupBy("contig_id").agg(F.max_by("bin_id", "seq").alias("bin_id"))


#: Parts that the time of a log is cut into, so that no bin's events are all in one task.
TIME_PARTS = 64


def _next_merge(places: DataFrame, merges: DataFrame) -> DataFrame:
    """(bin_id, seq, next): for each place, the first merge away from the bin after it; null if there is none.

    Places and merges of a bin meet in parts of the log's time; the first merge of later parts comes from a table of
    the least merge in each part.
    """
    ends = merges.agg(F.min("seq"), F.max("seq")).first()
    low, wide = (ends[0] or 0), ((ends[1] or 0) - (ends[0] or 0)) // TIME_PARTS + 1
    part = F.greatest(F.lit(0), F.least(F.lit(TIME_PARTS), F.floor((F.col("seq") - low) / wide))).cast("int")
    away = merges.select(F.col("source").alias("bin_id"), "seq").withColumn("part", part)
    per = away.groupBy("bin_id", "part").agg(F.min("seq").alias("least"))
    later = per.select("bin_id", F.explode(F.when(F.col("part") > 0, F.sequence(F.lit(0), F.col("part") - 1)).otherwise(F.array().cast("array<int>"))).alias("part"), "least")
    later = later.groupBy("bin_id", "part").agg(F.min("least").alias("later"))
    both = places.select("bin_id", "seq").distinct().withColumn("part", part).withColumn("merge", F.lit(None).cast("long"))
    both = both.unionByName(away.withColumn("merge", F.col("seq")))
    # From the last to the first: the merge seen last is the next one. At one number, the place is after the merge.
    w = W.partitionBy("bin_id", "part").orderBy(F.desc("seq"), F.col("merge").isNotNull().cast("int")).rowsBetween(W.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("merge", ignorenulls=True).over(w)).where("merge is null")
    return near.join(later, ["bin_id", "part"], "left").select("bin_id", "seq", F.coalesce("near", "later").alias("next"))


def replay(base: DataFrame, log: DataFrame) -> DataFrame:
    """(contig_id, bin_id) after a log of (seq, contig_id, source, target), in the order of seq, which is unique.

    A row with a contig moves it to the target, known or not; a row with a source moves all that is in this bin at that
    moment. Each contig starts from its own last move (or its base) and follows the merges that come after: from a
    merge, the next is the first one away from its target later on, and these links are doubled until all have ended.
    """
    moves = log.where("contig_id is not null").select("contig_id", F.col("target").alias("bin_id"), F.col("seq").cast("long"))
    merges = checkpointed(log.where("contig_id is null and source <> target").select(F.col("seq").cast("long"), "source", "target"))
    start = base.select("contig_id", "bin_id", F.lit(-(1 << 62)).alias("seq")).unionByName(moves)
    start = checkpointed(start.groupBy("contig_id").agg(F.max_by("bin_id", "seq").alias("bin_id"), F.max("seq").alias("seq")))
    arrived = merges.select(F.col("target").alias("bin_id"), "seq")
    link = arrived.join(_next_merge(arrived, merges), ["bin_id", "seq"], "left").select("seq", "bin_id", "next")
    link = checkpointed(link)
    while not link.where("next is not null").isEmpty():
        ahead = link.select(F.col("seq").alias("next"), F.col("bin_id").alias("there"), F.col("next").alias("further"))
        link = checkpointed(link.join(ahead, "next", "left").select("seq", F.coalesce("there", "bin_id").alias("bin_id"), F.col("further").alias("next")))
    first = _next_merge(start, merges)
    final = link.select(F.col("seq").alias("next"), F.col("bin_id").alias("at"))
    rows = start.join(first, ["bin_id", "seq"], "left").join(final, "next", "left")
    return rows.select("contig_id", F.coalesce("at", "bin_id").alias("bin_id"))


def reassign(state: DataFrame, contigs: DataFrame, target: str) -> DataFrame:
    moved = contigs.select("contig_id").distinct().withColumn("to", F.lit(target))
    return state.join(moved, "contig_id", "full").select("contig_id", F.coalesce("to", "bin_id").alias("bin_id"))


def merge(state: DataFrame, source: str, target: str) -> DataFrame:
    return state.select("contig_id", F.when(F.col("bin_id") == source, F.lit(target)).otherwise(F.col("bin_id")).alias("bin_id"))


def exclude(state: DataFrame, contigs: DataFrame) -> DataFrame:
    return reassign(state, contigs, EXCLUDED)


def list_bins(state: DataFrame) -> DataFrame:
    """Distinct bins in code-unit order."""
    return state.select("bin_id").distinct().orderBy("bin_id")


def new_bin_id(state: DataFrame, prefix: str) -> str:
    """``prefix`` if it is free, else prefix.2, prefix.3 and so on."""
    used = state.where((F.col("bin_id") == prefix) | F.col("bin_id").rlike("^\\Q" + prefix + "\\E\\.\\d+$")).select("bin_id").distinct()
    number = F.when(F.col("bin_id") == prefix, F.lit(1)).otherwise(F.substring_index("bin_id", ".", -1).try_cast("long"))
    taken = used.select(number.alias("n")).where("n >= 1").distinct()
    free = taken.select((F.col("n") + 1).alias("n")).join(taken, "n", "left_anti").agg(F.min("n")).first()[0]
    return prefix if taken.where("n = 1").isEmpty() else f"{prefix}.{free}"


def exportable(state: DataFrame, excluded_mags: DataFrame) -> DataFrame:
    """Without contigs of excluded MAGs."""
    return state.join(excluded_mags.select(F.col("mag_id").alias("bin_id")), "bin_id", "left_anti").select("contig_id", "bin_id")
