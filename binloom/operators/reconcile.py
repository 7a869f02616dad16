"""Cross-tool reconciliation: which bins of several tools are one genome, and how far the tools agree on contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import checkpointed
from .ranks import ranked

# Labels that say a contig has no bin.
UNBINNED = ("unbinned", "none", "na", "n/a", "unassigned", "unclustered")
MIN_JACCARD = 0.1


def is_unbinned(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*UNBINNED)


def votes_cast(assignment: DataFrame) -> DataFrame:
    """(tool, contig_id, bin_id) that count: no unbinned rows, a contig's last row in each tool."""
    binned = assignment.where(~is_unbinned(F.col("bin_id")))
    return binned.groupBy("tool", "contig_id").agg(F.max_by("bin_id", "row_idx").alias("bin_id"))


def overlaps(cast: DataFrame) -> DataFrame:
    """(tool_a, bin_a, tool_b, bin_b, shared, jaccard) of bins of different tools with a contig in common."""
    sizes = cast.groupBy("tool", "bin_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = cast.alias("a"), cast.alias("b")
    pairs = a.join(b, (F.col("a.contig_id") == F.col("b.contig_id")) & (F.col("a.tool") < F.col("b.tool")))
    shared = pairs.groupBy(F.col("a.tool").alias("tool_a"), F.col("a.bin_id").alias("bin_a"), F.col("b.tool").alias("tool_b"), F.col("b.bin_id").alias("bin_b")).agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(sizes.toDF("tool_a", "bin_a", "n_a"), ["tool_a", "bin_a"]).join(sizes.toDF("tool_b", "bin_b", "n_b"), ["tool_b", "bin_b"])
    jaccard = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return sized.select("tool_a", "bin_a", "tool_b", "bin_b", "shared", jaccard.alias("jaccard"))


def reciprocal_best(pairs: DataFrame, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """Pairs that are each other's best in the other tool and reach the threshold; ties take the least bin id."""
    down = W.partitionBy("tool_a", "bin_a", "tool_b").orderBy(F.desc("jaccard"), "bin_b")
    up = W.partitionBy("tool_b", "bin_b", "tool_a").orderBy(F.desc("jaccard"), "bin_a")
    ranked = pairs.withColumns({"down": F.row_number().over(down), "up": F.row_number().over(up)})
    return ranked.where((F.col("down") == 1) & (F.col("up") == 1) & (F.col("jaccard") >= min_jaccard)).drop("down", "up")


def groups(cast: DataFrame, edges: DataFrame) -> DataFrame:
    """(tool, bin_id, grp): bins joined by edges, the best first, never two of one tool.

    Edges are ranked once. In each round an edge joins two groups if no better edge between groups without a common
    tool touches either of them: what comes before it in the order then leaves both as they are, so that the rounds
    give what taking edge after edge gives. Edges between groups that share a tool are dropped; they stay dead.
    """
    key = lambda t, b: F.concat(F.col(t), F.lit("\x1f"), F.col(b))
    nodes = cast.select("tool", "bin_id").distinct().withColumn("node", key("tool", "bin_id"))
    keyed = edges.select(key("tool_a", "bin_a").alias("a"), key("tool_b", "bin_b").alias("b"), F.array("tool_a").alias("tools_a"), F.array("tool_b").alias("tools_b"), "jaccard")
    # Joined bins only: (node, grp), and open edges between their groups with the tools of both.
    label = checkpointed(keyed.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("grp", F.col("node")))
    open_ = ranked(keyed, F.desc("jaccard"), "a", "b").drop("jaccard")
    open_ = checkpointed(open_.where(~F.arrays_overlap("tools_a", "tools_b")))
    rounds = 0
    while not open_.isEmpty():
        best = open_.select(F.explode(F.array("a", "b")).alias("g"), "rank").groupBy("g").agg(F.min("rank").alias("rank"))
        taken = open_.join(best.withColumnRenamed("g", "a"), ["a", "rank"], "left_semi").join(best.withColumnRenamed("g", "b"), ["b", "rank"], "left_semi")
        # A group is in one taken edge at most.
        pairs = taken.select(F.least("a", "b").alias("to"), F.greatest("a", "b").alias("from"), F.array_sort(F.concat("tools_a", "tools_b")).alias("tools"))
        moves = checkpointed(pairs.select(F.explode(F.array("to", "from")).alias("grp"), "to", "tools"))
        label = label.join(moves.select("grp", "to"), "grp", "left").select("node", F.coalesce("to", "grp").alias("grp"))
        rounds += 1
        label = label if rounds % 4 else checkpointed(label)
        for side in ("a", "b"):
            moved = moves.select(F.col("grp").alias(side), "to", "tools")
            open_ = open_.join(moved, side, "left").withColumns({side: F.coalesce("to", side), f"tools_{side}": F.coalesce("tools", f"tools_{side}")}).drop("to", "tools")
        open_ = checkpointed(open_.where(~F.arrays_overlap("tools_a", "tools_b")).select("rank", "a", "b", "tools_a", "tools_b"))
    return nodes.join(label, "node", "left").select("tool", "bin_id", F.coalesce("grp", "node").alias("grp"))


def mags(cast: DataFrame, grouped: DataFrame) -> DataFrame:
    """(mag_id, tool, bin_id, contig_count): all groups get an id, by distinct contigs down, then least member."""
    members = cast.join(grouped, ["tool", "bin_id"])
    sizes = members.groupBy("grp").agg(F.count_distinct("contig_id").alias("n"))
    named = ranked(sizes, F.desc("n"), "grp").select("grp", F.concat(F.lit("MAG_"), F.col("rank")).alias("mag_id"))
    per_bin = members.groupBy("grp", "tool", "bin_id").agg(F.count(F.lit(1)).alias("contig_count"))
    return per_bin.join(named, "grp").select("mag_id", "tool", "bin_id", "contig_count")


def contig_votes(cast: DataFrame, members: DataFrame) -> DataFrame:
    """(contig_id, tool, mag_id)."""
    return cast.join(members.select("tool", "bin_id", "mag_id"), ["tool", "bin_id"]).select("contig_id", "tool", "mag_id")


def agreement(votes: DataFrame) -> DataFrame:
    """(contig_id, total_votes, agreement, distinct_groups, majority_mag): the majority is null on a tie at the top."""
    counts = votes.groupBy("contig_id", "mag_id").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("contig_id").agg(
        F.sum("n").alias("total_votes"), F.max("n").alias("top"), F.count(F.lit(1)).alias("distinct_groups"), F.sort_array(F.collect_list(F.struct("n", "mag_id")), asc=False).alias("r")
    )
    second = F.get(F.col("r.n"), F.lit(1))
    return top.select(
        "contig_id", "total_votes", (F.col("top") / F.col("total_votes")).alias("agreement"), "distinct_groups",
        F.when(second.isNull() | (second < F.col("top")), F.get(F.col("r.mag_id"), F.lit(0))).alias("majority_mag"),
    )


def standing(agreed: DataFrame) -> DataFrame:
    """(mag_id, contig_id, kind): unanimous contigs are core, others with a majority disputed, tied ones neither."""
    kind = F.when(F.col("agreement") == 1, "core").otherwise("disputed")
    return agreed.where("majority_mag is not null").select(F.col("majority_mag").alias("mag_id"), "contig_id", kind.alias("kind"))


def putative_mags(members: DataFrame, stands: DataFrame) -> DataFrame:
    """(mag_id, rank, n_members, tools, core, disputed): MAGs that hold a contig; ids of others are left as gaps."""
    counts = stands.groupBy("mag_id").agg(F.count_if(F.col("kind") == "core").alias("core"), F.count_if(F.col("kind") == "disputed").alias("disputed"))
    per = members.groupBy("mag_id").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.sort_array(F.collect_list("tool")), ",").alias("tools"))
    number = F.substring_index("mag_id", "_", -1).cast("int")
    return ranked(per.join(counts, "mag_id"), number)


def disputed_ranked(agreed: DataFrame) -> DataFrame:
    """Contigs on which tools differ, ties too, the most split first."""
    rows = agreed.where("agreement < 1").select("contig_id", "agreement", "total_votes", "distinct_groups")
    return ranked(rows, "agreement", F.desc("total_votes"), "contig_id")


class Reconciliation:
    """All results for one set of tables."""

    def __init__(self, assignment: DataFrame, min_jaccard: float = MIN_JACCARD):
        # Every later step reads it, some more than once: it is shuffled once.
        self.cast = checkpointed(votes_cast(assignment))
        self.edges = checkpointed(reciprocal_best(overlaps(self.cast), min_jaccard))
        self.members = checkpointed(mags(self.cast, groups(self.cast, self.edges)))
        self.votes = contig_votes(self.cast, self.members)
        self.agreement = checkpointed(agreement(self.votes))
        self.standing = standing(self.agreement)
        self.mags = checkpointed(putative_mags(self.members, self.standing))
