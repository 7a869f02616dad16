"""Taxonomy tables: dump files, ancestor chains and lowest common ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import rank_letter
from .graph import checkpointed


def read_dump(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Rows of a dump file, its fields trimmed of tabs."""
    rows = spark.read.option("lineSep", "\t|\n").text(path).where(F.length("value") > 0)
    cells = F.split("value", r"\t\|\t")
    return rows.select(*[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def nodes(spark: SparkSession, path: str) -> DataFrame:
    rows = read_dump(spark, path, "tax_id", "parent", "rank")
    return rows.select(F.col("tax_id").cast("long"), F.col("parent").cast("long"), rank_letter(F.col("rank")).alias("rank"))


def scientific_names(spark: SparkSession, path: str) -> DataFrame:
    rows = read_dump(spark, path, "tax_id", "name", "unique_name", "kind")
    return rows.where("kind = 'scientific name'").select(F.col("tax_id").cast("long"), "name")


def merged_ids(spark: SparkSession, path: str) -> DataFrame:
    """(old, new): ids that stand for another now."""
    return read_dump(spark, path, "old", "new").select(F.col("old").cast("long"), F.col("new").cast("long"))


def deleted_ids(spark: SparkSession, path: str) -> DataFrame:
    """(tax_id): ids that stand for nothing any more."""
    return read_dump(spark, path, "tax_id").select(F.col("tax_id").cast("long"))


def resolved_ids(ids: DataFrame, tree: DataFrame, merged: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """(tax_id, current, status): 'merged' ids with what they stand for, 'deleted' and 'unknown' ones without any, and
    'current' ones with themselves. An id that is merged into one without a node has none."""
    rows = ids.select("tax_id").where("tax_id is not null").distinct()
    no_merged, no_deleted = tree.where("false").select(F.col("tax_id").alias("old"), F.col("parent").alias("new")), tree.where("false").select("tax_id")
    rows = rows.join((no_merged if merged is None else merged).select(F.col("old").alias("tax_id"), "new"), "tax_id", "left")
    rows = rows.join((no_deleted if deleted is None else deleted).select("tax_id", F.lit(True).alias("gone")), "tax_id", "left")
    rows = rows.withColumn("at", F.coalesce("new", "tax_id")).join(tree.select(F.col("tax_id").alias("at"), F.lit(True).alias("known")), "at", "left")
    status = F.when(F.col("known") & F.col("new").isNotNull(), "merged").when(F.col("known"), "current").when(F.col("gone"), "deleted").otherwise("unknown")
    return rows.select("tax_id", F.when(F.col("known"), F.col("at")).alias("current"), status.alias("status"))


def id_counts(resolved: DataFrame) -> DataFrame:
    """(status, n) of ``resolved_ids``: how many ids are current, merged, deleted and unknown."""
    return resolved.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def needed_nodes(chains: DataFrame, tree: DataFrame) -> DataFrame:
    """The nodes that some chain holds."""
    return tree.join(chains.select(F.col("ancestor").alias("tax_id")).distinct(), "tax_id", "left_semi")


def lineage(ids: DataFrame, tree: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """(tax_id, depth, ancestor): each id's chain to the root, itself at depth 0. Merged ids are followed first,
    unknown ones give nothing, a node that is its own parent ends the chain.

    Chains double: a table of ancestors 1, 2, 4 ... steps up is joined with itself until no node has one, and each of
    them lengthens the chains to twice their size. Nodes that come round to themselves would have one for ever; then
    it is an error, found by the tables alone.
    """
    nodes_, jumps = tree.count(), []
    jump = checkpointed(tree.where("parent <> tax_id").select("tax_id", F.col("parent").alias("up")))
    while not jump.isEmpty():
        if 1 << len(jumps) > nodes_:
            raise ValueError("the taxonomy has nodes that are their own ancestors")
        jumps.append(jump)
        jump = checkpointed(jump.join(jump.toDF("up", "further"), "up").select("tax_id", F.col("further").alias("up")))
    chains = resolved_ids(ids, tree, merged).where("current is not null").select("tax_id", F.lit(0).alias("depth"), F.col("current").alias("ancestor"))
    for k, step in enumerate(jumps):
        longer = chains.join(step.toDF("ancestor", "up"), "ancestor").select("tax_id", (F.col("depth") + (1 << k)).alias("depth"), F.col("up").alias("ancestor"))
        # Each table is read twice by the next step, so that the chains are written now and then.
        chains = chains.unionAll(longer) if k % 3 else checkpointed(chains.unionAll(longer))
    return chains


def common_ancestor(groups: DataFrame, chains: DataFrame) -> DataFrame:
    """(grp, ancestor, members): the deepest node that all of a group's (grp, tax_id) have in their chains."""
    members = groups.select("grp", "tax_id").distinct()
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    shared = members.join(chains, "tax_id").groupBy("grp", "ancestor").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"))
    full = shared.join(sizes, "grp").where("n = members")
    return full.groupBy("grp").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("ancestor"), F.first("members").alias("members"))


def distance_to_group(groups: DataFrame, chains: DataFrame) -> DataFrame:
    """(grp, tax_id, distance): steps from a member up to the nearest node that all other members share."""
    members = groups.select("grp", "tax_id").distinct()
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    held = members.join(chains, "tax_id").select("grp", "tax_id", "ancestor", "depth")
    counts = held.groupBy("grp", "ancestor").agg(F.count(F.lit(1)).alias("n"))
    # An ancestor of this member that all the others have too: every member of the group has it.
    rows = held.join(counts, ["grp", "ancestor"]).join(sizes, "grp").where((F.col("n") == F.col("m")) & (F.col("m") > 1))
    return rows.groupBy("grp", "tax_id").agg(F.min("depth").alias("distance"))
