"""Clusters of similar references: MinHash signatures and longest-first greedy choice, in rounds of joins."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import udfs
from .graph import checkpointed
from .ranks import ranked

HASHES = 24


def minhash(records: DataFrame, k: int = 5, hashes: int = HASHES) -> DataFrame:
    """Records with ``sig``: per hash, the least FNV-1a value over the k-mers of ``seq``."""
    return records.withColumn("sig", udfs.minhash(F.col("seq"), k, [(h * 2654435761) & 0xFFFFFFFF for h in range(hashes)]))


def bands(hashes: int, least: int) -> list[tuple[int, ...]]:
    """Sets of one or two places such that any ``least`` places hold one of them whole: places are dealt to least - 1
    groups, of which some must get two, and all pairs inside a group are bands."""
    if least < 2:
        return [(i,) for i in range(hashes)]
    groups = [range(g, hashes, least - 1) for g in range(least - 1)]
    return [pair for g in groups for pair in combinations(g, 2)]


def greedy_clusters(records: DataFrame, threshold: float = 0.5, first: int = 32) -> DataFrame:
    """(family, header, representative): longest first, then by header, each joins the first representative whose
    signature agrees in ``threshold`` of its places, and is one itself if there is none.

    What similar signatures share, a band of ``bands``, names the candidates, which are compared in full. In each round,
    an open record that no earlier open one is similar to becomes a representative, and what is similar to it is covered.
    Of a band only the first open records are looked at in a round, so that a band that many share costs rounds and no
    pairs of all its records. Records with one signature are one; the first stands for them.
    """
    rows = minhash(records).select("family", "header", F.struct((-F.length("seq")).alias("n"), "header").alias("ord"), "sig")
    rows = checkpointed(rows)
    alike = rows.groupBy("family", "sig").agg(F.min("ord").alias("ord"))
    recs = checkpointed(ranked(alike, "family", "ord").select("family", "ord", "sig", F.col("rank").alias("id")))
    places = bands(HASHES, math.ceil(threshold * HASHES))
    keys = F.array(*[F.xxhash64("family", F.lit(k), *[F.get("sig", F.lit(i)) for i in at]) for k, at in enumerate(places)])
    keyed = checkpointed(recs.select("id", F.explode(F.array_distinct(keys)).alias("key")))
    wide = checkpointed(keyed.groupBy("id").agg(F.count(F.lit(1)).alias("keys")))
    sigs = recs.select("id", "family", "sig")

    def similar(pairs: DataFrame) -> DataFrame:
        """Of (a, b), those of one family whose signatures agree enough."""
        both = pairs.distinct().join(sigs.select(F.col("id").alias("a"), F.col("family").alias("fa"), F.col("sig").alias("sa")), "a")
        both = both.join(sigs.select(F.col("id").alias("b"), F.col("family").alias("fb"), F.col("sig").alias("sb")), "b")
        same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
        return both.where((F.col("fa") == F.col("fb")) & (same >= F.lit(threshold * HASHES))).select("a", "b")

    # The representative of each record so far; null means open.
    state = recs.select("id", F.lit(None).cast("int").alias("rep"))
    while True:
        open_ = state.where("rep is null").select("id")
        nth = F.row_number().over(W.partitionBy("key").orderBy("id"))
        top = checkpointed(keyed.join(open_, "id").withColumn("nth", nth).where(F.col("nth") <= first))
        if top.isEmpty():
            break
        pairs = top.select("key", F.col("id").alias("a")).join(top.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
        blocked = similar(pairs).select(F.col("b").alias("id")).distinct()
        # A record is decided if it is among the first of all its bands.
        seen = top.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(wide, "id").where("n = keys").select("id")
        chosen = checkpointed(seen.join(blocked, "id", "left_anti"))
        reached = keyed.join(chosen, "id").select("key", F.col("id").alias("a")).join(keyed.withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b")
        nearest = similar(reached).groupBy("b").agg(F.min("a").alias("near")).withColumnRenamed("b", "id")
        own = chosen.withColumn("own", F.col("id"))
        moved = state.join(nearest, "id", "left").join(own, "id", "left")
        # An earlier representative may come later than a later one: the first counts.
        state = checkpointed(moved.select("id", F.coalesce("own", F.least("rep", "near")).alias("rep")))
    named = recs.select(F.col("id").alias("rep"), F.col("ord.header").alias("representative"))
    found = recs.select("family", "sig", "id").join(state, "id").join(named, "rep").select("family", "sig", "representative")
    return rows.join(found, ["family", "sig"]).select("family", "header", "representative")


def cluster_report(clusters: DataFrame) -> DataFrame:
    """Per family and in TOTAL: sequences, clusters and the share kept."""
    rows = clusters.rollup("family").agg(F.count(F.lit(1)).alias("originals"), F.count_if(F.col("header") == F.col("representative")).alias("clusters"))
    return rows.select(F.coalesce("family", F.lit("TOTAL")).alias("family"), "originals", "clusters", (F.col("clusters") / F.col("originals")).alias("kept"))
