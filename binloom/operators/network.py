"""The neighbourhood of each MAG as hubs, leaves and edges, and layouts of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .assignment import EXCLUDED

HUBS = 40
NODES = 300
#: Parts that the leaves of a MAG are dealt to.
LEAF_PARTS = 64


@dataclass(frozen=True)
class View:
    uncontended: bool = False
    resolved: bool = True
    connected: bool = False


def rivals(votes: DataFrame, mags: DataFrame, agreed: DataFrame) -> DataFrame:
    """(mag_id, rival, weight, place): MAGs that contend for a MAG's contigs, heaviest first. All MAGs at once."""
    contested = agreed.where("distinct_groups > 1").select("contig_id")
    known = votes.join(mags.select("mag_id"), "mag_id", "left_semi")
    own = known.select("contig_id", "mag_id").distinct().join(contested, "contig_id", "left_semi")
    pairs = own.join(known.select("contig_id", F.col("mag_id").alias("rival")), "contig_id").where("mag_id <> rival")
    weights = pairs.groupBy("mag_id", "rival").agg(F.count(F.lit(1)).alias("weight"))
    return weights.withColumn("place", F.row_number().over(W.partitionBy("mag_id").orderBy(F.desc("weight"), "rival")))


def around(votes: DataFrame, mags: DataFrame, agreed: DataFrame, state: DataFrame, hubs: int = HUBS) -> DataFrame:
    """(mag_id, contig_id, fate, connected, state, n_hubs): contigs that some view of a MAG may show, each once.

    ``fate`` tells why one of the MAG's own contigs is shown or hidden: 'uncontended', 'low' if all its rivals are
    beyond the hubs, 'resolved' if it has a holder, else 'tied'; null for contigs of other MAGs. ``connected`` counts
    the shown rivals that have the contig.
    """
    shown = rivals(votes, mags, agreed).where(F.col("place") <= hubs).select("mag_id", F.col("rival").alias("hub"))
    shown = shown.unionAll(mags.select("mag_id", "mag_id"))
    # A contig has at most a vote of each tool, a MAG at most ``hubs`` others: both are short lists.
    held = votes.groupBy("contig_id").agg(F.collect_set("mag_id").alias("held"))
    rows = held.join(agreed.select("contig_id", "distinct_groups"), "contig_id").join(state.select("contig_id", "bin_id"), "contig_id", "left")
    lists = shown.groupBy("mag_id").agg(F.collect_set("hub").alias("hubs"))
    # Around each MAG: the contigs of all its hubs, itself among them. Each pair comes from the least hub that both
    # lists have, so that the pairs, which are many more than contigs, are neither grouped nor shuffled.
    near = rows.withColumn("hub", F.explode("held")).join(shown, "hub").join(lists, "mag_id").withColumn("common", F.array_intersect("held", "hubs"))
    n_hubs, own = F.size("common").cast("long"), F.array_contains("common", F.col("mag_id")).cast("long")
    rows = near.where(F.col("hub") == F.array_min("common")).select("mag_id", "contig_id", "distinct_groups", "bin_id", n_hubs.alias("n_hubs"), own.alias("own"), (n_hubs - own).alias("connected"))
    fate = (
        F.when(F.col("own") == 0, F.lit(None).cast("string"))
        .when(F.col("distinct_groups") <= 1, "uncontended")
        .when(F.col("n_hubs") == 1, "low")
        .when(F.col("bin_id").isNotNull(), "resolved")
        .otherwise("tied")
    )
    kind = (
        F.when(F.col("n_hubs") == 1, "core")
        .when(F.col("bin_id").isNull(), "tied")
        .when(F.col("bin_id") == EXCLUDED, "excluded")
        .when(F.col("bin_id") == F.col("mag_id"), "held-here")
        .otherwise("held-elsewhere")
    )
    return rows.select("mag_id", "contig_id", fate.alias("fate"), "connected", kind.alias("state"), "n_hubs")


def _own(view: View):
    """Whether a view shows an own contig by its fate."""
    return F.coalesce((F.col("fate") == "tied") | ((F.col("fate") == "resolved") & view.resolved) | ((F.col("fate") == "uncontended") & view.uncontended), F.lit(False))


def viewed(found: DataFrame, view: View = View()) -> DataFrame:
    """(mag_id, contig_id, state, n_hubs): what a view shows of ``around``; with ``connected``, all contigs of rivals too."""
    shown = _own(view) | (F.lit(view.connected) & (F.col("connected") > 0))
    return found.where(shown).select("mag_id", "contig_id", "state", "n_hubs")


def leaves(votes: DataFrame, mags: DataFrame, agreed: DataFrame, state: DataFrame, view: View = View(), hubs: int = HUBS) -> DataFrame:
    """(mag_id, contig_id, state, n_hubs): the contigs shown around each MAG and how they stand."""
    return viewed(around(votes, mags, agreed, state, hubs), view)


def view_totals(found: DataFrame, contenders: DataFrame, mags: DataFrame, view: View = View(), most_hubs: int = HUBS, most: int = NODES) -> DataFrame:
    """A row for each MAG: what a view shows, and what it hides for which reason.

    (mag_id, hubs, all_hubs, hidden_hubs, leaves, all_leaves, truncated, tied, hidden_uncontended, hidden_low_relevance,
    hidden_resolved, hidden_connected); a hidden contig counts once for each shown rival that has it.
    """
    count = lambda c, name: F.count_if(c).alias(name)
    fate = F.col("fate")
    hidden = found.groupBy("mag_id").agg(
        count((fate == "uncontended") & F.lit(not view.uncontended), "hidden_uncontended"),
        count(fate == "low", "hidden_low_relevance"),
        count((fate == "resolved") & F.lit(not view.resolved), "hidden_resolved"),
        F.sum(F.when(~_own(view) & F.lit(not view.connected), F.col("connected")).otherwise(0)).alias("hidden_connected"),
    )
    some = viewed(found, view)
    every = some.groupBy("mag_id").agg(F.count(F.lit(1)).alias("all_leaves"))
    tied = limited(some, most).groupBy("mag_id").agg(count(F.col("state") == "tied", "tied"))
    hubs_ = contenders.groupBy("mag_id").agg(F.count(F.lit(1)).alias("all_hubs"))
    out = mags.select("mag_id")
    for part in (hubs_, every, tied, hidden):
        out = out.join(part, "mag_id", "left")
    out = out.fillna(0)
    return out.select(
        "mag_id", F.least("all_hubs", F.lit(most_hubs)).alias("hubs"), "all_hubs", F.greatest(F.col("all_hubs") - most_hubs, F.lit(0)).alias("hidden_hubs"),
        F.least("all_leaves", F.lit(most)).alias("leaves"), "all_leaves", (F.col("all_leaves") > most).alias("truncated"), "tied",
        "hidden_uncontended", "hidden_low_relevance", "hidden_resolved", "hidden_connected",
    )


def limited(rows: DataFrame, most: int = NODES) -> DataFrame:
    """The first ``most`` leaves of each MAG by contig id, with a flag if more were left out."""
    # First among the leaves of each part, one more than wanted: a MAG's leaves are never all in one task. A running
    # count, as Spark would sort all leaves before the shuffle too for a limit on row_number.
    part = rows.withColumn("_part", F.pmod(F.xxhash64("contig_id"), F.lit(LEAF_PARTS)))
    inside = W.partitionBy("mag_id", "_part").orderBy("contig_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    few = part.withColumn("_nth", F.count(F.lit(1)).over(inside)).where(F.col("_nth") <= most + 1).drop("_part", "_nth")
    w = W.partitionBy("mag_id")
    ranked = few.withColumns({"place": F.row_number().over(w.orderBy("contig_id")), "total": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("place") <= most).withColumn("truncated", F.col("total") > most).drop("total")


def edges(shown: DataFrame, votes: DataFrame, mags: DataFrame) -> DataFrame:
    """(mag_id, contig_id, hub, tool) for each vote of a shown leaf for a putative MAG."""
    v = votes.join(mags.select("mag_id"), "mag_id", "left_semi").select("contig_id", F.col("mag_id").alias("hub"), "tool")
    return shown.select("mag_id", "contig_id").join(v, "contig_id").toDF("contig_id", "mag_id", "hub", "tool")


def neighbourhood_counts(rows: DataFrame) -> DataFrame:
    """Per MAG, its leaves by state."""
    states = ("core", "tied", "excluded", "held-here", "held-elsewhere")
    return rows.groupBy("mag_id").agg(F.count(F.lit(1)).alias("leaves"), *[F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in states])


def hubs(votes: DataFrame, mags: DataFrame, agreed: DataFrame, most: int = HUBS) -> DataFrame:
    """(mag_id, hub): each MAG, and the rivals that are shown around it."""
    shown = rivals(votes, mags, agreed).where(F.col("place") <= most).select("mag_id", F.col("rival").alias("hub"))
    return shown.unionAll(mags.select("mag_id", "mag_id"))


def hidden_counts(contenders: DataFrame, rows: DataFrame, mags: DataFrame, most_hubs: int = HUBS, most: int = NODES) -> DataFrame:
    """(mag_id, hidden_hubs, hidden_leaves): what the limits leave out of a MAG's network."""
    over = contenders.groupBy("mag_id").agg(F.greatest(F.count(F.lit(1)) - most_hubs, F.lit(0)).alias("hidden_hubs"))
    rest = rows.groupBy("mag_id").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("hidden_leaves"))
    return mags.select("mag_id").join(over, "mag_id", "left").join(rest, "mag_id", "left").fillna(0, ["hidden_hubs", "hidden_leaves"])


# Layouts: (mag_id, contig_id, angle, x, y) of the leaves, (mag_id, hub, angle, x, y) of the hubs


@dataclass(frozen=True)
class Canvas:
    width: float = 400
    height: float = 400
    # The least margin and its share of the side; radii and spans of the rings as shares.
    margin: float = 24
    margin_share: float = 0.08
    centre: float = 0.18
    middle: float = 0.55
    near_hub: float = 0.85
    petal_hubs: float = 0.28
    near_span: float = 0.5
    span: float = 0.8

    @property
    def radius(self) -> float:
        side = min(self.width, self.height)
        return max(1.0, side / 2 - max(self.margin, side * self.margin_share))


TURN = 2 * 3.141592653589793


def _round(angle, radius, c: Canvas) -> dict:
    return {"angle": angle, "x": F.lit(c.width / 2) + radius * F.cos(angle), "y": F.lit(c.height / 2) + radius * F.sin(angle)}


def _spoke(key: str, *by: str):
    """Angles of things by rank, the first at the top."""
    w = W.partitionBy(*by)
    return TURN * (F.row_number().over(w.orderBy(key)) - 1) / F.count(F.lit(1)).over(w) - TURN / 4


def ring_hubs(around: DataFrame, c: Canvas = Canvas()) -> DataFrame:
    """The MAG itself in the centre, the other hubs on the outer ring."""
    outer = around.where("hub <> mag_id").withColumns(_round(_spoke("hub", "mag_id"), F.lit(c.radius), c))
    own = around.where("hub = mag_id").withColumns({"angle": F.lit(0.0), "x": F.lit(float(c.width / 2)), "y": F.lit(float(c.height / 2))})
    return outer.unionByName(own)


def _fan(rows: DataFrame, span, *by: str):
    """Offsets from the middle of an arc, evenly over its span; a single leaf takes the middle."""
    w = W.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    t = F.when(n == 1, 0.5).otherwise((F.row_number().over(w.orderBy("contig_id")) - 1) / (n - 1))
    return (t - 0.5) * span


def _linked(shown: DataFrame, links: DataFrame, around: DataFrame) -> DataFrame:
    """(mag_id, contig_id, hub): the shown hubs of each shown leaf."""
    rows = links.select("mag_id", "contig_id", "hub").distinct().join(around.select("mag_id", "hub"), ["mag_id", "hub"], "left_semi")
    return rows.join(shown.select("mag_id", "contig_id"), ["mag_id", "contig_id"], "left_semi")


def ring_layout(shown: DataFrame, links: DataFrame, around: DataFrame, c: Canvas = Canvas()) -> DataFrame:
    """Contended leaves on a middle ring, in the sector of their least other hub; a hub's own leaves close to it."""
    own = _linked(shown, links, around).groupBy("mag_id", "contig_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("hub") != F.col("mag_id"), F.col("hub"))).alias("hub"))
    spokes = ring_hubs(around, c).where("hub <> mag_id").select("mag_id", "hub", F.col("angle").alias("middle"))
    sectors = spokes.groupBy("mag_id").agg((TURN / F.count(F.lit(1))).alias("sector"))
    rows = own.join(spokes, ["mag_id", "hub"], "left").join(sectors, "mag_id", "left").withColumn("contended", F.col("n") > 1)
    share = F.when(F.col("contended"), c.span).otherwise(c.near_span)
    fan = _fan(rows, F.col("sector") * share, "mag_id", "hub", "contended")
    angle = F.when(F.col("hub").isNull(), _spoke("contig_id", "mag_id", "hub", "contended")).otherwise(F.col("middle") + fan)
    radius = c.radius * F.when(F.col("hub").isNull(), c.centre).when(F.col("contended"), c.middle).otherwise(c.near_hub)
    return rows.withColumns({"a": angle, "r": radius}).withColumns(_round(F.col("a"), F.col("r"), c)).select("mag_id", "contig_id", "angle", "x", "y")


def petal_hubs(around: DataFrame, c: Canvas = Canvas()) -> DataFrame:
    """All hubs on an inner ring."""
    return around.withColumns(_round(_spoke("hub", "mag_id"), F.lit(c.radius * c.petal_hubs), c))


def petal_layout(shown: DataFrame, links: DataFrame, around: DataFrame, c: Canvas = Canvas()) -> DataFrame:
    """Leaves on the outer ring, in the sector of their least hub."""
    own = _linked(shown, links, around).groupBy("mag_id", "contig_id").agg(F.min("hub").alias("hub"))
    spokes = petal_hubs(around, c).select("mag_id", "hub", F.col("angle").alias("middle"))
    sectors = spokes.groupBy("mag_id").agg((TURN / F.count(F.lit(1)) * c.span).alias("span"))
    rows = own.join(spokes, ["mag_id", "hub"]).join(sectors, "mag_id")
    angle = F.col("middle") + _fan(rows, F.col("span"), "mag_id", "hub")
    return rows.withColumn("a", angle).withColumns(_round(F.col("a"), F.lit(c.radius), c)).select("mag_id", "contig_id", "angle", "x", "y")


LAYOUTS = {"ring": ring_layout, "petal": petal_layout}


def layout(name: str, shown: DataFrame, links: DataFrame, around: DataFrame, c: Canvas = Canvas()) -> DataFrame:
    """The layout of that name; the ring for any other."""
    return LAYOUTS.get(name, ring_layout)(shown, links, around, c).select("mag_id", "contig_id", "x", "y")
