"""Marker-gene search: seeds joined with an index, two-hit diagonals, extensions, calls; and building the index."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import header_family, header_taxon
from ..functions.udfs import extend_gapped, extend_ungapped, six_frames
from .graph import checkpointed
from .ranks import ranked, ranked_within


@dataclass(frozen=True)
class Search:
    k: int = 9
    drop: int = 15
    min_score: int = 50
    min_coverage: float = 0.3
    min_margin: int = 10
    min_representatives: int = 2
    stride: int = 4
    seeds: int = 150  # windows of a segment, about
    gapped: bool = False
    gap: int = 8
    band: int = 16
    # Families whose override beats the caller's own values.
    overrides: dict[str, int] = field(default_factory=lambda: dict.fromkeys(SINGLE_REPRESENTATIVE, 1))
    margins: dict[str, int] = field(default_factory=dict)  # of families, in place of min_margin
    # Of families, any of FAMILY_FIELDS; they come after the two above.
    families: dict[str, dict[str, float]] = field(default_factory=dict)


# Families that one representative is enough for.
SINGLE_REPRESENTATIVE = ("COG0495", "COG0525", "COG0012", "COG0016", "COG0018", "COG0085", "COG0124", "COG0201", "COG0202", "COG0215", "COG0552")


#: An index of at most so many bytes is sent to the tasks; a larger one is joined as Spark sees fit.
INDEX_SENT_BYTES, INDEX_ROW_BYTES = 64 << 20, 48

#: What a family can have a value of its own for: the rest is decided before hits have a family.
FAMILY_FIELDS = {"min_score": "double", "min_coverage": "double", "min_margin": "double", "min_representatives": "int"}
PARAMETERS = ", ".join(["family string", *(f"{k} {t}" for k, t in FAMILY_FIELDS.items())])


def parameters(spark: SparkSession, s: Search) -> DataFrame:
    """(family, min_score, min_coverage, min_margin, min_representatives) of the families that have any of their own."""
    rows = {}
    for name, values in (("min_representatives", s.overrides), ("min_margin", s.margins)):
        for f, v in values.items():
            rows.setdefault(f, {})[name] = v
    for f, values in s.families.items():
        rows.setdefault(f, {}).update({k: v for k, v in values.items() if k in FAMILY_FIELDS})
    cast = lambda k, v: None if v is None else int(v) if FAMILY_FIELDS[k] == "int" else float(v)
    return spark.createDataFrame([(f, *(cast(k, r.get(k)) for k in FAMILY_FIELDS)) for f, r in sorted(rows.items())], PARAMETERS)


def with_parameters(rows: DataFrame, given: DataFrame, s: Search) -> DataFrame:
    """Rows with a family, and the value that holds for it in each of FAMILY_FIELDS; ``given`` has a row a family."""
    own = given.select("family", *[F.col(k).alias(f"_{k}") for k in FAMILY_FIELDS])
    return rows.join(own, "family", "left").withColumns({k: F.coalesce(f"_{k}", F.lit(getattr(s, k))) for k in FAMILY_FIELDS}).drop(*[f"_{k}" for k in FAMILY_FIELDS])


def ref_seqs(records: DataFrame) -> DataFrame:
    """(ref_id, family, tax_id, residues, len) from (header, seq); ids in header order."""
    rows = records.select(header_family(F.col("header")).alias("family"), header_taxon(F.col("header")).alias("tax_id"), F.col("seq").alias("residues"), "header")
    return ranked(rows, "header", "residues").select((F.col("rank") - 1).cast("int").alias("ref_id"), "family", "tax_id", "residues", F.length("residues").alias("len"))


def seed_index(refs: DataFrame, k: int = 9, min_hits: int = 3, max_hits: int = 20) -> DataFrame:
    """(code, ref_id, ref_pos): windows of the references; rare codes go, frequent ones are thinned evenly."""
    hits = _seeded(refs.select("ref_id", "residues"), k, 0, 1).select("code", "ref_id", F.col("pos").alias("ref_pos"))
    index = checkpointed(thinned(hits, "code", ("ref_id", "ref_pos"), min_hits, max_hits))
    # It grows with the references: sent to the tasks only if its count shows that it is small.
    return F.broadcast(index) if index.count() * INDEX_ROW_BYTES <= INDEX_SENT_BYTES else index


def _seeded(rows: DataFrame, k: int, cap: int, stride: int) -> DataFrame:
    """The columns of ``rows`` but the last, which holds residues, with (code, pos) of each window."""
    names = rows.columns[:-1]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions.kernels import seed_arrays

        for b in batches:
            got = [seed_arrays(a or "", k, cap, stride) for a in b.column(len(names)).to_pylist()]
            if got:
                at = pa.array(np.repeat(np.arange(len(got)), [len(c) for c, _ in got]))
                cols = [b.column(i).take(at) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate([c for c, _ in got])), pa.array(np.concatenate([p for _, p in got]))], names=[*names, "code", "pos"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes[:-1]), "code long, pos int"]))


def thinned(rows: DataFrame, key: str, order: tuple[str, ...], least: int, most: int) -> DataFrame:
    """Keys with ``least`` rows or more; of more than ``most`` rows, those at floor(j * total / most) in order."""
    placed = ranked_within(rows, key, *order).where(F.col("_n") >= least).withColumn("_i", F.col("_rank") - 1)
    # Row i is taken if some j below ``most`` has floor(j * n / most) = i.
    j = F.ceil(F.col("_i") * most / F.col("_n"))
    taken = (F.col("_n") <= most) | ((j < most) & (F.floor(j * (F.col("_n") / most)) == F.col("_i")))
    return placed.where(taken).select(*rows.columns)


def even_sample(rows: DataFrame, key: str, order: tuple[str, ...], size: int) -> DataFrame:
    """At most ``size`` rows of each key at an even stride."""
    return thinned(rows, key, order, 1, size)


def percentile_floor(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """(key, value): the value at floor(p * n) of each key's ascending values."""
    placed = ranked_within(rows.select(key, value), key, value)
    return placed.where(F.col("_rank") - 1 == F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))).select(key, value)


def frames_of(contigs: DataFrame) -> DataFrame:
    """(contig_id, frame, aa)."""
    return contigs.select("contig_id", F.posexplode(six_frames(F.col("seq"))).alias("frame", "aa"))


def seeds(frames: DataFrame, s: Search = Search()) -> DataFrame:
    """(contig_id, frame, frame_pos, code)."""
    return _seeded(frames.select("contig_id", "frame", "aa"), s.k, s.seeds, s.stride).withColumnRenamed("pos", "frame_pos")


def diagonals(seeded: DataFrame, index: DataFrame) -> DataFrame:
    """(contig_id, frame, ref_id, diagonal, n, frame_pos): two seeds at least, anchored at the first.

    Whether the index is broadcast, ``seed_index`` says; of a stored one, Spark knows the size.
    """
    joined = seeded.join(index, "code").withColumn("diagonal", F.col("frame_pos") - F.col("ref_pos"))
    counted = joined.groupBy("contig_id", "frame", "ref_id", "diagonal").agg(F.count(F.lit(1)).alias("n"), F.min("frame_pos").alias("frame_pos"))
    return counted.where("n >= 2")


def extensions(found: DataFrame, frames: DataFrame, refs: DataFrame, s: Search = Search()) -> DataFrame:
    """The best extension of each (contig_id, ref_id) over its frames; earlier frames win ties."""
    rows = found.join(frames, ["contig_id", "frame"]).join(refs, "ref_id")
    ref_at = F.col("frame_pos") - F.col("diagonal")
    args = [F.col("aa"), F.col("residues"), F.col("frame_pos"), ref_at, F.lit(s.drop)]
    ext = extend_gapped(*args, F.lit(s.gap), F.lit(s.band)) if s.gapped else extend_ungapped(*args)
    rows = rows.select("contig_id", "ref_id", "frame", "frame_pos", "diagonal", "family", "tax_id", "len", ext.alias("e"))
    best = rows.groupBy("contig_id", "ref_id", "family", "tax_id", "len").agg(
        F.max_by(F.struct("e.score", "e.aligned", "frame"), F.struct(F.col("e.score"), -F.col("frame"), -F.col("frame_pos"), -F.col("diagonal"))).alias("b")
    )
    return best.select("contig_id", "ref_id", "family", "tax_id", "b.score", (F.col("b.aligned") / F.col("len")).alias("coverage"), "b.frame")


def calls(extended: DataFrame, s: Search = Search(), given: DataFrame | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """(contig_id, family, representatives, score, tax_id) that pass score, coverage, margin and agreement.

    ``given`` has the families' own values, as ``parameters`` makes them of ``s``. The best representative names the
    taxon; of equal ones the least ref_id is taken, and of equal rows of one ref_id the first by ``order``, then the one
    of the least taxon.
    """
    given = parameters(extended.sparkSession, s) if given is None else given
    ok = with_parameters(extended, given, s).where((F.col("score") >= F.col("min_score")) & (F.col("coverage") >= F.col("min_coverage")))
    fam = ok.groupBy("contig_id", "family").agg(
        F.count(F.lit(1)).alias("representatives"), F.max("score").alias("score"), F.min_by("tax_id", F.struct((-F.col("score")).alias("_s"), "ref_id", *order, "tax_id")).alias("tax_id"),
        F.first("min_margin").alias("min_margin"), F.first("min_representatives").alias("min_representatives"),
    )
    w = W.partitionBy("contig_id").orderBy(F.desc("score"), "family")
    top = F.first("score").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    second = F.coalesce(F.nth_value("score", 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(0))
    rival = F.greatest(F.when(F.row_number().over(w) == 1, second).otherwise(top), F.lit(0))
    rows = fam.withColumn("rival", rival).where((F.col("score") - F.col("rival") >= F.col("min_margin")) & (F.col("representatives") >= F.col("min_representatives")))
    return rows.select("contig_id", "family", "representatives", "score", "tax_id")


def extended(contigs: DataFrame, refs: DataFrame, index: DataFrame, s: Search = Search()) -> DataFrame:
    """``extensions`` of contigs (contig_id, seq). Only contigs with a diagonal are translated again."""
    found = checkpointed(diagonals(seeds(frames_of(contigs), s), index))
    hit = contigs.join(found.select("contig_id").distinct(), "contig_id", "left_semi")
    return extensions(found, frames_of(hit), refs, s)


def search(contigs: DataFrame, refs: DataFrame, index: DataFrame, s: Search = Search(), given: DataFrame | None = None) -> DataFrame:
    return calls(extended(contigs, refs, index, s), s, given)


def tuned_search(contigs: DataFrame, held: DataFrame, refs: DataFrame, index: DataFrame, s: Search = Search()) -> DataFrame:
    """``search`` with what ``calibration`` finds on held-out sequences (header, family, seq): one plan, nothing collected."""
    found = calibration(held_out_margins(held, refs, index, s), s)
    return search(contigs, refs, index, s, merged_parameters(parameters(contigs.sparkSession, s), found))


def merged_parameters(given: DataFrame, found: DataFrame) -> DataFrame:
    """Parameters with those that a calibration found in place of their own."""
    new = found.select("family", F.col("min_margin").cast("double").alias("_margin"), F.col("min_representatives").alias("_least"))
    both = given.join(new, "family", "full")
    return both.select("family", "min_score", "min_coverage", F.coalesce("_margin", "min_margin").alias("min_margin"), F.coalesce("_least", "min_representatives").cast("int").alias("min_representatives"))


def resolved(defaults: Search, shipped: dict | None = None, caller: dict | None = None) -> Search:
    """Parameters: defaults, then shipped ones, then the caller's; family overrides come on top when calling."""
    return replace(defaults, **(shipped or {}), **(caller or {})) if not set(shipped or {}) & set(caller or {}) else replace(replace(defaults, **shipped), **caller)


# Names of the parameters in a thresholds file.
THRESHOLD_NAMES = {
    "xDrop": "drop", "minScore": "min_score", "minCoverage": "min_coverage", "minMargin": "min_margin",
    "minRepresentatives": "min_representatives", "minSeedStride": "stride", "maxSeedsPerSegment": "seeds",
}


def read_thresholds(spark: SparkSession, path: str, defaults: Search = Search()) -> Search:
    """Parameters from a thresholds file (JSON): defaults, and overrides of families."""
    import json

    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    named = lambda values: {THRESHOLD_NAMES[k]: v for k, v in values.items() if k in THRESHOLD_NAMES}
    families = {f: named(v) for f, v in (found.get("familyOverrides") or {}).items()}
    least = {f: v.pop("min_representatives") for f, v in families.items() if "min_representatives" in v}
    margins = {f: v.pop("min_margin") for f, v in families.items() if "min_margin" in v}
    return replace(defaults, **named(found.get("defaultParams") or {}), overrides=least, margins=margins, families={f: v for f, v in families.items() if v})


def calibrated(s: Search, found: DataFrame) -> Search:
    """``s`` with what ``calibration`` found, a row for each family at most."""
    rows = found.collect()
    least = {r.family: int(r.min_representatives) for r in rows if r.min_representatives is not None}
    gaps = {r.family: int(r.min_margin) for r in rows if r.min_margin is not None}
    beaten = lambda f, k: (k == "min_representatives" and f in least) or (k == "min_margin" and f in gaps)
    families = {f: {k: v for k, v in values.items() if not beaten(f, k)} for f, values in s.families.items()}
    return replace(s, overrides=s.overrides | least, margins=s.margins | gaps, families=families)


def held_out_margins(held: DataFrame, refs: DataFrame, index: DataFrame, s: Search = Search(), size: int = 150) -> DataFrame:
    """(family, representatives, margin) of held-out sequences (header, family, seq of bases), ``size`` a family at most."""
    sample = even_sample(held.select("header", "family", "seq"), "family", ("header",), size)
    contigs = sample.select(F.col("header").alias("contig_id"), "seq")
    open_ = replace(s, min_margin=-(10**9), min_representatives=1, overrides={}, margins={}, families={f: {k: v for k, v in x.items() if k in ("min_score", "min_coverage")} for f, x in s.families.items()})
    found = checkpointed(extended(contigs, refs, index, s))
    called = calls(found, open_).select(F.col("contig_id").alias("header"), "family", "representatives", "score")
    ok = with_parameters(found, parameters(found.sparkSession, open_), open_).where((F.col("score") >= F.col("min_score")) & (F.col("coverage") >= F.col("min_coverage")))
    ok = ok.select(F.col("contig_id").alias("header"), F.col("family").alias("other"), F.col("score").alias("rival"))
    own = sample.select("header", "family").join(called, ["header", "family"])
    rival = own.select("header", "family").join(ok, "header").where("other <> family").groupBy("header", "family").agg(F.max("rival").alias("rival"))
    out = own.join(rival, ["header", "family"], "left")
    return out.select("family", "representatives", (F.col("score") - F.coalesce("rival", F.lit(0))).alias("margin"))


def calibration(margins: DataFrame, s: Search = Search(), share: float = 0.1, slack: float = 0.8) -> DataFrame:
    """(family, min_representatives, min_margin): values below the defaults that held-out sequences ask for.

    ``margins`` has (family, representatives, margin) of held-out sequences.
    """
    reps = percentile_floor(margins, "family", "representatives", share)
    gaps = percentile_floor(margins, "family", "margin", share)
    rows = reps.join(gaps, "family")
    r, m = F.greatest(F.lit(1), F.floor(F.col("representatives") * slack)), F.greatest(F.lit(0), F.floor(F.col("margin") * slack))
    out = rows.select("family", F.when(r < s.min_representatives, r).alias("min_representatives"), F.when(m < s.min_margin, m).alias("min_margin"))
    return out.where("min_representatives is not null or min_margin is not null")
