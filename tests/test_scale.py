"""What must stay small, or be told in full, as tables grow."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from binloom.functions import kernels, sequence, udfs
from binloom.operators import clusters, markers, network
from binloom.sources import fasta, indexed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Files


def test_texts_of_spans_meet_no_exchange(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(b"".join(b">c%d x\nACGT\nAC\n" % i for i in range(9)) + b">odd\nA\nACGT\n")
    indexed.write_index(fasta.read_fasta(spark, f"{tmp_path}/a.fasta"), f"{tmp_path}/index")
    groups = spark.createDataFrame([("g", "c1", 0), ("h", "c1", 3), ("h", "c1", 3), ("h", "c2", 1), ("h", "odd", 2), ("h", None, 4)], "grp string, id string, pos int")
    texts, skipped = indexed.extracted(groups, spark.read.parquet(f"{tmp_path}/index"))
    assert "Exchange" not in plan_of(texts).split("MapInArrow")[0].replace("AdaptiveSparkPlan", "")
    assert sorted((r.grp, r.id, r.pos) for r in texts.collect()) == [("g", "c1", 0), ("h", "c1", 3), ("h", "c1", 3), ("h", "c2", 1)]
    assert {r.value for r in texts.where("id = 'c1'").collect()} == {">c1 x\nACGT\nAC\n"}
    assert sorted((r.id or "", r.pos) for r in skipped.collect()) == [("", 4), ("odd", 2)]


# Calls


def test_equal_rows_of_one_representative_are_told_by_their_order(spark):
    rows = [(1, "COG1", 5, tax, 60, 0.9, at) for at, tax in ((3, 7), (1, 9), (2, 8))] + [(1, "COG1", 6, 4, 60, 0.9, 0)]
    given = markers.parameters(spark, markers.Search())
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "contig_id int, family string, ref_id int, tax_id int, score int, coverage double, at int").coalesce(1)
        assert [r.tax_id for r in markers.calls(df, markers.Search(), given, ("at",)).collect()] == [9]
        assert [r.tax_id for r in markers.calls(df, markers.Search(), given).collect()] == [7]


# Sequences


def test_kmers_are_counted_without_a_row_for_each_window(spark):
    rng = random.Random(5)
    seqs = ["", None, "ACG", "acgt", "NNNNN"] + ["".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    windows, contigs = Counter(), Counter()
    turn = str.maketrans("ACGT", "TGCA")
    for s in seqs:
        words = [s.upper()[i : i + 4] for i in range(len(s) - 3)] if s else []
        here = Counter(min(w, w.translate(turn)[::-1]) for w in words if "N" not in w)
        windows, contigs = windows + here, contigs + Counter(here.keys())
    rows = udfs.kmer_totals(spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(3))
    assert "Generate" not in plan_of(rows)
    got = rows.groupBy("k").agg(F.sum("windows").alias("w"), F.sum("contigs").alias("c")).collect()
    names = sequence.canonical_kmers()
    assert {names[r.k]: (r.w, r.c) for r in got} == {k: (n, contigs[k]) for k, n in windows.items()}


def test_signatures_are_hashed_in_arrays(spark):
    rows = clusters.minhash(spark.createDataFrame([(s,) for s in ("", None, "MKLV", "MKLVA", "MKLVAMKLVA")], "seq string"))
    assert "ArrowEvalPython" in plan_of(rows)
    last = [r.sig for r in rows.collect()]
    assert last[0] == last[1] == last[2] == [0xFFFFFFFF] * clusters.HASHES
    words = {"MKLVAMKLVA"[i : i + 5] for i in range(6)}
    seeds = [(h * 2654435761) & 0xFFFFFFFF for h in range(clusters.HASHES)]
    by_hand = [min(spark.range(1).select(sequence.fnv1a(F.lit(w), s)).first()[0] for w in words) for s in seeds[:2]]
    assert last[4][:2] == by_hand


def test_texts_of_pairs_are_taken_in_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    sizes, real = [], kernels.extend_ungapped_all
    monkeypatch.setattr(kernels, "extend_ungapped_all", lambda q, *a: sizes.append(len(q)) or real(q, *a))
    n = 2 * udfs.PAIRS + 5
    whole = pa.array(["MKLVA"] * n)
    got = udfs.extend_ungapped.func(whole, whole, pa.array([1] * n), pa.array([1] * n), pa.array([15, 3] * (n // 2) + [15]))
    assert max(sizes) <= udfs.PAIRS and sum(sizes) == n
    assert set(np.asarray(got.field("score"))) == {real(["MKLVA"], ["MKLVA"], [1], [1])[0][0]}
    assert isinstance(udfs.contig_stats.func(pa.array(["ACGT", None])).field("composition"), pa.ListArray)


# Networks


def test_pairs_around_mags_are_not_grouped(spark):
    votes = spark.createDataFrame([("c1", "A", "M1"), ("c1", "B", "M2"), ("c2", "A", "M1"), ("c2", "B", "M1"), ("c3", "B", "M2")], "contig_id string, tool string, mag_id string")
    mags = spark.createDataFrame([("M1",), ("M2",)], "mag_id string")
    agreed = spark.createDataFrame([("c1", 2), ("c2", 1), ("c3", 1)], "contig_id string, distinct_groups long")
    state = spark.createDataFrame([("c2", "M1")], "contig_id string, bin_id string")
    rows = network.around(votes, mags, agreed, state)
    assert "keys=[mag_id" not in plan_of(rows).split("array_intersect")[0]
    got = {(r.mag_id, r.contig_id): (r.n_hubs, r.connected, r.fate) for r in rows.collect()}
    assert got == {("M1", "c1"): (2, 1, "tied"), ("M2", "c1"): (2, 1, "tied"), ("M1", "c2"): (1, 0, "uncontended"), ("M2", "c2"): (1, 1, None), ("M1", "c3"): (1, 1, None), ("M2", "c3"): (1, 0, "uncontended")}


def test_leaves_are_limited_by_parts(spark):
    rows = spark.range(900).selectExpr("concat('M', id % 2) AS mag_id", "lpad(id, 4, '0') AS contig_id")
    kept = network.limited(rows, 20)
    assert "_part" in plan_of(kept)
    got = kept.collect()
    assert sorted((r.mag_id, r.place, r.contig_id) for r in got) == [(f"M{m}", k + 1, f"{2 * k + m:04}") for m in (0, 1) for k in range(20)]
    assert all(r.truncated for r in got) and not any(r.truncated for r in network.limited(rows, 450).collect())
