"""From files to exports."""

from __future__ import annotations

import gzip
import random

import pytest

from binloom.functions.udfs import register
from binloom.plans.review import Review


def test_review_of_files(spark, tmp_path):
    rng = random.Random(1)
    seqs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(60 * (i + 1))) for i in range(6)}
    with gzip.open(tmp_path / "assembly.packed", "wt") as f:
        f.write("".join(f">{k} x\n{v}\n" for k, v in seqs.items()) + ">odd\nAC\nACGT\n")
    (tmp_path / "one.tsv").write_text("c0\tb1\nc1\tb1\nc2\tb2\nc3\tb2\n")
    (tmp_path / "two.tsv").write_text("contig,bin\nc0,A\nc1,A\nc2,B\nc3,A\n")
    (tmp_path / "cov.tsv").write_text("c0\t1\t3\nc1\t2\t2\nc2\t5\t5\n")
    r = Review(spark, str(tmp_path / "assembly.packed"), [str(tmp_path / f) for f in ("one.tsv", "two.tsv", "cov.tsv")])
    assert {(x.label, x.format) for x in r.heads.collect()} == {("one", "contig-bin"), ("two", "contig-bin"), ("cov", "coverage")}
    contigs = {x.contig_id: x for x in r.contigs.collect()}
    assert set(contigs) == {"c0", "c1", "c2", "c3"} and contigs["c0"].mean_depth == 2 and contigs["c3"].mean_depth is None
    state = {x.contig_id: x.bin_id for x in r.state.collect()}
    assert state == {"c0": "MAG_1", "c1": "MAG_1", "c2": "MAG_2"}  # c3 is tied
    assert {x.state for x in r.neighbourhood().where("contig_id = 'c3'").collect()} == {"tied"}
    assert {x.mag_id for x in r.evidence().where("contig_id = 'c3'").collect()} == {"MAG_1", "MAG_2"}
    r.edit(spark.createDataFrame([(1, "c3", "MAG_2")], "seq long, contig_id string, bin_id string"))
    assert {x.bin_id: x.contig_count for x in r.summary().collect()} == {"MAG_1": 2, "MAG_2": 2}
    assert {x.mag_id: x.held_here for x in r.mag_summary().collect()} == {"MAG_1": 0, "MAG_2": 1}
    r.edit(spark.createDataFrame([(2, "odd", "MAG_2")], "seq long, contig_id string, bin_id string"))
    assert [tuple(x) for x in r.export(str(tmp_path / "out")).collect()] == [("MAG_2", "odd")]
    lines = sorted(x.value for x in spark.read.text(str(tmp_path / "out/assignment")).collect())
    assert lines == ["c0,MAG_1", "c1,MAG_1", "c2,MAG_2", "c3,MAG_2", "contig_id,bin_id", "odd,MAG_2"]
    lines = sorted(x.value for x in spark.read.text(str(tmp_path / "out/bins/bin_id=MAG_1")).collect())
    assert lines == sorted([">c0 x", ">c1 x", seqs["c0"], seqs["c1"]])  # lines stay as they were
    r.export(str(tmp_path / "less"), spark.createDataFrame([("MAG_2",)], "mag_id string"))
    lines = sorted(x.value for x in spark.read.text(str(tmp_path / "less/assignment")).collect())
    assert lines == ["c0,MAG_1", "c1,MAG_1", "contig_id,bin_id"]
    assert [x.value.split(",")[0] for x in spark.read.text(str(tmp_path / "less/summary")).collect() if x.value.startswith("MAG")] == ["MAG_1"]
    assert {x.name for x in (tmp_path / "less/bins").iterdir() if x.is_dir()} == {"bin_id=MAG_1", "bin_id=MAG_2"}


def test_supplied_hits_come_first(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">c0\nACGT\n>c1\nACGTA\n")
    (tmp_path / "t.tsv").write_text("c0\tb1\nc1\tb1\n")
    given = spark.createDataFrame([("c0", "COG1"), ("c0", "COG2")], "contig_id string, family string")
    r = Review(spark, str(tmp_path / "a.fasta"), [str(tmp_path / "t.tsv")], supplied=given)
    assert sorted(tuple(x) for x in r.hits.collect()) == [("c0", "COG1"), ("c0", "COG2")]
    assert [x.families_found for x in r.summary().collect()] == [2]
    with pytest.raises(ValueError, match="no FASTA"):
        Review(spark, str(tmp_path / "t.tsv"), [])


def test_functions_in_sql(spark):
    register(spark)
    row = spark.sql("SELECT revcomp('ACGTN') AS r, six_frames('ATGGCATTT')[0] AS f, contig_stats('GGCC').gc_content AS gc").first()
    assert (row.r, row.f, row.gc) == ("NACGT", "MAF", 1.0)
