"""Reconciliation scenarios: what two or more binning tools say, and what must follow."""

from __future__ import annotations

import pytest

from binloom.operators.reconcile import Reconciliation, is_unbinned


def reconciled(spark, tools: dict[str, dict[str, str]], **options) -> Reconciliation:
    rows = [(t, i, c, b) for t, pairs in tools.items() for i, (c, b) in enumerate(pairs.items())]
    return Reconciliation(spark.createDataFrame(rows, "tool string, row_idx long, contig_id string, bin_id string"), **options)


def agreed(r: Reconciliation) -> dict:
    return {x.contig_id: x for x in r.agreement.collect()}


def kinds(r: Reconciliation) -> dict:
    return {x.contig_id: (x.kind, x.mag_id) for x in r.standing.collect()}


def padded(bin_id: str, contig: str, pad: str, n: int = 9) -> dict[str, str]:
    return {contig: bin_id} | {f"{pad}{i}": bin_id for i in range(n)}


def test_unbinned_labels(spark):
    rows = spark.createDataFrame([("unbinned",), ("Unbinned",), ("NA",), (" none ",), ("0",), ("bin.1",)], "b string")
    assert [r[0] for r in rows.select(is_unbinned(rows.b)).collect()] == [True, True, True, True, False, False]


def test_identical_bins_are_one_mag_each(spark):
    r = reconciled(spark, {"A": {"c1": "bin.1", "c2": "bin.1", "c3": "bin.2"}, "B": {"c1": "A", "c2": "A", "c3": "B"}})
    mags = r.mags.collect()
    assert [(m.n_members, m.tools, m.core, m.disputed) for m in sorted(mags, key=lambda m: m.rank)] == [(2, "A,B", 2, 0), (2, "A,B", 1, 0)]
    assert kinds(r)["c1"] == kinds(r)["c2"] == ("core", "MAG_1")


def test_a_bin_that_wins_nothing_is_dropped_but_keeps_its_vote(spark):
    big = {f"c{i}": "big" for i in range(1, 16)}
    r = reconciled(spark, {"A": big, "B": big, "C": {"c1": "lone"}})
    (mag,) = r.mags.collect()
    assert kinds(r)["c1"] == ("disputed", mag.mag_id)
    votes = {v.tool: v.mag_id for v in r.votes.where("contig_id = 'c1'").collect()}
    assert votes["C"] and votes["C"] != mag.mag_id


def test_disputed_contigs_are_ranked(spark):
    from binloom.operators.reconcile import disputed_ranked

    r = reconciled(spark, {"A": {"c1": "1", "c2": "1", "c3": "1", "c4": "2", "c5": "2"}, "B": {"c1": "A", "c2": "A", "c3": "B", "c4": "B", "c5": "B"}})
    assert agreed(r)["c3"].total_votes == 2 and agreed(r)["c3"].agreement < 1
    assert [x.contig_id for x in disputed_ranked(r.agreement).collect()] == ["c3"]


def test_unbinned_rows_cast_no_vote(spark):
    r = reconciled(spark, {"A": {"c1": "bin.1", "c2": "bin.1"}, "B": {"c1": "unbinned", "c2": "A"}})
    assert (agreed(r)["c1"].total_votes, agreed(r)["c1"].agreement) == (1, 1.0)


def test_bins_without_a_match_stand_alone(spark):
    r = reconciled(spark, {"A": {"c1": "bin.1", "c2": "bin.1"}, "B": {"c3": "X", "c4": "X"}})
    assert sorted(m.n_members for m in r.mags.collect()) == [1, 1]


def test_two_against_one_is_disputed(spark):
    c = {"c2": "A2"} | {f"z{i}": "X" for i in range(9)} | {"c1": "X"}
    r = reconciled(spark, {"A": {"c1": "bin.1", "c2": "bin.1"}, "B": {"c1": "A", "c2": "A"}, "C": c})
    assert agreed(r)["c1"].total_votes == 3 and agreed(r)["c1"].agreement < 1
    assert agreed(r)["c2"].agreement == 1


@pytest.mark.parametrize("n", [2, 3])
def test_ties_have_no_majority(spark, n):
    r = reconciled(spark, {t: padded(f"bin{t}", "c1", f"pad{t}") for t in "ABC"[:n]})
    a = agreed(r)["c1"]
    assert a.majority_mag is None and a.distinct_groups == n and a.agreement == pytest.approx(1 / n)
    assert len(r.mags.collect()) == n and "c1" not in kinds(r)


def test_two_two_one_has_no_majority(spark):
    p, q = padded("P", "c1", "p"), padded("Q", "c1", "q")
    r = reconciled(spark, {"A": p, "B": p, "C": q, "D": q, "E": padded("R", "c1", "r")})
    assert len(r.mags.collect()) == 3 and agreed(r)["c1"].majority_mag is None


def test_bins_of_one_tool_never_meet_through_a_chain(spark):
    a = {"link1": "bin1", "p1a": "bin1", "p1b": "bin1", "p1c": "bin1", "link3": "bin2", "p2a": "bin2", "p2b": "bin2", "p2c": "bin2"}
    b = {"link1": "X", "link2": "X", "xa": "X", "xb": "X"}
    c = {"link2": "Y", "link3": "Y", "ya": "Y", "yb": "Y"}
    r = reconciled(spark, {"A": a, "B": b, "C": c})
    members = r.members.collect()
    per = {}
    for m in members:
        per.setdefault(m.mag_id, []).append(m.tool)
    assert all(len(t) == len(set(t)) for t in per.values())
    own = {m.bin_id: m.mag_id for m in members if m.tool == "A"}
    assert own["bin1"] != own["bin2"]


def test_threshold_decides_how_loose_a_match_is(spark):
    tools = {"A": {f"c{i}": "1" for i in (1, 2, 3, 4)}, "B": {f"c{i}": "A" for i in (1, 5, 6, 7)}}
    assert len(reconciled(spark, tools, min_jaccard=0.5).mags.collect()) == 2
    assert len(reconciled(spark, tools, min_jaccard=0.05).mags.collect()) == 1
