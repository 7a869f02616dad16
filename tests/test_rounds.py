"""Rounds of joins against the sequential rules they stand for."""

from __future__ import annotations

import random

import pytest

from binloom.operators import assignment, clusters, filters, markers, reconcile, taxonomy
from binloom.streaming import edits


def greedy_by_hand(rows, threshold=0.5):
    out = {}
    for family in {f for f, *_ in rows}:
        reps = []
        for _, header, seq, sig in sorted((r for r in rows if r[0] == family), key=lambda r: (-len(r[2]), r[1])):
            near = next((h for h, s in reps if sum(x == y for x, y in zip(s, sig, strict=True)) >= threshold * len(sig)), None)
            if near is None:
                reps.append((header, sig))
            out[family, header] = near or header
    return out


@pytest.mark.parametrize(("seed", "first"), [(1, 32), (2, 2), (3, 1)])
def test_greedy_clusters_equal_the_sequential_rule(spark, seed, first):
    rng = random.Random(seed)
    rows = []
    for f in ("F1", "F2", "F3"):
        seeds = ["".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randint(30, 60))) for _ in range(4)]
        for i in range(25):
            s = list(rng.choice(seeds))
            for _ in range(rng.choice([0, 1, 3, 6, 12])):
                s[rng.randrange(len(s))] = rng.choice("ACDEFGHIKL")
            rows.append((f, f"{f}.{i:02d}", "".join(s)[: rng.choice([20, 30, 60])]))
    rows += [("F1", "short", "ACD"), ("F1", "none", ""), ("F2", "tiny", "AC"), ("F3", "same", rows[-1][2])]
    df = spark.createDataFrame(rows, "family string, header string, seq string")
    signed = [(r.family, r.header, r.seq, r.sig) for r in clusters.minhash(df).collect()]
    got = {(r.family, r.header): r.representative for r in clusters.greedy_clusters(df, first=first).collect()}
    assert got == greedy_by_hand(signed)


@pytest.mark.parametrize(("hashes", "least"), [(24, 12), (24, 20), (10, 3), (8, 1)])
def test_bands_meet_any_agreement(hashes, least):
    rng = random.Random(4)
    found = clusters.bands(hashes, least)
    for _ in range(2000):
        same = set(rng.sample(range(hashes), least))
        assert any(same >= set(b) for b in found)


def groups_by_hand(nodes, edges):
    group = {n: {n} for n in nodes}
    for _, a, b in sorted((-j, a, b) for a, b, j in edges):
        x, y = group[a], group[b]
        if x is not y and not {n[0] for n in x} & {n[0] for n in y}:
            x |= y
            for n in y:
                group[n] = x
    return {n: min("\x1f".join(m) for m in g) for n, g in group.items()}


@pytest.mark.parametrize("seed", range(3))
def test_constrained_groups_equal_best_edge_first(spark, seed):
    rng = random.Random(seed)
    nodes = [(t, f"b{i}") for t in "ABCDE" for i in range(6)]
    edges = {}
    for _ in range(45):
        a, b = sorted(rng.sample(nodes, 2))
        if a[0] != b[0]:
            edges[a, b] = rng.choice([0.2, 0.4, 0.5, 0.8])
    edges = [(a, b, j) for (a, b), j in edges.items()]
    cast = spark.createDataFrame([(t, "c", b) for t, b in nodes], "tool string, contig_id string, bin_id string")
    df = spark.createDataFrame([(*a, *b, j) for a, b, j in edges], "tool_a string, bin_a string, tool_b string, bin_b string, jaccard double")
    got = {(r.tool, r.bin_id): r.grp for r in reconcile.groups(cast, df).collect()}
    assert got == groups_by_hand(nodes, edges)


def replay_by_hand(base, log):
    state = dict(base)
    for _, contig, source, target in sorted(log):
        if contig is not None:
            state[contig] = target
        else:
            state = {c: target if b == source else b for c, b in state.items()}
    return state


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_edit_after_edit(spark, seed):
    rng = random.Random(seed)
    base = [(f"c{i}", rng.choice("ABCDE")) for i in range(30)]
    log = []
    for seq in rng.sample(range(1000), 120):
        if rng.random() < 0.5:
            log.append((seq, f"c{rng.randrange(36)}", None, rng.choice("ABCDEFG")))
        else:
            log.append((seq, None, rng.choice("ABCDEFG"), rng.choice("ABCDEFG")))
    got = assignment.replay(spark.createDataFrame(base, "contig_id string, bin_id string"), spark.createDataFrame(log, "seq long, contig_id string, source string, target string"))
    assert {r.contig_id: r.bin_id for r in got.collect()} == replay_by_hand(base, log)


def test_replayed_stream_equals_edit_after_edit(spark, tmp_path):
    rng = random.Random(9)
    base = [(f"c{i}", rng.choice("ABC")) for i in range(12)]
    log = [(seq, f"c{rng.randrange(14)}", None, rng.choice("ABCD")) if rng.random() < 0.5 else (seq, None, rng.choice("ABCD"), rng.choice("ABCD")) for seq in range(60)]
    schema = "seq long, contig_id string, source string, target string"
    # The third batch is late: some of its events are of before the second one's.
    batches = [log[:20], log[25:45], log[20:25] + log[45:50], log[50:]]
    start = spark.createDataFrame(base, "contig_id string, bin_id string")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        state = edits.keep_replayed(stream, start, f"{tmp_path}/out", f"{tmp_path}/log")
        done = [r for b in batches[: k + 1] for r in b]
        assert {r.contig_id: r.bin_id for r in state.collect()} == replay_by_hand(base, done)


def test_replay_without_merges_or_base(spark):
    log = spark.createDataFrame([(1, "c", None, "A"), (2, "c", None, "B")], "seq long, contig_id string, source string, target string")
    none = spark.createDataFrame([], "contig_id string, bin_id string")
    assert [tuple(r) for r in assignment.replay(none, log).collect()] == [("c", "B")]
    assert assignment.replay(none, log.limit(0)).count() == 0
    merge = spark.createDataFrame([(5, None, "A", "B")], "seq long, contig_id string, source string, target string")
    base = spark.createDataFrame([("x", "A"), ("y", "C")], "contig_id string, bin_id string")
    assert sorted(map(tuple, assignment.replay(base, merge).collect())) == [("x", "B"), ("y", "C")]


def test_lineage_of_deep_and_cyclic_trees(spark):
    rng = random.Random(5)
    parent = {1: 1} | {i: rng.randint(max(1, i - 3), i - 1) for i in range(2, 60)}
    tree = spark.createDataFrame([(k, v, "no rank") for k, v in parent.items()], "tax_id long, parent long, rank string")
    merged = spark.createDataFrame([(900, 7), (901, 5000)], "old long, new long")
    deleted = spark.createDataFrame([(902,)], "tax_id long")
    ids = spark.createDataFrame([(i,) for i in (1, 7, 33, 59, 900, 901, 902, 903, 7)], "tax_id long")
    want = set()
    for i, at in ((1, 1), (7, 7), (33, 33), (59, 59), (900, 7)):
        depth = 0
        want.add((i, 0, at))
        while parent[at] != at:
            depth, at = depth + 1, parent[at]
            want.add((i, depth, at))
    rows = [tuple(r) for r in taxonomy.lineage(ids, tree, merged).collect()]
    assert len(rows) == len(want) and set(rows) == want
    resolved = taxonomy.resolved_ids(ids, tree, merged, deleted)
    assert {r.tax_id: (r.current, r.status) for r in resolved.collect()} == {1: (1, "current"), 7: (7, "current"), 33: (33, "current"), 59: (59, "current"), 900: (7, "merged"), 901: (None, "unknown"), 902: (None, "deleted"), 903: (None, "unknown")}
    assert {r.status: r.n for r in taxonomy.id_counts(resolved).collect()} == {"current": 4, "merged": 1, "deleted": 1, "unknown": 2}
    cyclic = tree.unionByName(spark.createDataFrame([(70, 71, "x"), (71, 70, "x")], tree.schema))
    with pytest.raises(ValueError, match="their own ancestors"):
        taxonomy.lineage(ids, cyclic)


def test_merged_and_deleted_files(spark, tmp_path):
    (tmp_path / "merged.dmp").write_text("12\t|\t74109\t|\n30\t|\t29\t|\n")
    (tmp_path / "delnodes.dmp").write_text("3\t|\n4\t|\n")
    assert sorted(map(tuple, taxonomy.merged_ids(spark, str(tmp_path / "merged.dmp")).collect())) == [(12, 74109), (30, 29)]
    assert sorted(r.tax_id for r in taxonomy.deleted_ids(spark, str(tmp_path / "delnodes.dmp")).collect()) == [3, 4]


def test_ranks_of_a_key_in_many_tasks(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(50)) for i in range(900)] + [(f"k{i % 40}", i, rng.randrange(9)) for i in range(300)] + [(None, 1, 2), (None, 2, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for least, most in ((1, 20), (3, 7), (1, 1000)):
            got = sorted((r.k or "", r.v, r.i) for r in markers.thinned(df, "k", ("v", "i"), least, most).collect())
            want = []
            for key in {k for k, *_ in rows}:
                own = sorted((v, i) for k, i, v in rows if k == key)
                if len(own) >= least:
                    want += [(key or "", *own[j]) for j in (range(len(own)) if len(own) <= most else [int(j * (len(own) / most)) for j in range(most)])]
            assert got == sorted(want)
        values = {r.k: r.v for r in markers.percentile_floor(df, "k", "v", 0.1).collect()}
        assert values["hot"] == sorted(v for k, _, v in rows if k == "hot")[90] and len(values) == 42
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sorting_a_column_plans_no_job(spark):
    rows = spark.createDataFrame([("10",), ("9%",), ("1,000",), ("n/a",), ("",), (None,), ("x",)], "c string")
    assert [r.c for r in filters.sort_column(rows, "c").collect()][:3] == ["9%", "10", "1,000"]
    assert [r.c for r in filters.sort_column(rows, "c", True).collect()][:3] == ["1,000", "10", "9%"]
    words = spark.createDataFrame([("b",), ("A",), ("2",), ("-",), ("c",)], "c string")
    assert [r.c for r in filters.sort_column(words, "c").collect()] == ["2", "A", "b", "c", "-"]
    assert filters.sort_column(rows.limit(0), "c").count() == 0
