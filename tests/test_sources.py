"""Reads by place: offsets without shuffled sequences, spans by seeking, block-compressed files, split tables."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from binloom.sources import fasta, indexed, tables


def written(rng, n, width=20, odd=True):
    """FASTA bytes of n records."""
    out = [b"before\n"] if odd else []
    for i in range(n):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 19, 20, 21, 200, 1500])))
        lines = [seq[k : k + width] for k in range(0, len(seq), width)]
        if odd and i % 7 == 3 and len(lines) > 2:
            lines[0] += "A"
        end = "\r\n" if odd and i % 5 == 0 else "\n"
        out.append((f">c{i} of {n}{end}" + "".join(x + end for x in lines) + ("\n" if odd and i % 4 == 1 else "")).encode())
    return b"".join(out)


def blocked(data, rng, most=300):
    """The data as members that tell their size, and an empty one at the end."""
    out, at = [], 0
    while at < len(data) or not out or out[-1] is not None:
        part = data[at : at + rng.randint(1, most)]
        at += len(part)
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(part) + z.flush()
        size = len(packed) + 26
        out.append(indexed.MEMBER + b"\0" * 4 + b"\0\xff" + b"\x06\0" + indexed.FIELD + (size - 1).to_bytes(2, "little") + packed + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little"))
        if not part:
            break
    return b"".join(out)


def rows_of(df):
    return sorted((r.id, r.header, r.seq, tuple(r.fai)) for r in df.collect())


def test_no_sequence_is_shuffled(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(written(random.Random(1), 30))
    df = fasta.read_fasta(spark, str(tmp_path / "a.fasta"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "MapInArrow" in physical
    for line in physical.splitlines():
        if "Exchange hashpartitioning" in line or "Sort [" in line:
            assert "value" not in line and "seq" not in line
    # What is exchanged is what lies below an exchange: sizes of splits.
    below = df.select("file", "id").distinct().count()
    assert below == len({r.id for r in df.collect()})


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("split", [40, 700, 1 << 20])
def test_blocked_files_equal_plain_ones(spark, tmp_path, seed, split):
    rng = random.Random(seed)
    files = []
    for k in range(2):
        data = written(rng, 25) if k else written(rng, 9, odd=False)
        (tmp_path / f"{k}.fasta").write_bytes(data)
        (tmp_path / f"{k}.packed").write_bytes(blocked(data, rng))
        files.append((f"file://{tmp_path}/{k}.packed", (tmp_path / f"{k}.packed").stat().st_size))
    got = indexed.read_blocked(spark, files, split_bytes=split)
    assert rows_of(got) == rows_of(fasta.read_fasta(spark, [f"{tmp_path}/0.fasta", f"{tmp_path}/1.fasta"]))
    if split == 40:
        assert got.rdd.getNumPartitions() > 10


def test_blocked_files_of_any_name(spark, tmp_path):
    rng = random.Random(5)
    data = written(rng, 12)
    (tmp_path / "x.gz").write_bytes(blocked(data, rng))
    (tmp_path / "y").write_bytes(blocked(data, rng))
    (tmp_path / "plain").write_bytes(data)
    assert {k for _, k, _ in fasta.listed(spark, f"{tmp_path}/[xy]*")} == {"blocked"}
    want = rows_of(fasta.read_fasta(spark, f"{tmp_path}/plain"))
    assert rows_of(fasta.read_any_fasta(spark, f"{tmp_path}/x.gz")) == want
    assert rows_of(fasta.read_any_fasta(spark, f"{tmp_path}/*")) == sorted(want * 3)


def test_empty_blocked_file(spark, tmp_path):
    (tmp_path / "nil").write_bytes(blocked(b"", random.Random(1)))
    assert fasta.read_any_fasta(spark, f"{tmp_path}/nil").count() == 0


def test_spans_are_read_by_seeking(spark, tmp_path):
    """Two records in a file of ten gigabytes of holes: reading what lies between them would not end in time."""
    at = [10_000_000_000, 4_000_000_007]
    with open(tmp_path / "huge.fasta", "wb") as f:
        for i, a in enumerate(at):
            f.seek(a)
            f.write(b"ACGTA\nCGT" + bytes([65 + i]) + b"\n")
    file = f"file://{tmp_path}/huge.fasta"
    rows = [(file, f"c{i}", f"c{i} head", a, 10, i) for i, a in enumerate(at)] + [(file, "odd", "odd", 5, None, 9)]
    index = spark.createDataFrame(rows, "file string, id string, header string, offset long, bytes long, ord long")
    index.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/index")
    got = {r.id: r for r in indexed.sequences(spark, f"{tmp_path}/index", ["c1", "odd", "none"]).collect()}
    assert {i: (r.header, r.seq, r.bytes) for i, r in got.items()} == {"c1": ("c1 head", "ACGTACGTB", 10), "odd": ("odd", None, 0)}
    assert sorted(r.seq or "" for r in indexed.sequences(spark, f"{tmp_path}/index").collect()) == ["", "ACGTACGTA", "ACGTACGTB"]
    groups = spark.createDataFrame([("g", "c1", 0), ("g", "c0", 1), ("h", "c1", 0), ("h", "odd", 1), ("h", "gone", 2)], "grp string, id string, pos int")
    texts, skipped = indexed.extracted(groups, spark.read.parquet(f"{tmp_path}/index"))
    assert sorted((r.grp, r.pos, r.value) for r in texts.collect()) == [("g", 0, ">c1 head\nACGTA\nCGTB\n"), ("g", 1, ">c0 head\nACGTA\nCGTA\n"), ("h", 0, ">c1 head\nACGTA\nCGTB\n")]
    assert sorted((r.grp, r.id) for r in skipped.collect()) == [("h", "gone"), ("h", "odd")]


def test_index_groups_without_wanted_ids_are_left_out(spark, tmp_path):
    data = written(random.Random(3), 200, odd=False)
    (tmp_path / "a.fasta").write_bytes(data)
    indexed.write_index(fasta.read_fasta(spark, f"{tmp_path}/a.fasta"), f"{tmp_path}/index", group_rows=20)
    all_, one = indexed.SpanReader(f"{tmp_path}/index", None).partitions(), indexed.SpanReader(f"{tmp_path}/index", ["c7"]).partitions()
    assert len(one) == 1 < len(all_)
    want = {r.id: r.seq for r in fasta.read_fasta(spark, f"{tmp_path}/a.fasta").collect()}
    got = {r.id: r.seq for r in indexed.sequences(spark, f"{tmp_path}/index").collect()}
    assert got == {i: s or None for i, s in want.items()}
    read = indexed.sequences(spark, f"{tmp_path}/index", ["c7", "c9"]).agg(F.sum("bytes")).first()[0]
    assert read < len(data) / 20


# Tables


@pytest.mark.parametrize("split", [7, None])
def test_split_tables_equal_whole_ones(spark, tmp_path, split):
    rng = random.Random(7)
    texts = {
        "one.tsv": "contig\tbin\r\n" + "".join(f"c{i}\tb{rng.randint(0, 3)}\r\n" + "\n \t\n" * (i % 5 == 0) for i in range(22)) + "short\nx\t\n\ty\nlast\tb9",
        "two.csv": "".join(f"k{i},b,extra,{i}\n" for i in range(5)),
        "cov.txt": "contigName,contigLen,totalAvgDepth,s1.bam,s1.bam-var,s2.bam\n" + "".join(f"c{i},9,7,{i / 2},1,0x1F\n" for i in range(4)) + "c99,1,2\n",
        "plain.cov": "".join(f"c{i}\t{i}e1\t\t\n" for i in range(22)),
        "prose": "some words\nand more\n",
        "nil": "\n\n",
    }
    for k, v in texts.items():
        (tmp_path / k).write_text(v, newline="")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = tables.read_lines(spark, str(tmp_path))
        told = tables.heads(lines)
        formats = {r.label: r.format for r in told.collect()}
        got_bins = sorted(map(tuple, tables.bins_of(lines, told.where("format = 'contig-bin'")).collect()))
        got_cov = sorted(((r.label, r.row_idx, r.contig_id, r.sample, r.sample_idx, str(r.depth)) for r in tables.coverage_of(lines, told.where("format = 'coverage'")).collect()))
        if split == 7:
            assert lines.rdd.getNumPartitions() > 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = tables.read_texts(spark, str(tmp_path)).withColumn("format", tables.sniff(F.col("text")))
    assert formats == {r.label: r.format for r in whole.where("label <> 'nil'").collect()}
    assert {k: v for k, v in formats.items() if v != "unknown"} == {"one": "contig-bin", "cov": "coverage", "plain": "coverage"}
    assert got_bins == sorted(map(tuple, tables.parse_bins(whole.where("format = 'contig-bin'"), "label").collect())) != []
    want = tables.parse_coverage(whole.where("format = 'coverage'"), "label").collect()
    assert got_cov == sorted((r.label, r.row_idx, r.contig_id, r.sample, r.sample_idx, str(r.depth)) for r in want) != []


def test_labels_of_files_that_share_a_name(spark, tmp_path):
    for k in ("a", "b"):
        (tmp_path / k).mkdir()
        (tmp_path / k / "bins.tsv").write_text(f"c\t{k}\n")
    lines = tables.read_lines(spark, f"{tmp_path}/*/bins.tsv")
    rows = tables.bins_of(lines, tables.heads(lines)).collect()
    assert sorted((r.label, r.bin_id) for r in rows) == [("bins", "a"), ("bins (2)", "b")]
