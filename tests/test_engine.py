"""Kernels, sources and relational operators on small inputs."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from binloom.functions import kernels, sequence, text, udfs
from binloom.operators import assignment, bins, clusters, evidence, filters, idmatch, markers, network, taxonomy
from binloom.sources import export, fasta, tables
from binloom.streaming import edits as stream


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr).first()[0]


def dna(rng, n, letters="ACGTacgtN"):
    return "".join(rng.choice(letters) for _ in range(n))


# Sequences


def test_translation_goldens():
    assert kernels.frames("ATGGCATTT")[:2] == ["MAF", "WH"]
    assert kernels.frames("ATGTAAGGG")[0] == "M*G"
    assert kernels.frames("ATGNNNGGG")[0] == "MXG"
    assert kernels.frames("") == [""] * 6


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 31, 100])
def test_kernels_equal_column_functions(spark, n):
    s = dna(random.Random(n), n)
    row = spark.createDataFrame([(s,)], "s string")
    c = F.col("s")
    got = row.select(
        sequence.six_frames(c).alias("f"), sequence.gc_content(c).alias("gc"), sequence.gc_skew(c).alias("skew"), sequence.ambiguous_bases(c).alias("n"), udfs.contig_stats(c).alias("k"), sequence.coding_density(sequence.six_frames(c), 2).alias("d")
    ).first()
    assert got.f == kernels.frames(s)
    assert (got.k.length, got.k.gc_content, got.k.gc_skew, got.k.ambiguous) == (n, pytest.approx(got.gc), pytest.approx(got.skew), got.n)
    assert got.d == pytest.approx(kernels.density(kernels.frames(s), 2))
    assert sum(got.k.composition) == pytest.approx(1) or not any(got.k.composition)


def test_reverse_complement_knows_iupac(spark):
    assert one(spark, sequence.reverse_complement(F.lit("ACGTUryN-x"))) == "NNNryAACGT"


def test_canonical_kmers():
    names = sequence.canonical_kmers()
    assert len(names) == 136 and names == sorted(names)


def test_orf_golden():
    seq = "TAA" + "GGC" * 150 + "TAA"
    assert ("+", 0, 3, 453) in kernels.orfs(seq, 100)
    turn = str.maketrans("ACGT", "TGCA")
    for strand, _, a, z in kernels.orfs(dna(random.Random(1), 900, "ACGT"), 15):
        part = dna(random.Random(1), 900, "ACGT")[a:z]
        assert "*" not in kernels.frames(part if strand == "+" else part.translate(turn)[::-1])[0]


def test_reduced_kmers_skip_stops_and_thin_out():
    assert [p for _, p in kernels.reduced_kmers("MKLVXAAAA", 3)] == [0, 1, 5, 6]
    assert [p for _, p in kernels.reduced_kmers("A" * 100, 5, cap=10, stride=4)] == list(range(0, 96, 10))
    assert kernels.reduced_kmers("LVIMC", 5) == [(1, 0)]


def ungapped_by_hand(q, r, at, ref_at, drop):
    s = kernels.scores()

    def side(pairs, first):
        total = best = first
        length = 0
        for k, (a, b) in enumerate(pairs, 1):
            total += int(s[ord(a), ord(b)])
            if total > best:
                best, length = total, k
            elif best - total > drop:
                break
        return best, length

    right, n = side(zip(q[at + 1 :], r[ref_at + 1 :], strict=False), int(s[ord(q[at]), ord(r[ref_at])]))
    left, m = side(zip(q[:at][::-1], r[:ref_at][::-1], strict=False), 0)
    return right + left, at - m, at + n, n + m + 1


@pytest.mark.parametrize("seed", range(40))
def test_ungapped_extension(seed):
    rng = random.Random(seed)
    q = "".join(rng.choice("ARNDCQEGHILKMFPSTWYVX*") for _ in range(60))
    r = "".join(c if rng.random() < 0.7 else rng.choice("ARNDCX") for c in q[5:50])
    at = rng.randrange(5, 50)
    assert kernels.extend_ungapped(q, r, at, at - 5) == ungapped_by_hand(q, r, at, at - 5, 15)


def gapped_by_hand(q, r, at, ref_at, drop, gap, band):
    """Cell by cell, as a table over both sequences."""
    s = kernels.scores()

    def side(q, r):
        prev, best, taken = {0: 0}, 0, 0
        for i in range(1, len(q) + 1):
            row = {}
            for b in range(-band, band + 1):
                j = i + b
                if 0 <= j <= len(r):
                    options = []
                    if j >= 1 and b in prev:
                        options.append(prev[b] + int(s[ord(q[i - 1]), ord(r[j - 1])]))
                    if b + 1 in prev:
                        options.append(prev[b + 1] - gap)
                    if j >= 1 and b - 1 in row:
                        options.append(row[b - 1] - gap)
                    if options:
                        row[b] = max(options)
                        if row[b] > best:
                            best, taken = row[b], j
            if max(row.values(), default=-(10**9)) < best - drop:
                break
            prev = row
        return best, taken

    right, n = side(q[at + 1 :], r[ref_at + 1 :])
    left, m = side(q[:at][::-1], r[:ref_at][::-1])
    return int(s[ord(q[at]), ord(r[ref_at])]) + right + left, m + 1 + n


@pytest.mark.parametrize("seed", range(6))
def test_extensions_of_many_pairs_at_once(seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(40):
        q = "".join(rng.choice("ARNDCQEGHILKMFPSTWYVX*") for _ in range(rng.choice([1, 3, 20, 70, 200])))
        r = "".join(c if rng.random() < 0.8 else rng.choice(["", "A", "RN", "X"]) for c in q) or "A"
        at = rng.randrange(len(q))
        pairs.append((q, r, at, min(at, len(r) - 1)))
    columns = [list(c) for c in zip(*pairs, strict=True)]
    for drop in (0, 15, 40):
        got = list(zip(*kernels.extend_ungapped_all(*columns, drop), strict=True))
        assert [tuple(map(int, g)) for g in got] == [ungapped_by_hand(*p, drop) for p in pairs]
        for gap, band in ((8, 16), (3, 2)):
            got = list(zip(*kernels.extend_gapped_all(*columns, drop, gap, band), strict=True))
            assert [tuple(map(int, g)) for g in got] == [gapped_by_hand(*p, drop, gap, band) for p in pairs]


def test_gapped_extension_crosses_a_gap():
    core = "MSLKCGIVGLPNVGKSTLFNALTKAGIAAENYPFCTIEPNVGIVEV"
    cut = core[:20] + core[22:]
    plain, gapped = kernels.extend_ungapped(core, cut, 5, 5), kernels.extend_gapped(core, cut, 5, 5)
    assert gapped[0] > plain[0] and gapped[1] == len(cut)
    assert kernels.extend_gapped(core, core, 10, 10)[0] == kernels.extend_ungapped(core, core, 10, 10)[0]


def test_scores():
    s = kernels.scores()
    assert (s[ord("W"), ord("W")], s[ord("X"), ord("*")], s[ord("*"), ord("A")], s[ord("A"), ord("R")]) == (11, -1, -100, -1)
    assert (s == s.T).all()


# Text


def test_numbers(spark):
    cells = ["", "  ", "12", " 1e3 ", "0x10", "Infinity", "-Infinity", ".5", "abc", "1,000"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(text.to_number(F.col("c"))).collect()]
    assert got[:8] == [0, 0, 12, 1000, 16, float("inf"), float("-inf"), 0.5] and all(x != x for x in got[8:])


def test_fixed_decimals_and_csv(spark):
    assert one(spark, text.to_fixed(F.lit(1.005), F.lit(2))) == "1.00"
    assert one(spark, text.to_fixed(F.lit(2.5), F.lit(0))) == "3"
    assert one(spark, text.csv_field(F.lit('a "b", c'))) == '"a ""b"", c"'
    assert one(spark, text.file_label(F.lit("/x/y/tool.bins.tsv"))) == "tool.bins"
    assert one(spark, text.file_label(F.lit(".hidden"))) == ".hidden"


@pytest.mark.parametrize(("args", "want"), [((60, 60, 61), 61), ((150, 60, 61), 153), ((120, 60, 61), 122), ((70, 60, 62), 74)])
def test_byte_spans(spark, args, want):
    n, b, w = map(F.lit, args)
    assert one(spark, sequence.byte_span(n, b, w, F.lit(True))) == want
    assert one(spark, sequence.byte_span(n, b, w, F.lit(False))) is None


def test_wrapping(spark):
    assert one(spark, sequence.wrapped(F.lit("ABCDEF"), 3)) == "ABC\nDEF"
    assert one(spark, sequence.wrapped(F.lit("ABCDE"), 3)) == "ABC\nDE"


# FASTA

SAMPLE = b"junk\n>contig1 first one\nACGTACGTAC\nGTACGTACGT\nACGT\n>contig2\r\nACGTNNNN\r\nACGTacgt\r\n\r\n>odd\nACGT\nAC\nACGTACGT\n>empty\n>last\nACGTACGT"


@pytest.mark.parametrize("split", [None, 7])
def test_fasta_offsets_hold_in_any_split(spark, tmp_path, split):
    (tmp_path / "a.fasta").write_bytes(SAMPLE)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = {r.id: r for r in fasta.read_fasta(spark, str(tmp_path / "a.fasta")).withColumn("span", fasta.span("fai")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(rows) == {"contig1", "contig2", "odd", "empty", "last"}
    assert rows["contig1"].header == "contig1 first one"
    assert {k: len(r.seq) for k, r in rows.items()} == {"contig1": 24, "contig2": 16, "odd": 14, "empty": 0, "last": 8}
    f = rows["contig1"].fai
    assert (f.offset, f.line_bases, f.line_width, f.uniform) == (SAMPLE.index(b"ACGT"), 10, 11, True)
    assert (rows["contig2"].fai.line_width, rows["odd"].fai.uniform, rows["odd"].fai.line_bases) == (10, False, None)
    for k in ("contig1", "contig2", "last"):
        r = rows[k]
        assert SAMPLE[r.fai.offset : r.fai.offset + r.span].replace(b"\r", b"").replace(b"\n", b"").decode() == r.seq


def test_fasta_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "b.fasta.gz", "wb") as f:
        f.write(SAMPLE)
    assert fasta.contig_ids(fasta.read_fasta(spark, str(tmp_path / "b.fasta.gz"))).count() == 5


def test_bin_fasta_sink_and_plan(spark, tmp_path):
    (tmp_path / "a.fasta").write_bytes(SAMPLE)
    records = fasta.read_fasta(spark, str(tmp_path / "a.fasta"))
    groups = spark.createDataFrame([("g", "contig1", 0), ("g", "odd", 1), ("g", "none", 2)], "grp string, id string, pos int")
    plan = {r.id: (r.bytes, r.skipped) for r in fasta.extraction_plan(groups, records).collect()}
    assert plan == {"contig1": (27, False), "odd": (None, True), "none": (None, True)}
    skipped = fasta.write_bins(spark.createDataFrame([("b1", "contig1"), ("b2", "contig2")], "bin_id string, id string").unionByName(spark.createDataFrame([("b1", "odd"), ("b1", "none")], "bin_id string, id string")), records, str(tmp_path / "bins"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "bins/bin_id=b1")).collect()) == ">contig1 first one\nACGTACGTAC\nGTACGTACGT\nACGT"
    assert sorted(r.id for r in skipped.collect()) == ["none", "odd"]
    crlf = spark.read.option("lineSep", "\n").text(str(tmp_path / "bins/bin_id=b2")).collect()
    assert [r.value for r in crlf] == [">contig2", "ACGTNNNN\r", "ACGTacgt\r"]
    one = [tuple(r) for k in ("contig1", "odd", "gone") for r in fasta.contig_sequence(records, k).collect()]
    assert one == [("contig1", "contig1 first one", "ACGTACGTACGTACGTACGTACGT"), ("odd", "odd", None)]


def test_fasta_of_any_name(spark, tmp_path):
    with gzip.open(tmp_path / "packed", "wb") as f:
        f.write(SAMPLE)
    (tmp_path / "plain.txt").write_bytes(b">x one\n  ACGT \n AC\n")
    (tmp_path / "note.txt").write_bytes(b"no sequences")
    (tmp_path / "nil").write_bytes(b"")
    kinds = {f.rsplit("/", 1)[-1]: k for f, k in fasta.peeked(spark, str(tmp_path))}
    assert kinds == {"packed": "gzip", "plain.txt": "fasta", "note.txt": "other", "nil": "other"}
    assert fasta.looks_like_fasta(spark, str(tmp_path / "packed")) and not fasta.looks_like_fasta(spark, str(tmp_path / "n*"))
    rows = {r.id: r for r in fasta.read_any_fasta(spark, str(tmp_path / "p*"), trim=True).collect()}
    assert rows["x"].seq == "ACGTAC" and rows["contig1"].seq == "ACGT" * 6 and rows["contig1"].fai.offset == SAMPLE.index(b"ACGT")
    assert set(rows) == {"contig1", "contig2", "odd", "empty", "last", "x"}
    assert {r.id: r.seq for r in fasta.read_any_fasta(spark, str(tmp_path / "plain.txt")).collect()} == {"x": "  ACGT  AC"}


# Tables


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "k int, text string")


def test_bin_tables(spark):
    rows = tables.parse_bins(texts(spark, "c1\tb1\r\nc2\tb2\r\n", "Contig,Bin\nc1,b1\nshort\nc2,\n,b\nc3,b3,extra\n"), "k").orderBy("k", "row_idx").collect()
    assert [(r.k, r.contig_id, r.bin_id) for r in rows] == [(0, "c1", "b1"), (0, "c2", "b2"), (1, "c1", "b1"), (1, "c3", "b3")]


def test_coverage_tables(spark):
    metabat = "contigName\tcontigLen\ttotalAvgDepth\ta.bam\ta.bam-var\tb.bam\nc1\t100\t3\t1\t9\t2\n"
    rows = tables.parse_coverage(texts(spark, "c1\t1.5\t2\nc2\t\tx\n", metabat), "k").orderBy("k", "contig_id", "sample_idx").collect()
    assert [(r.k, r.contig_id, r.sample) for r in rows] == [(0, "c1", "sample1"), (0, "c1", "sample2"), (0, "c2", "sample1"), (0, "c2", "sample2"), (1, "c1", "a.bam"), (1, "c1", "b.bam")]
    assert rows[2].depth == 0 and rows[3].depth != rows[3].depth


def test_sniffing(spark):
    got = texts(spark, "c1\tb1\nc2\tb2", "contig,s1,s2\nc1,1,2", "some prose\nwith lines", "c1\t1\nc2\t2", "").select("k", tables.sniff(F.col("text")).alias("f")).orderBy("k").collect()
    assert [r.f for r in got] == ["contig-bin", "coverage", "unknown", "contig-bin", "unknown"]


def test_csv_golden(spark):
    row = spark.createDataFrame([("b,1", 2, 10000, 8000, 1, 0.55, 33.783783, 0.0, "low", None)], "bin_id string, contig_count long, total_length long, n50 long, l50 long, mean_gc double, completeness double, redundancy double, tier string, agreement double")
    assert export.summary_lines(row).first().line == '"b,1",2,10000,8000,55.00,33.78,0.00,,low'


# Ids, bins, assignment


def test_id_repair(spark):
    contigs = spark.createDataFrame([(f"c{i}",) for i in range(10)], "contig_id string")
    cut = [("cut", i, f"c{i // 2}.concoct_part_{i % 2}", f"b{i % 3}") for i in range(20)]
    swap = [("swap", i, f"bin{i % 2}", f"c{i}") for i in range(10)]
    good = [("good", i, f"c{i}", "b") for i in range(10)] + [("good", 10, "c0", "b2")]
    none = [("none", i, f"x{i}", "b") for i in range(4)]
    rows = spark.createDataFrame(cut + swap + good + none, "tool string, row_idx long, contig_id string, bin_id string")
    fixed, report = idmatch.repaired(rows, contigs)
    got = {r.tool: (r.strategy, r.applied, r.collapsed) for r in report.collect()}
    assert got == {"cut": ("suffix", True, 10), "swap": ("swap", True, 0), "good": ("exact", False, 0), "none": ("none", False, 0)}
    assert fixed.where("tool = 'good'").count() == 11  # a table that fits keeps its repeats
    assert {r.contig_id: r.bin_id for r in fixed.where("tool = 'cut'").collect()}["c0"] == "b0"  # the first seen wins a tie


def test_bin_summary_join(spark):
    contigs = spark.createDataFrame([("c1", 2000, 0.5), ("c2", 8000, 0.6), ("c3", 100, 0.3)], "contig_id string, length long, gc_content double")
    rows = spark.createDataFrame([("c1", "bin.1"), ("c2", "bin.1"), ("c3", "bin.2"), ("zz", "bin.2")], "contig_id string, bin_id string")
    hits = spark.createDataFrame([("c1", "F1"), ("c2", "F1"), ("c2", "F2")], "contig_id string, family string")
    got = {r.bin_id: r for r in bins.bin_summary(rows, contigs, hits).collect()}
    b = got["bin.1"]
    assert (b.contig_count, b.total_length, b.n50, b.l50, b.mean_gc, b.families_found) == (2, 10000, 8000, 1, pytest.approx(0.55), 2)
    assert b.completeness == pytest.approx(2 / 29.6 * 100) and b.redundancy == pytest.approx(1 / 29.6 * 100) and b.tier == "low"
    assert [r.contig_id for r in bins.unmatched(rows, contigs).collect()] == ["zz"]
    with pytest.raises(ValueError):
        bins.completeness(rows, hits, recall=0)


@pytest.mark.parametrize("seed", range(6))
def test_n50_with_equal_lengths(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 3, 5, 100]) for _ in range(rng.randrange(1, 30))]
    total, upto = sum(lengths), 0
    for k, n in enumerate(sorted(lengths, reverse=True), 1):
        upto += n
        if 2 * upto >= total:
            break
    got = bins.n50_l50(spark.createDataFrame([("b", n) for n in lengths], "bin_id string, length long"), "bin_id").first()
    assert (got.n50, got.l50) == (n, k)


def test_tiers(spark):
    cases = [((90.1, 4.9), "high"), ((90.0, 4.9), "medium"), ((95.0, 5.0), "medium"), ((50.0, 9.9), "medium"), ((50.0, 10.0), "low"), ((49.9, 0.0), "low")]
    assert [one(spark, bins.tier(F.lit(a), F.lit(b))) for (a, b), _ in cases] == [t for _, t in cases]


def test_edits_and_bins(spark):
    base = spark.createDataFrame([("c1", "A"), ("c2", "A"), ("c3", "B")], "contig_id string, bin_id string")
    log = spark.createDataFrame([(1, "c1", "B"), (2, "c1", "C"), (3, "c9", "B")], "seq long, contig_id string, bin_id string")
    state = assignment.fold(base, log)
    assert {r.contig_id: r.bin_id for r in state.collect()} == {"c1": "C", "c2": "A", "c3": "B", "c9": "B"}
    assert {r.bin_id for r in assignment.merge(state, "B", "A").collect()} == {"A", "C"}
    assert [r.bin_id for r in assignment.list_bins(state).collect()] == ["A", "B", "C"]
    named = spark.createDataFrame([("x", "new"), ("y", "new.2"), ("z", "new.4")], "contig_id string, bin_id string")
    assert (assignment.new_bin_id(named, "new"), assignment.new_bin_id(named, "other")) == ("new.3", "other")


def test_edit_stream(spark, tmp_path):
    rows = [(i, f"c{i % 4}", f"b{i}") for i in range(20)]
    spark.createDataFrame(rows, "seq long, contig_id string, bin_id string").repartition(3).write.parquet(str(tmp_path / "log"))
    source = spark.readStream.schema("seq long, contig_id string, bin_id string").parquet(str(tmp_path / "log"))
    stream.keep_state(source, str(tmp_path / "out"), str(tmp_path / "ck"))
    state = stream.current_state(spark.read.parquet(str(tmp_path / "out")).select("contig_id", "bin_id", "seq"))
    assert {r.contig_id: r.bin_id for r in state.collect()} == {"c0": "b16", "c1": "b17", "c2": "b18", "c3": "b19"}


def test_filters(spark):
    contigs = spark.createDataFrame([("c1", 1000, 0.4, 0.8), ("c2", 5000, 0.6, 0.5), ("c3", 200, 0.5, 0.9), ("c4", 300, float("nan"), 0.1)], "contig_id string, length long, gc_content double, coding_density double")
    rows = spark.createDataFrame([("t", 0, "c1", "b1"), ("t", 1, "c1", "b2"), ("u", 0, "c2", "b1")], "tool string, row_idx long, contig_id string, bin_id string")
    names = lambda **k: {r.contig_id for r in filters.filter_contigs(contigs, rows, None, filters.ContigFilter(**k)).collect()}
    assert names(length=(1000, None)) == {"c1", "c2"}
    assert names(gc_percent=(45, 55)) == {"c3", "c4"}  # NaN passes both bounds
    assert names(bin=("t", "b2")) == {"c1"} and names(bin=("t", "b1")) == set()  # the last row counts
    assert names(unbinned=True) == {"c3", "c4"}
    assert names(search=" B1 ") == {"c2"}
    assert names(max_agreement_percent=50) == set()
    with pytest.raises(ValueError):
        filters.active_tools(rows, [])


def test_numeric_sort_puts_blanks_last(spark):
    rows = spark.createDataFrame([("1,000",), ("20%",), ("",), ("3",), ("n/a",)], "v string")
    assert [r.v for r in filters.sort_column(rows, "v").collect()][:3] == ["3", "20%", "1,000"]
    assert [r.v for r in filters.sort_column(rows, "v", True).collect()][:3] == ["1,000", "20%", "3"]


def test_evidence_z(spark):
    vec = {"a": [0.1, 0.9], "b": [0.2, 0.8], "c": [0.6, 0.4], "d": [0.9, 0.1]}
    contigs = spark.createDataFrame([(k, v) for k, v in vec.items()], "contig_id string, composition array<double>")
    stands = spark.createDataFrame([("M", x, "core") for x in "abc"], "mag_id string, contig_id string, kind string")
    pairs = spark.createDataFrame([("d", "M"), ("d", "N")], "contig_id string, mag_id string")
    got = {r.mag_id: r.z for r in evidence.composition_z(pairs, stands, contigs).collect()}
    centre = [0.3, 0.7]
    dist = lambda v: sum((x - y) ** 2 for x, y in zip(v, centre, strict=True)) ** 0.5
    own = [dist(vec[x]) for x in "abc"]
    mean = sum(own) / 3
    sd = (sum((x - mean) ** 2 for x in own) / 3) ** 0.5
    assert got["M"] == pytest.approx((dist(vec["d"]) - mean) / sd) and got["N"] is None


# Markers


def protein(rng, n=200):
    return "".join(rng.choice(kernels.RESIDUES) for _ in range(n))


def encoded(rng, amino):
    back = {}
    for codon, a in sequence.codons().items():
        back.setdefault(a, []).append(codon)
    return "".join(rng.choice(back[a]) for a in amino)


def test_marker_search_finds_embedded_genes(spark):
    rng = random.Random(9)
    base = {f: protein(rng) for f in ("F1", "F2")}
    near = lambda p: "".join(c if rng.random() < 0.9 else rng.choice(kernels.RESIDUES) for c in p)
    records = spark.createDataFrame([(f"{f}.fa.{10 * i + j}.x", near(p)) for i, (f, p) in enumerate(base.items()) for j in range(4)], "header string, seq string")
    refs = markers.ref_seqs(records)
    turn = str.maketrans("ACGT", "TGCA")
    contigs = [("forward", dna(rng, 100, "ACGT") + encoded(rng, near(base["F1"])) + dna(rng, 100, "ACGT")), ("backward", (dna(rng, 50, "ACGT") + encoded(rng, near(base["F2"]))).translate(turn)[::-1]), ("none", dna(rng, 900, "ACGT"))]
    df = spark.createDataFrame(contigs, "contig_id string, seq string")
    for s in (markers.Search(k=5, stride=1, overrides={}), markers.Search(k=5, stride=1, gapped=True, overrides={})):
        got = {(r.contig_id, r.family) for r in markers.search(df, refs, markers.seed_index(refs, 5, 1, 100), s).collect()}
        assert got == {("forward", "F1"), ("backward", "F2")}


def test_header_fields(spark):
    h = F.lit("COG0012.fa.1000565.METUNv1_03812")
    assert (one(spark, sequence.header_family(h)), one(spark, sequence.header_taxon(h))) == ("COG0012", 1000565)


def test_thinning_is_even(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(2)], "k string, v long")
    got = markers.thinned(rows, "k", ("v",), 3, 20).orderBy("v").collect()
    assert [r.v for r in got] == [int(j * (50 / 20)) for j in range(20)]


def test_clusters_and_hash(spark):
    def fnv(s, seed=0):
        h = (2166136261 ^ seed) & 0xFFFFFFFF
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    assert one(spark, sequence.fnv1a(F.lit("MSLKC"), 7)) == fnv("MSLKC", 7)
    rng = random.Random(3)
    a, b = protein(rng), protein(rng)
    rows = spark.createDataFrame([("F", "a", a), ("F", "a2", a[:-3]), ("F", "b", b)], "family string, header string, seq string")
    got = {r.header: r.representative for r in clusters.greedy_clusters(rows).collect()}
    assert got == {"a": "a", "a2": "a", "b": "b"}
    report = {r.family: (r.originals, r.clusters) for r in clusters.cluster_report(clusters.greedy_clusters(rows)).collect()}
    assert report == {"F": (3, 2), "TOTAL": (3, 2)}


# Taxonomy


def test_lineage_and_ancestors(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n3\t|\t2\t|\tgenus\t|\n4\t|\t3\t|\tspecies\t|\n5\t|\t3\t|\tstrain\t|\n")
    tree = taxonomy.nodes(spark, str(tmp_path / "nodes.dmp"))
    assert {r.tax_id: r.rank for r in tree.collect()} == {1: "R", 2: "D", 3: "G", 4: "S", 5: "strain"}
    ids = spark.createDataFrame([(4,), (5,), (99,), (77,)], "tax_id long")
    merged = spark.createDataFrame([(77, 4)], "old long, new long")
    chains = taxonomy.lineage(ids, tree, merged)
    assert sorted((r.tax_id, r.depth, r.ancestor) for r in chains.collect()) == sorted([(4, 0, 4), (4, 1, 3), (4, 2, 2), (4, 3, 1), (5, 0, 5), (5, 1, 3), (5, 2, 2), (5, 3, 1), (77, 0, 4), (77, 1, 3), (77, 2, 2), (77, 3, 1)])
    groups = spark.createDataFrame([("g", 4), ("g", 5)], "grp string, tax_id long")
    assert taxonomy.common_ancestor(groups, chains).first().ancestor == 3


# Networks, ranks and thresholds


def _around(spark):
    hubs = spark.createDataFrame([("A", h) for h in "ABC"], "mag_id string, hub string")
    links = spark.createDataFrame([("A", c, h) for c, hs in (("c1", "AB"), ("c2", "A"), ("c3", "B"), ("c4", "ABC"), ("c5", "A")) for h in hs], "mag_id string, contig_id string, hub string")
    return links.select("mag_id", "contig_id").distinct(), links, hubs


def test_ring_and_petal(spark):
    import math

    shown, links, hubs = _around(spark)
    place = lambda rows, key: {r[key]: (r.x, r.y) for r in rows.collect()}
    away = lambda p: math.hypot(p[0] - 200, p[1] - 200)
    ring, spokes = place(network.ring_layout(shown, links, hubs), "contig_id"), place(network.ring_hubs(hubs), "hub")
    assert spokes["A"] == (200, 200) and spokes["B"] == pytest.approx((200, 32)) and spokes["C"] == pytest.approx((200, 368))
    assert {c: round(away(p) / 168, 6) for c, p in ring.items()} == {"c1": 0.55, "c2": 0.18, "c3": 0.85, "c4": 0.55, "c5": 0.18}
    assert ring["c3"] == pytest.approx((200, 200 - 168 * 0.85)) and ring["c2"] == pytest.approx((200, 200 - 168 * 0.18))
    assert len(set(ring.values())) == 5
    petal, inner = place(network.petal_layout(shown, links, hubs), "contig_id"), place(network.petal_hubs(hubs), "hub")
    assert {round(away(p) / 168, 6) for p in petal.values()} == {1.0} and {round(away(p) / 168, 6) for p in inner.values()} == {0.28}
    assert petal["c3"] == pytest.approx((200 + 168 * math.cos(math.pi / 6), 200 + 168 * math.sin(math.pi / 6)))
    assert network.layout("nonsense", shown, links, hubs).orderBy("contig_id").collect() == network.layout("ring", shown, links, hubs).orderBy("contig_id").collect()


def neighbourhood_by_hand(votes, mags, agreed, state, view, hubs, most):
    """Leaves and totals of each MAG, contig by contig."""
    by_mag, by_contig = {}, {}
    for c, _, m in votes:
        by_mag.setdefault(m, set()).add(c)
        by_contig.setdefault(c, []).append(m)
    out = {}
    for sel in mags:
        weight = {}
        for c in by_mag.get(sel, ()):
            if agreed[c] > 1:
                for m in by_contig[c]:
                    if m != sel and m in mags:
                        weight[m] = weight.get(m, 0) + 1
        second = sorted(weight, key=lambda m: (-weight[m], m))[:hubs]
        shown, ids, hidden = {sel, *second}, set(), dict.fromkeys(("uncontended", "low", "resolved", "connected"), 0)
        for c in by_mag.get(sel, ()):
            if agreed[c] <= 1:
                why = None if view.uncontended else "uncontended"
            elif not any(m != sel and m in shown for m in by_contig[c]):
                why = "low"
            else:
                why = "resolved" if c in state and not view.resolved else None
            if why:
                hidden[why] += 1
            else:
                ids.add(c)
        for m in second:
            for c in by_mag.get(m, ()):
                if c not in ids:
                    if view.connected:
                        ids.add(c)
                    else:
                        hidden["connected"] += 1
        leaves = {}
        for c in ids:
            n = len(set(by_contig[c]) & shown)
            leaves[c] = ("core" if n == 1 else "tied" if c not in state else "excluded" if state[c] == "excluded" else "held-here" if state[c] == sel else "held-elsewhere", n)
        first = sorted(ids)[:most]
        tied = sum(leaves[c][0] == "tied" for c in first)
        out[sel] = leaves, (len(second), len(weight), len(weight) - len(second), len(first), len(ids), len(ids) > most, tied, hidden["uncontended"], hidden["low"], hidden["resolved"], hidden["connected"])
    return out


def test_views_of_a_neighbourhood(spark):
    from itertools import product

    rng = random.Random(8)
    votes = [(f"c{i}", t, f"M{rng.choice([1, 1, 2, 3, 4, 5, 6])}") for i in range(60) for t in "ABC" if rng.random() < 0.8]
    per = {}
    for c, _, m in votes:
        per.setdefault(c, set()).add(m)
    mags, agreed = [f"M{i}" for i in range(1, 6)], {c: len(m) for c, m in per.items()}  # M6 is no MAG
    state = {c: rng.choice([*mags, "excluded"]) for c in per if rng.random() < 0.6}
    frames = (
        spark.createDataFrame(votes, "contig_id string, tool string, mag_id string"), spark.createDataFrame([(m,) for m in mags], "mag_id string"),
        spark.createDataFrame(list(agreed.items()), "contig_id string, distinct_groups int"), spark.createDataFrame(list(state.items()), "contig_id string, bin_id string"),
    )
    for hubs, most in ((2, 5), (40, 300)):
        found, contenders = network.around(*frames, hubs).cache(), network.rivals(*frames[:3]).cache()
        for flags in product([False, True], repeat=3):
            view = network.View(*flags)
            want = neighbourhood_by_hand(votes, mags, agreed, state, view, hubs, most)
            got = {m: {} for m in mags}
            for r in network.viewed(found, view).collect():
                got[r.mag_id][r.contig_id] = (r.state, r.n_hubs)
            assert got == {m: w[0] for m, w in want.items()}
            totals = network.view_totals(found, contenders, frames[1], view, hubs, most).collect()
            assert {r.mag_id: tuple(r)[1:] for r in totals} == {m: w[1] for m, w in want.items()}


def test_ranks_over_partitions(spark):
    from binloom.operators.ranks import ranked

    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(500)], "v int, i int").repartition(7)
    got = ranked(rows, F.desc("v"), "i").orderBy("rank").collect()
    assert [(r.v, r.i) for r in got] == sorted([(i * 37 % 101, i) for i in range(500)], key=lambda x: (-x[0], x[1]))
    assert [r["rank"] for r in got] == list(range(1, 501)) and ranked(rows.where("false"), "v").count() == 0


def test_thresholds_and_calibration(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"defaultParams": {"minScore": 40, "xDrop": 12, "minMargin": 7}, "familyOverrides": {"F1": {"minRepresentatives": 1}, "F2": {"minMargin": 3}}}')
    s = markers.read_thresholds(spark, str(tmp_path / "t.json"))
    assert (s.min_score, s.drop, s.min_margin, s.min_coverage, s.overrides, s.margins) == (40, 12, 7, 0.3, {"F1": 1}, {"F2": 3})
    rows = [("c", f, r, score, 0.9, i) for i, (f, r, score) in enumerate((("F2", 1, 60), ("F2", 2, 58), ("F3", 3, 57)))]
    ext = spark.createDataFrame([(c, f, i, i, score, cov, 0) for c, f, r, score, cov, i in rows], "contig_id string, family string, ref_id int, tax_id int, score int, coverage double, frame int")
    assert [r.family for r in markers.calls(ext, s).collect()] == ["F2"]
    assert markers.calls(ext, markers.Search(min_score=40)).count() == 0
    found = markers.calibration(spark.createDataFrame([("F3", 1, 4)] * 20 + [("F4", 9, 90)] * 20, "family string, representatives int, margin int"))
    c = markers.calibrated(markers.Search(overrides={}), found)
    assert (c.overrides, c.margins) == ({"F3": 1}, {"F3": 3})


def test_families_with_values_of_their_own(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"familyOverrides": {"F1": {"minScore": 80, "xDrop": 3}, "F2": {"minCoverage": 0.95, "minRepresentatives": 1}, "F3": {"minScore": 10, "minCoverage": 0.1, "minRepresentatives": 1, "minMargin": -100}}}')
    s = markers.read_thresholds(spark, str(tmp_path / "t.json"))
    assert {r.family: tuple(r)[1:] for r in markers.parameters(spark, s).collect()} == {"F1": (80.0, None, None, None), "F2": (None, 0.95, None, 1), "F3": (10.0, 0.1, -100.0, 1)}
    rows = [("c", "F1", 1, 70), ("c", "F1", 2, 90), ("c", "F2", 3, 200), ("c", "F3", 4, 20)]
    ext = spark.createDataFrame([(c, f, i, i, v, 0.9 if f != "F3" else 0.2, 0) for c, f, i, v in rows], "contig_id string, family string, ref_id int, tax_id int, score int, coverage double, frame int")
    assert sorted((r.family, r.representatives, r.score) for r in markers.calls(ext, s).collect()) == [("F3", 1, 20)]  # F1 has one left, F2 covers too little
    loose = markers.calibrated(s, spark.createDataFrame([("F1", 1, 0)], "family string, min_representatives int, min_margin int"))
    assert sorted(r.family for r in markers.calls(ext, loose).collect()) == ["F1", "F3"]
    found = spark.createDataFrame([("F1", 1, 0)], "family string, min_representatives int, min_margin int")
    merged = markers.merged_parameters(markers.parameters(spark, s), found)
    assert sorted(r.family for r in markers.calls(ext, s, merged).collect()) == ["F1", "F3"]


def test_tuned_search_equals_its_steps(spark):
    rng = random.Random(2)
    proteins = ["".join(rng.choice("ARNDCQEGHILKMFPSTWYV") for _ in range(80)) for _ in range(3)]
    codon = {a: c for c, a in sequence.codons().items()}
    told = ["".join(codon[a] for a in p) for p in proteins]
    refs = spark.createDataFrame([(i, f"F{i % 2}", i, p, len(p)) for i, p in enumerate(proteins)], "ref_id int, family string, tax_id int, residues string, len int")
    held = spark.createDataFrame([(f"h{i}", f"F{i % 2}", t) for i, t in enumerate(told)], "header string, family string, seq string")
    contigs = spark.createDataFrame([(f"c{i}", "ACGT" * 20 + t) for i, t in enumerate(told)], "contig_id string, seq string")
    index, s = markers.seed_index(refs, min_hits=1), markers.Search(overrides={})
    got = sorted(map(tuple, markers.tuned_search(contigs, held, refs, index, s).collect()))
    by_hand = markers.calibrated(s, markers.calibration(markers.held_out_margins(held, refs, index, s), s))
    assert got == sorted(map(tuple, markers.search(contigs, refs, index, by_hand).collect()))
    assert {r[0] for r in got} == {"c0", "c1", "c2"} and not markers.search(contigs, refs, index, s).count()


def test_supplied_hits_and_raw_table(spark):
    built = spark.createDataFrame([("a", "F1"), ("b", "F2")], "contig_id string, family string")
    given = spark.createDataFrame([("b", "F9"), ("c", "F3")], "contig_id string, family string")
    assert sorted(tuple(r) for r in bins.preferred_hits(built, given).collect()) == [("a", "F1"), ("b", "F9"), ("c", "F3")]
    assert bins.preferred_hits(built, None).count() == 2
    rows = spark.createDataFrame([("x", 5, 0), ("y", 9, 1), ("z", 5, 2)], "contig_id string, length int, ord int")
    assert [r.contig_id for r in filters.raw_table(rows).collect()] == ["y", "x", "z"]
