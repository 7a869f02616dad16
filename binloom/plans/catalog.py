"""Registered queries over the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels, sequence, text, udfs
from ..operators.graph import checkpointed, shared_folder
from ..operators import assignment, bins, clusters, evidence, filters, idmatch, markers, network, reconcile, taxonomy
from ..sources import export, fasta, indexed, tables
from . import derive as d

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


# Sequence statistics


@query(f"""WITH {d.SEQUENCES}, n AS (SELECT contig_id, length(seq) AS len, len(seq) - length(translate(seq, 'G', '')) AS g, length(seq) - length(translate(seq, 'C', '')) AS c,
  length(regexp_replace(seq, '[ACGT]', '', 'g')) AS other FROM seqs)
SELECT contig_id, len AS length, round(CASE WHEN len = 0 THEN 0 ELSE (g + c) / len::DOUBLE END, 6) AS gc_content,
       round(CASE WHEN g + c = 0 THEN 0 ELSE (g - c) / (g + c)::DOUBLE END, 6) AS gc_skew, other AS ambiguous FROM n""")
def contig_stats(spark, sf):
    s = F.col("seq")
    rows = d.sequences(spark, sf)
    return rows.select("contig_id", F.length(s).cast("long").alias("length"), r6(sequence.gc_content(s), "gc_content"), r6(sequence.gc_skew(s), "gc_skew"), sequence.ambiguous_bases(s).cast("long").alias("ambiguous"))


@query(f"""WITH {d.SEQUENCES} SELECT contig_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM seqs""")
def reverse_complement(spark, sf):
    return d.sequences(spark, sf).select("contig_id", F.md5(sequence.reverse_complement(F.col("seq"))).alias("digest"))


_CODONS = ", ".join(f"('{c}', '{a}')" for c, a in sequence.codons().items())
_FRAMES = f"""{d.SEQUENCES}, strands AS (
  SELECT contig_id, 0 AS back, seq FROM seqs UNION ALL SELECT contig_id, 3, reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs
), codons(codon, amino) AS (VALUES {_CODONS}), codon_rows AS (
  SELECT contig_id, back + (p % 3) AS frame, p // 3 AS k, substr(seq, p + 1, 3) AS codon FROM (SELECT *, unnest(range(0, greatest(length(seq) - 2, 0))) AS p FROM strands)
), frames AS (
  SELECT contig_id, frame, string_agg(coalesce(amino, 'X'), '' ORDER BY k) AS aa FROM codon_rows LEFT JOIN codons USING (codon) GROUP BY ALL
)"""


@query(f"WITH {_FRAMES} SELECT contig_id, frame, length(aa) AS residues, md5(aa) AS digest FROM frames")
def six_frame_translation(spark, sf):
    rows = markers.frames_of(d.sequences(spark, sf)).where("aa <> ''")
    return rows.select("contig_id", "frame", F.length("aa").alias("residues"), F.md5("aa").alias("digest"))


@query(f"""WITH {_FRAMES}, parts AS (SELECT contig_id, length(unnest(string_split(aa, '*'))) AS n FROM frames)
SELECT s.contig_id, round(coalesce(sum(n) FILTER (WHERE n >= 20) / nullif(sum(n), 0)::DOUBLE, 0), 6) AS coding_density FROM seqs s LEFT JOIN parts USING (contig_id) GROUP BY s.contig_id""")
def coding_density(spark, sf):
    rows = d.sequences(spark, sf).select("contig_id", udfs.contig_stats("seq").alias("s"))
    return rows.select("contig_id", r6("s.coding_density", "coding_density"))


_KMERS = f"""{d.SEQUENCES}, windows AS (SELECT contig_id, substr(seq, p, 4) AS k FROM (SELECT *, unnest(range(1, length(seq) - 2)) AS p FROM seqs WHERE length(seq) >= 4)),
kmers AS (SELECT contig_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM windows WHERE NOT contains(k, 'N') GROUP BY ALL)"""


@query(f"WITH {_KMERS} SELECT contig_id, kmer, round(n / sum(n) OVER (PARTITION BY contig_id)::DOUBLE, 6) AS frequency FROM kmers")
def tetranucleotide_composition(spark, sf):
    names = F.array(*[F.lit(k) for k in sequence.canonical_kmers()])
    rows = d.sequences(spark, sf).select("contig_id", F.posexplode(udfs.contig_stats("seq")["composition"]).alias("k", "v")).where("v > 0")
    return rows.select("contig_id", F.get(names, F.col("k")).alias("kmer"), r6("v", "frequency"))


@query(f"WITH {_KMERS} SELECT kmer, sum(n)::BIGINT AS windows, count(*) AS contigs FROM kmers GROUP BY kmer")
def canonical_kmers(spark, sf):
    names = F.array(*[F.lit(k) for k in sequence.canonical_kmers()])
    counts = udfs.kmer_totals(d.sequences(spark, sf).select("seq")).groupBy("k").agg(F.sum("windows").alias("windows"), F.sum("contigs").alias("contigs"))
    return counts.select(F.get(names, F.col("k")).alias("kmer"), "windows", "contigs")


_ORFS = f"""{_FRAMES}, runs AS (
  SELECT contig_id, frame, n, r.aa AS part, sum(length(r.aa) + 1) OVER (PARTITION BY contig_id, frame ORDER BY i ROWS UNBOUNDED PRECEDING) - length(r.aa) - 1 AS off FROM (
    SELECT contig_id, frame, length(seq) AS n, unnest(list_transform(string_split(translate(f.aa, 'X', '*'), '*'), lambda x: {{'aa': x}})) AS r, generate_subscripts(string_split(translate(f.aa, 'X', '*'), '*'), 1) AS i
    FROM frames f JOIN seqs USING (contig_id))
), orfs AS (
  SELECT contig_id, CASE WHEN frame < 3 THEN '+' ELSE '-' END AS strand, frame % 3 AS frame,
         CASE WHEN frame < 3 THEN frame + 3 * off ELSE n - frame % 3 - 3 * (off + length(part)) END::BIGINT AS "start",
         CASE WHEN frame < 3 THEN frame + 3 * (off + length(part)) ELSE n - frame % 3 - 3 * off END::BIGINT AS "end"
  FROM runs WHERE length(part) >= 50
)"""


def _orfs(spark, sf):
    return d.sequences(spark, sf).select("contig_id", F.length("seq").alias("length"), F.explode(udfs.orf_ranges("seq", F.lit(50))).alias("o")).select("contig_id", "length", "o.*")


@query(f"WITH {_ORFS} SELECT contig_id, strand, frame, \"start\", \"end\" FROM orfs")
def orf_ranges(spark, sf):
    return _orfs(spark, sf).drop("length")


@query(f"""WITH {_ORFS}, marked AS (SELECT *, max("end") OVER (PARTITION BY contig_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orfs),
covered AS (SELECT contig_id, sum(greatest(0, "end" - greatest("start", coalesce(before, 0)))) AS covered, count(*) FILTER (WHERE strand = '+') AS forward, count(*) FILTER (WHERE strand = '-') AS backward FROM marked GROUP BY contig_id)
SELECT contig_id, covered::BIGINT AS covered, forward, backward, round(covered / length(seq)::DOUBLE * 100, 6) AS percent FROM covered JOIN seqs USING (contig_id)""")
def orf_coverage(spark, sf):
    w = W.partitionBy("contig_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    rows = _orfs(spark, sf).withColumn("before", F.coalesce(F.max("end").over(w), F.lit(0)))
    part = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))
    out = rows.groupBy("contig_id").agg(F.sum(part).alias("covered"), F.count_if(F.col("strand") == "+").alias("forward"), F.count_if(F.col("strand") == "-").alias("backward"), F.first("length").alias("length"))
    return out.select("contig_id", "covered", "forward", "backward", r6(F.col("covered") / F.col("length") * 100, "percent"))


_GROUPS = "".join(a for g in sequence.MURPHY10 for a in g)
_DIGITS = "".join(str(i) for i, g in enumerate(sequence.MURPHY10) for _ in g)
_SEEDS = f"""{_FRAMES}, segs AS (
  SELECT contig_id, frame, s, sum(length(s) + 1) OVER (PARTITION BY contig_id, frame ORDER BY i ROWS UNBOUNDED PRECEDING) - length(s) - 1 AS off FROM (
    SELECT contig_id, frame, unnest(string_split(translate(aa, 'X', '*'), '*')) AS s, generate_subscripts(string_split(translate(aa, 'X', '*'), '*'), 1) AS i FROM frames)
), seeds AS (
  SELECT contig_id, frame, (off + p)::INT AS frame_pos, translate(substr(s, p + 1, 9), '{_GROUPS}', '{_DIGITS}')::BIGINT AS code
  FROM (SELECT *, unnest(range(0, length(s) - 8, greatest(4, ceil((length(s) - 8) / 150)::BIGINT))) AS p FROM segs WHERE length(s) >= 9)
)"""


@query(f"WITH {_SEEDS} SELECT contig_id, frame, count(*) AS seeds, sum(code)::BIGINT AS code_sum, sum(frame_pos)::BIGINT AS pos_sum FROM seeds GROUP BY ALL")
def reduced_kmer_seeds(spark, sf):
    rows = markers.seeds(markers.frames_of(d.sequences(spark, sf)))
    return rows.groupBy("contig_id", "frame").agg(F.count(F.lit(1)).alias("seeds"), F.sum("code").alias("code_sum"), F.sum("frame_pos").alias("pos_sum"))


# Tables and formats

_BIN_TEXT = "CASE WHEN c_custkey % 2 = 0 THEN 'contig' || chr(9) || 'bin' || chr(13) || chr(10) ELSE '' END || c_name || chr(9) || c_mktsegment || chr(10) || '  ' || chr(10) || c_name || '_2' || chr(9) || ' ' || c_nationkey || chr(9) || 'x' || chr(10) || 'short' || chr(10)"


def _bin_texts(spark, sf):
    rows = d.table(spark, sf, "customer")
    head = F.when(F.col("c_custkey") % 2 == 0, "contig\tbin\r\n").otherwise("")
    return rows.select("c_custkey", F.concat(head, "c_name", F.lit("\t"), "c_mktsegment", F.lit("\n  \n"), "c_name", F.lit("_2\t "), F.col("c_nationkey").cast("string"), F.lit("\tx\nshort\n")).alias("text"))


@query(f"""WITH t AS (SELECT c_custkey, list_filter(string_split(replace({_BIN_TEXT}, chr(13), ''), chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '') AS l FROM customer),
r AS (SELECT c_custkey, generate_subscripts(l, 1) - 1 AS row_idx, string_split(unnest(l), chr(9)) AS f FROM t)
SELECT c_custkey, row_idx::INT AS row_idx, trim(f[1]) AS contig_id, trim(f[2]) AS bin_id FROM r WHERE len(f) >= 2 AND trim(f[1]) <> '' AND trim(f[2]) <> '' AND NOT (row_idx = 0 AND lower(trim(f[1])) = 'contig')""")
def parse_bin_table(spark, sf):
    return tables.parse_bins(_bin_texts(spark, sf), "c_custkey")


def _coverage_texts(spark, sf):
    rows = d.table(spark, sf, "part")
    head = F.when(F.col("p_partkey") % 2 == 0, "contigName\tcontigLen\ttotalAvgDepth\tone.bam\tone.bam-var\ttwo.bam\n").otherwise("")
    cells = F.concat_ws("\t", "p_name", F.col("p_size").cast("string"), F.lit("7"), F.col("p_size").cast("string"), F.lit(""), F.lit("bad"))
    plain = F.concat_ws("\t", "p_name", F.col("p_size").cast("string"), F.lit("1e2"), F.lit("0x10"))
    return rows.select("p_partkey", F.concat(head, F.when(F.col("p_partkey") % 2 == 0, cells).otherwise(plain), F.lit("\n")).alias("text"))


@query("""SELECT p_partkey, p_name AS contig_id, 'one.bam' AS sample, p_size::DOUBLE AS depth FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_name, 'two.bam', -1.0 FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, p_name, 'sample1', p_size::DOUBLE FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT p_partkey, p_name, 'sample2', 100.0 FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT p_partkey, p_name, 'sample3', 16.0 FROM part WHERE p_partkey % 2 = 1""")
def parse_coverage(spark, sf):
    rows = tables.parse_coverage(_coverage_texts(spark, sf), "p_partkey")
    return rows.select("p_partkey", "contig_id", "sample", F.when(F.isnan("depth"), F.lit(-1.0)).otherwise(F.col("depth")).alias("depth"))


@query("""SELECT 'bins' AS source, CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'unknown' END AS format, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'coverage', CASE WHEN p_partkey % 2 = 0 THEN 'unknown' ELSE 'coverage' END, count(*) FROM part GROUP BY ALL
UNION ALL SELECT 'pairs', 'contig-bin', count(*) FROM orders""")
def sniff_format(spark, sf):
    orders = d.spread(d.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    pairs = orders.select(F.lit("pairs").alias("source"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("text"))
    rows = _bin_texts(spark, sf).select(F.lit("bins").alias("source"), "text").unionAll(_coverage_texts(spark, sf).select(F.lit("coverage"), "text")).unionAll(pairs)
    return rows.groupBy("source", tables.sniff(F.col("text")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def _written_lines(spark, rows, label):
    """Rows (g, i, line) as one text file for each g, in the order of i; the folder."""
    path = _new_folder(spark, label)
    rows.repartition("g").sortWithinPartitions("g", "i").select("g", F.col("line").alias("value")).write.partitionBy("g").text(path)
    return path


def _table_lines(spark, sf):
    """Lines of one table for each nation (contig-bin) and for each brand (coverage): (g, i, line); 0 is the header."""
    c, p = d.table(spark, sf, "customer"), d.table(spark, sf, "part")
    g = F.col("c_nationkey")
    mark = F.when(g % 3 == 0, ",").otherwise("\t")
    bins = c.select(g.cast("string").alias("g"), F.col("c_custkey").alias("i"), F.concat("c_name", mark, "c_mktsegment", F.when(F.col("c_custkey") % 50 == 0, "\r").otherwise("")).alias("line"))
    head = c.select(g).distinct().where(g % 2 == 0).select(g.cast("string").alias("g"), F.lit(-1).cast("long").alias("i"), F.concat(F.lit("Contig_ID"), mark, F.lit("bin")).alias("line"))
    b, key = F.col("p_brand"), F.col("p_partkey")
    named = F.substr(b, F.lit(-1), F.lit(1)).cast("int") % 2 == 0
    cells = [F.concat(F.lit("part_"), key), F.lit("9"), F.lit("1"), F.col("p_retailprice").cast("string"), F.lit("3"), F.concat(F.col("p_size"), F.lit("e1"))]
    plain = [F.concat(F.lit("part_"), key), F.concat(F.lit("0x"), F.hex("p_size")), F.when(key % 9 == 0, "").otherwise(F.col("p_retailprice").cast("string"))]
    cover = p.select(b.alias("g"), key.alias("i"), F.when(named, F.concat_ws("\t", *cells)).otherwise(F.concat_ws("\t", *plain)).alias("line"))
    title = p.select(b).distinct().where(named).select(b.alias("g"), F.lit(-1).cast("long").alias("i"), F.lit("contigName\tcontigLen\ttotalAvgDepth\tone.bam\tone.bam-var\ttwo.bam").alias("line"))
    return bins.unionByName(head), cover.unionByName(title)


def _group_of(rows):
    """Tables by the folder their file is in."""
    # Escaped as a folder, then as a path.
    return rows.withColumn("g", F.url_decode(F.regexp_extract(F.url_decode("file"), "/g=([^/]*)/", 1)))


@query("""WITH r AS (SELECT c_nationkey::VARCHAR AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 + CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS row_idx, c_name, c_mktsegment FROM customer)
SELECT g, row_idx::BIGINT AS row_idx, c_name AS contig_id, c_mktsegment AS bin_id FROM r""")
def scanned_bin_tables(spark, sf):
    """Tables written as files and read in any splits, with row numbers from sums over the splits."""
    lines = tables.read_lines(spark, f"{_written_lines(spark, _table_lines(spark, sf)[0], 'bins')}/g=*")
    told = _group_of(tables.heads(lines)).withColumn("label", F.col("g"))
    return tables.bins_of(lines, told.where("format = 'contig-bin'")).select(F.col("label").alias("g"), "row_idx", "contig_id", "bin_id")


@query("""WITH t AS (SELECT p_brand AS g, p_partkey, right(p_brand, 1)::INT % 2 = 0 AS named, p_retailprice, p_size, '0x' || hex(p_size) AS h, p_size || 'e1' AS e FROM part)
SELECT g, 'part_' || p_partkey AS contig_id, 'one.bam' AS sample, p_retailprice AS depth FROM t WHERE named UNION ALL SELECT g, 'part_' || p_partkey, 'two.bam', e::DOUBLE FROM t WHERE named
UNION ALL SELECT g, 'part_' || p_partkey, 'sample1', (h::INT)::DOUBLE FROM t WHERE NOT named
UNION ALL SELECT g, 'part_' || p_partkey, 'sample2', CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_retailprice END FROM t WHERE NOT named""")
def scanned_coverage_tables(spark, sf):
    lines = tables.read_lines(spark, f"{_written_lines(spark, _table_lines(spark, sf)[1], 'coverage')}/g=*")
    told = _group_of(tables.heads(lines)).withColumn("label", F.col("g"))
    return tables.coverage_of(lines, told.where("format = 'coverage'")).select(F.col("label").alias("g"), "contig_id", "sample", "depth")


@query("""WITH w AS (SELECT conv_id AS g, turn, string_split(text, chr(10)) AS l FROM conversations WHERE text IS NOT NULL),
u AS (SELECT g, turn, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn, k) AS i FROM u WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
t AS (SELECT g, list(line ORDER BY i) FILTER (WHERE i <= 20) AS f FROM r GROUP BY g),
m AS (SELECT g, f, CASE WHEN len(string_split(f[1], chr(9))) >= len(string_split(f[1], ',')) THEN chr(9) ELSE ',' END AS mark FROM t),
c AS (SELECT g, list_transform(f, lambda x: list_transform(string_split(x, mark), lambda y: trim(y, ' ' || chr(9) || chr(13)))) AS c, greatest(len(string_split(f[1], chr(9))), len(string_split(f[1], ','))) AS cols FROM m),
n AS (SELECT *, len(list_filter(c[1][2:], lambda y: y <> '' AND try_cast(y AS DOUBLE) IS NULL)) > 0 AS named,
  lower(c[1][1]) IN ('contig', 'contigid', 'contig_id', 'contigname', 'contig_name', 'scaffold', 'scaffoldid', 'scaffold_id', 'sequence', 'sequence_id', 'sequenceid', 'name') AS titled FROM c),
k AS (SELECT g, cols, CASE WHEN named THEN c[2:10] ELSE c[1:10] END AS a, CASE WHEN titled THEN c[2:] ELSE c END AS b FROM n),
j AS (SELECT g, cols, len(a) > 0 AND len(list_filter(a, lambda x: len(x) < 2 OR x[1] = '' OR len(list_filter(x[2:], lambda y: y <> '' AND try_cast(y AS DOUBLE) IS NULL)) > 0)) = 0 AS cover,
  len(b) > 0 AND len(list_filter(b, lambda x: len(x) <> 2 OR x[1] = '' OR x[2] = '')) = 0 AS pairs FROM k)
SELECT CASE WHEN cols >= 3 AND cover THEN 'coverage' WHEN pairs THEN 'contig-bin' WHEN cover THEN 'coverage' ELSE 'unknown' END AS format, count(*) AS n FROM j GROUP BY ALL""")
def sniffed_texts(spark, sf):
    """Formats that the conversations' texts would be taken for, told of each by its first lines."""
    rows = d.table(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return rows.groupBy(tables.sniff(F.array_join("r.text", "\n")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


# Repair of ids


def _broken(spark, sf):
    rows = d.assignments(spark, sf)
    part = F.concat("contig_id", F.lit(".concoct_part_"), (F.col("row_idx") % 3).cast("string"))
    a = rows.where("tool = 'A'").withColumn("contig_id", part)
    b = rows.where("tool = 'B'").select("tool", "row_idx", F.col("bin_id").alias("contig_id"), F.col("contig_id").alias("bin_id"))
    return a.unionByName(b).unionByName(rows.where("tool = 'C'"))


_BROKEN = f"""{d.ASSIGNMENTS}, broken AS (
  SELECT tool, row_idx, contig_id || '.concoct_part_' || (row_idx % 3) AS contig_id, bin_id FROM assignments WHERE tool = 'A'
  UNION ALL SELECT tool, row_idx, bin_id, contig_id FROM assignments WHERE tool = 'B' UNION ALL SELECT * FROM assignments WHERE tool = 'C'
), known AS (SELECT DISTINCT 'contig_' || doc_id AS id FROM documents), rates AS (
  SELECT tool, avg((contig_id IN (SELECT id FROM known))::INT) AS exact_rate, avg((regexp_replace(contig_id, '\\.concoct_part_\\d+$', '') IN (SELECT id FROM known))::INT) AS suffix_rate,
         avg((bin_id IN (SELECT id FROM known))::INT) AS swap_rate FROM broken GROUP BY tool
)"""


@query(f"WITH {_BROKEN} SELECT tool, 'exact' AS strategy, round(exact_rate, 6) AS rate FROM rates UNION ALL SELECT tool, 'suffix', round(suffix_rate, 6) FROM rates UNION ALL SELECT tool, 'swap', round(swap_rate, 6) FROM rates")
def match_rate(spark, sf):
    return idmatch.match_rates(_broken(spark, sf), d.contigs(spark, sf).select("contig_id")).withColumn("rate", r6("rate"))


@query(f"""WITH {_BROKEN} SELECT tool, CASE WHEN exact_rate >= 0.9 THEN 'exact' WHEN greatest(suffix_rate, swap_rate) > exact_rate AND greatest(suffix_rate, swap_rate) >= 0.9
  THEN CASE WHEN suffix_rate >= swap_rate THEN 'suffix' ELSE 'swap' END ELSE 'none' END AS strategy,
  round(exact_rate, 6) AS before, round(CASE WHEN exact_rate < 0.9 AND greatest(suffix_rate, swap_rate) > exact_rate THEN greatest(suffix_rate, swap_rate) ELSE exact_rate END, 6) AS after FROM rates""")
def repair_strategy(spark, sf):
    rows = idmatch.strategies(_broken(spark, sf), d.contigs(spark, sf).select("contig_id"))
    return rows.select("tool", "strategy", r6("before", "before"), r6("after", "after"))


@query(f"""WITH {_BROKEN}, fixed AS (
  SELECT tool, row_idx, regexp_replace(contig_id, '\\.concoct_part_\\d+$', '') AS contig_id, bin_id FROM broken WHERE tool = 'A'
  UNION ALL SELECT tool, row_idx, bin_id, contig_id FROM broken WHERE tool = 'B' UNION ALL SELECT tool, row_idx, contig_id, bin_id FROM broken WHERE tool = 'C')
SELECT tool, row_idx, contig_id, bin_id FROM fixed""")
def repaired_tables(spark, sf):
    return idmatch.repaired(_broken(spark, sf), d.contigs(spark, sf).select("contig_id"))[0].select("tool", "row_idx", "contig_id", "bin_id")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL)
SELECT o_custkey AS contig_id, (list(o_orderpriority ORDER BY n DESC, f))[1] AS bin_id, count(*) AS distinct_bins FROM c GROUP BY ALL""")
def majority_collapse(spark, sf):
    rows = d.table(spark, sf, "orders").select(F.lit("x").alias("tool"), F.col("o_custkey").alias("contig_id"), F.col("o_orderpriority").alias("bin_id"), F.col("o_orderkey").alias("row_idx"))
    return idmatch.majority(rows).select("contig_id", "bin_id", "distinct_bins")


# Bins

_TOOL_A = "(SELECT contig_id, bin_id FROM assignments WHERE tool = 'A')"
_BINS = f"{d.CONTIGS}, {d.ASSIGNMENTS}, {d.HITS}, {d.SUMMARY.format(source=_TOOL_A)}"


def _tool_a(spark, sf):
    return d.assignments(spark, sf).where("tool = 'A'")


def _summary(spark, sf):
    return bins.bin_summary(_tool_a(spark, sf), d.contigs(spark, sf), d.marker_hits(spark, sf))


@query(f"""WITH {_BINS} SELECT bin_id, contig_count, total_length, n50, l50, round(mean_gc, 6) AS mean_gc, families_found, round(completeness, 6) AS completeness,
  round(redundancy, 6) AS redundancy, round(raw_completeness, 6) AS raw_completeness, tier FROM tiers""")
def bin_summary(spark, sf):
    rows = _summary(spark, sf)
    return rows.withColumns({c: r6(c) for c in ("mean_gc", "completeness", "redundancy", "raw_completeness")})


@query(f"WITH {_BINS} SELECT bin_id, n50, l50 FROM half")
def n50_l50(spark, sf):
    rows = _tool_a(spark, sf).join(d.contigs(spark, sf), "contig_id").select("bin_id", "length")
    return bins.n50_l50(rows, "bin_id")


@query(f"WITH {_BINS} SELECT tier, count(*) AS n_bins, sum(contig_count)::BIGINT AS contigs FROM tiers GROUP BY tier")
def mimag_tiers(spark, sf):
    return _summary(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("contig_count").alias("contigs"))


@query("""WITH p AS (SELECT 'contig_' || p_partkey AS contig_id, p_brand AS bin_id FROM part) SELECT contig_id, bin_id FROM p WHERE contig_id NOT IN (SELECT 'contig_' || doc_id FROM documents)""")
def unmatched_contigs(spark, sf):
    rows = d.table(spark, sf, "part").select(F.concat(F.lit("contig_"), "p_partkey").alias("contig_id"), F.col("p_brand").alias("bin_id"))
    return bins.unmatched(rows, d.contigs(spark, sf))


@query(f"""WITH {d.ASSIGNMENTS}, {d.HITS}, r AS (SELECT DISTINCT bin_id, contig_id, family FROM assignments JOIN hits USING (contig_id) WHERE tool = 'A')
SELECT bin_id, contig_id, family, count(*) OVER (PARTITION BY bin_id, family) = 1 AS is_unique FROM r""")
def marker_contribution(spark, sf):
    return bins.marker_contributions(_tool_a(spark, sf), d.marker_hits(spark, sf))


@query(f"""WITH {d.CONTIGS}, {d.HITS}, r AS (SELECT *, sum(length) OVER () AS total, sum(length) OVER (ORDER BY length DESC, contig_id ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY length DESC, contig_id) AS r FROM contigs),
h AS (SELECT * FROM hits WHERE contig_id IN (SELECT contig_id FROM contigs))
SELECT (SELECT count(*) FROM contigs) AS contig_count, (SELECT sum(length)::BIGINT FROM contigs) AS total_length, (SELECT round(avg(gc_content), 6) FROM contigs) AS mean_gc,
  (SELECT count(DISTINCT contig_id) FROM h) AS with_markers, (SELECT count(DISTINCT family) FROM h) AS families,
  (SELECT arg_min(length, r) FROM r WHERE upto >= total / 2) AS n50, (SELECT min(r) FROM r WHERE upto >= total / 2) AS l50""")
def assembly_summary(spark, sf):
    return bins.assembly_summary(d.contigs(spark, sf), d.marker_hits(spark, sf)).withColumn("mean_gc", r6("mean_gc"))


@query(f"""WITH {d.ASSIGNMENTS}, per AS (SELECT tool, bin_id, count(*) AS n FROM assignments WHERE lower(bin_id) NOT IN ('unbinned', 'none', 'na') GROUP BY ALL)
SELECT a.tool, count(*) AS n_rows, any_value(p.n_bins) AS n_bins, any_value(p.pct) AS singleton_pct, any_value(p.pct) >= 50 AS fragmented
FROM assignments a JOIN (SELECT tool, count(*) AS n_bins, count(*) FILTER (WHERE n = 1) / count(*)::DOUBLE * 100 AS pct FROM per GROUP BY tool) p USING (tool) GROUP BY a.tool""")
def tool_card(spark, sf):
    return bins.tool_card(d.assignments(spark, sf))


@query(f"""WITH {_BINS}, r AS (SELECT bin_id, completeness - redundancy AS net FROM tiers WHERE contig_count >= 2)
(SELECT 'good' AS kind, bin_id, round(net, 6) AS net FROM r ORDER BY net DESC, bin_id LIMIT 1) UNION ALL (SELECT 'bad', bin_id, round(net, 6) FROM r ORDER BY net, bin_id LIMIT 1)""")
def good_and_bad_bins(spark, sf):
    return evidence.good_and_bad(_summary(spark, sf)).withColumn("net", r6("net"))


# Reconciliation


@query(f"WITH {d.PAIRS} SELECT tool_a, bin_a, tool_b, bin_b, shared, round(jaccard, 6) AS jaccard FROM pairs")
def jaccard_pairs(spark, sf):
    return reconcile.overlaps(reconcile.votes_cast(d.assignments(spark, sf))).withColumn("jaccard", r6("jaccard"))


@query(f"WITH {d.BEST} SELECT tool_a, bin_a, tool_b, bin_b, shared, round(jaccard, 6) AS jaccard FROM best")
def reciprocal_best(spark, sf):
    rows = reconcile.overlaps(reconcile.votes_cast(d.assignments(spark, sf)))
    return reconcile.reciprocal_best(rows).withColumn("jaccard", r6("jaccard"))


@query(f"WITH RECURSIVE {d.MAGS} SELECT mag_id, tool, bin_id, contig_count FROM mag_bins")
def mag_members(spark, sf):
    return reconcile.Reconciliation(d.assignments(spark, sf)).members


@query(f"""WITH RECURSIVE {d.MAGS}, k AS (SELECT mag_id, count(*) FILTER (WHERE kind = 'core') AS core, count(*) FILTER (WHERE kind = 'disputed') AS disputed FROM stands GROUP BY mag_id)
SELECT mag_id, n_members, tools, core, disputed, (row_number() OVER (ORDER BY split_part(mag_id, '_', 2)::INT))::INT AS rank FROM mags JOIN k USING (mag_id)""")
def putative_mags(spark, sf):
    return reconcile.Reconciliation(d.assignments(spark, sf)).mags


@query(f"WITH RECURSIVE {d.MAGS} SELECT contig_id, total_votes, round(agreement, 6) AS agreement, distinct_groups, majority_mag FROM agreed")
def contig_agreement(spark, sf):
    return reconcile.Reconciliation(d.assignments(spark, sf)).agreement.withColumn("agreement", r6("agreement"))


@query(f"WITH RECURSIVE {d.MAGS} SELECT mag_id, contig_id, kind FROM stands")
def core_and_disputed(spark, sf):
    return reconcile.Reconciliation(d.assignments(spark, sf)).standing


@query(f"WITH RECURSIVE {d.MAGS} SELECT contig_id, round(agreement, 6) AS agreement, total_votes, distinct_groups, (row_number() OVER (ORDER BY agreement, total_votes DESC, contig_id))::INT AS rank FROM agreed WHERE agreement < 1")
def disputed_ranked(spark, sf):
    return reconcile.disputed_ranked(reconcile.Reconciliation(d.assignments(spark, sf)).agreement).withColumn("agreement", r6("agreement"))


# Working assignment


def _state(spark, sf, rec):
    base = assignment.initial(d.assignments(spark, sf), rec.agreement, 3)
    return assignment.fold(base, d.edit_targets(d.edits(spark, sf)))


_BEST_ANY = d.BEST.replace("jaccard >= 0.1", "jaccard >= 0.0")


@query(f"WITH RECURSIVE {_BEST_ANY}, {d.GROUPED} SELECT s.tool, s.bin_id, g.grp FROM sizes s JOIN grouped g ON g.node = s.tool || chr(31) || s.bin_id")
def constrained_groups(spark, sf):
    """Groups of all best matches, however weak: languages match sources, so that tools would come twice without the rule."""
    cast = reconcile.votes_cast(d.assignments(spark, sf))
    return reconcile.groups(cast, checkpointed(reconcile.reciprocal_best(reconcile.overlaps(cast), 0.0)))


# Clicks merge the bin of one's own number into another; other events move a contig.
_LOG = """log AS (SELECT event_id AS seq, CASE WHEN event_type <> 'click' THEN 'contig_' || user_id END AS contig_id, CASE WHEN event_type = 'click' THEN 'src' || (user_id % 23) END AS source, 'src' || (event_id % 23) AS target FROM events)"""


def _edit_log(events):
    click, to = F.col("event_type") == "click", F.concat(F.lit("src"), F.col("event_id") % 23)
    return events.select(
        F.col("event_id").alias("seq"), F.when(~click, F.concat(F.lit("contig_"), "user_id")).alias("contig_id"), F.when(click, F.concat(F.lit("src"), F.col("user_id") % 23)).alias("source"), to.alias("target")
    )


@query(f"""WITH RECURSIVE {d.ASSIGNMENTS}, {_LOG}, merges AS (SELECT seq, source, target FROM log WHERE contig_id IS NULL AND source <> target),
start AS (SELECT contig_id, arg_max(bin_id, seq) AS bin_id, max(seq) AS seq FROM (SELECT contig_id, bin_id, -1 AS seq FROM assignments WHERE tool = 'A' UNION ALL SELECT contig_id, target, seq FROM log WHERE contig_id IS NOT NULL) GROUP BY contig_id),
way AS (SELECT contig_id, bin_id, seq FROM start
  UNION ALL SELECT w.contig_id, m.target, m.seq FROM way w, LATERAL (SELECT seq, target FROM merges WHERE source = w.bin_id AND seq > w.seq ORDER BY seq LIMIT 1) m)
SELECT contig_id, arg_max(bin_id, seq) AS bin_id FROM way GROUP BY contig_id""")
def edit_replay(spark, sf):
    return assignment.replay(_tool_a(spark, sf).select("contig_id", "bin_id"), _edit_log(d.table(spark, sf, "events")))


@query(f"""WITH RECURSIVE {d.ASSIGNMENTS}, {_LOG}, merges AS (SELECT seq, source, target FROM log WHERE contig_id IS NULL AND source <> target),
start AS (SELECT contig_id, arg_max(bin_id, seq) AS bin_id, max(seq) AS seq FROM (SELECT contig_id, bin_id, -1 AS seq FROM assignments WHERE tool = 'B' UNION ALL SELECT contig_id, target, seq FROM log WHERE contig_id IS NOT NULL) GROUP BY contig_id),
way AS (SELECT contig_id, bin_id, seq FROM start
  UNION ALL SELECT w.contig_id, m.target, m.seq FROM way w, LATERAL (SELECT seq, target FROM merges WHERE source = w.bin_id AND seq > w.seq ORDER BY seq LIMIT 1) m)
SELECT contig_id, arg_max(bin_id, seq) AS bin_id FROM way GROUP BY contig_id""")
def edit_stream_replay(spark, sf):
    """The log as a stream, into the bins of another tool."""
    from ..streaming import edits as stream

    rows = spark.readStream.schema(d.table(spark, sf, "events").schema).parquet(_stream_path(sf, "events"))
    base = d.assignments(spark, sf).where("tool = 'B'").select("contig_id", "bin_id")
    folder = _new_folder(spark, "replay")
    return stream.keep_replayed(_edit_log(rows), base, folder, f"{folder}-log")


@query(f"WITH RECURSIVE {d.STATE} SELECT contig_id, bin_id FROM state")
def assignment_fold(spark, sf):
    return _state(spark, sf, reconcile.Reconciliation(d.assignments(spark, sf)))


@query(f"WITH {d.EDITS} SELECT contig_id, arg_max(bin_id, seq) AS bin_id, max(seq) AS seq FROM edits GROUP BY contig_id")
def edit_stream_latest(spark, sf):


    from ..operators.graph import shared_folder
    from ..streaming import edits as stream

    rows = spark.readStream.schema(d.table(spark, sf, "events").schema).parquet(_stream_path(sf, "events"))
    edits = rows.select(F.col("event_id").alias("seq"), F.concat(F.lit("contig_"), "user_id").alias("contig_id"), F.col("event_type").alias("bin_id"))
    base = f"{shared_folder(spark)}/edits-{uuid.uuid4().hex}"
    stream.keep_state(edits, f"{base}/changes", f"{base}/log")
    return stream.current_state(spark.read.parquet(f"{base}/changes").select("contig_id", "bin_id", "seq"))


def _stream_path(sf: str, name: str) -> str:
    """A path for the stream's file source: the table may be one file or a folder of parts. The brackets make a pattern
    of a file's name, which the source asks for, and match the name alone."""
    return f"{sf}/{name}.parque[t]"


@query(f"WITH {d.ASSIGNMENTS} SELECT contig_id, CASE bin_id WHEN 'src1' THEN 'src2' ELSE bin_id END AS bin_id FROM assignments WHERE tool = 'A'")
def merge_bins(spark, sf):
    return assignment.merge(_tool_a(spark, sf).select("contig_id", "bin_id"), "src1", "src2")


@query(f"WITH {d.ASSIGNMENTS} SELECT contig_id, CASE bin_id WHEN 'src3' THEN 'excluded' ELSE bin_id END AS bin_id FROM assignments WHERE tool = 'A'")
def exclude_contigs(spark, sf):
    rows = _tool_a(spark, sf).select("contig_id", "bin_id")
    return assignment.exclude(rows, rows.where("bin_id = 'src3'"))


@query(f"WITH {d.ASSIGNMENTS} SELECT DISTINCT bin_id FROM assignments WHERE tool = 'A'")
def list_bins(spark, sf):
    return assignment.list_bins(_tool_a(spark, sf))


@query(f"WITH RECURSIVE {d.STATE} SELECT contig_id, bin_id FROM state WHERE bin_id <> 'MAG_2'")
def exportable_assignment(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    return assignment.exportable(_state(spark, sf, rec), spark.createDataFrame([("MAG_2",)], "mag_id string"))


# Filters


@query(f"WITH {d.CONTIGS} SELECT contig_id FROM contigs WHERE length >= 1000 AND gc_content * 100 >= 40 AND gc_content * 100 <= 60")
def contig_filter(spark, sf):
    f = filters.ContigFilter(length=(1000, None), gc_percent=(40, 60))
    return filters.filter_contigs(d.contigs(spark, sf), d.assignments(spark, sf), None, f).select("contig_id")


@query(f"WITH {d.CONTIGS}, {d.ASSIGNMENTS} SELECT contig_id, length FROM contigs WHERE contig_id IN (SELECT contig_id FROM assignments WHERE tool = 'B' AND bin_id = 'src0')")
def bin_filter(spark, sf):
    return filters.in_bin(d.contigs(spark, sf), d.assignments(spark, sf), "B", "src0").select("contig_id", "length")


@query("SELECT 'contig_' || p_partkey AS contig_id FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM documents)")
def unbinned_filter(spark, sf):
    rows = d.table(spark, sf, "part").select(F.concat(F.lit("contig_"), "p_partkey").alias("contig_id"))
    return filters.in_no_bin(rows, d.assignments(spark, sf))


@query(f"WITH {d.ASSIGNMENTS} SELECT DISTINCT contig_id FROM assignments WHERE contains(lower(contig_id), 'src1') OR contains(lower(bin_id), 'src1')")
def text_search(spark, sf):
    return filters.search(d.contigs(spark, sf), d.assignments(spark, sf), " SRC1 ").select("contig_id")


@query(f"WITH RECURSIVE {d.MAGS} SELECT contig_id FROM agreed WHERE agreement * 100 <= 70")
def agreement_filter(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    f = filters.ContigFilter(max_agreement_percent=70)
    return filters.filter_contigs(d.contigs(spark, sf), d.assignments(spark, sf), rec.agreement, f).select("contig_id")


@query(f"WITH {d.ASSIGNMENTS} SELECT DISTINCT tool, bin_id FROM assignments")
def bin_options(spark, sf):
    return filters.bin_options(d.assignments(spark, sf))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT doc_id FROM documents)")
def referenced_contigs(spark, sf):
    rows = d.table(spark, sf, "part").select(F.concat(F.lit("contig_"), "p_partkey").alias("contig_id"), "p_partkey", "p_name")
    return filters.referenced(rows, d.assignments(spark, sf)).select("p_partkey", "p_name")


# Evidence and MAGs

_LIVE = f"{d.STATE}, {d.CONTIGS}, {d.HITS}, live_rows AS (SELECT contig_id, bin_id FROM state WHERE bin_id IN (SELECT mag_id FROM mags)), {d.SUMMARY.format(source='live_rows')}"
_MAG_SUMMARY = f"""{_LIVE}, linked AS (
  SELECT DISTINCT v.mag_id, v.contig_id, s.kind IS NOT NULL AS core, t.bin_id FROM votes v JOIN mags USING (mag_id)
  LEFT JOIN (SELECT * FROM stands WHERE kind = 'core') s ON s.mag_id = v.mag_id AND s.contig_id = v.contig_id LEFT JOIN state t ON t.contig_id = v.contig_id
), mag_counts AS (
  SELECT mag_id, count(*) FILTER (WHERE core) AS core_count, count(*) FILTER (WHERE NOT core AND bin_id = mag_id) AS held_here,
         count(*) FILTER (WHERE NOT core AND bin_id <> mag_id AND bin_id <> 'excluded') AS held_elsewhere, count(*) FILTER (WHERE NOT core AND bin_id IS NULL) AS unresolved,
         count(*) FILTER (WHERE NOT core AND bin_id = 'excluded') AS excluded, count(*) FILTER (WHERE NOT core) AS disputed_count, count(*) AS in_network FROM linked GROUP BY mag_id
), mag_summary AS (
  SELECT m.mag_id, tools, core_count, held_here, held_elsewhere, unresolved, excluded, disputed_count, in_network, coalesce(t.contig_count, 0) AS live_contigs,
         coalesce(t.total_length, 0) AS live_length, coalesce(t.n50, 0) AS live_n50, coalesce(t.completeness, 0) AS completeness, coalesce(t.redundancy, 0) AS redundancy, coalesce(t.tier, 'low') AS tier
  FROM mags m JOIN mag_counts c USING (mag_id) LEFT JOIN tiers t ON t.bin_id = m.mag_id
)"""


def _mag_summary(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    return evidence.mag_summary(rec.mags, rec.votes, rec.standing, _state(spark, sf, rec), d.contigs(spark, sf), d.marker_hits(spark, sf))


@query(f"""WITH RECURSIVE {_MAG_SUMMARY} SELECT * REPLACE (round(completeness, 6) AS completeness, round(redundancy, 6) AS redundancy) FROM mag_summary""")
def mag_summary(spark, sf):
    return _mag_summary(spark, sf).withColumns({"completeness": r6("completeness"), "redundancy": r6("redundancy")})


@query(f"WITH RECURSIVE {_MAG_SUMMARY} SELECT mag_id, tier, core_count FROM mag_summary WHERE core_count >= 5 AND tier <> 'high' AND list_contains(string_split(tools, ','), 'A')")
def mag_filter(spark, sf):
    f = filters.MagFilter(core=(5, None), tiers_off=("high",), tool="A")
    return filters.filter_mags(_mag_summary(spark, sf), f).select("mag_id", "tier", "core_count")


_PAIRED = f"""{d.MAGS}, {d.CONTIGS}, {d.COVERAGE}, cand AS (
  SELECT DISTINCT v.contig_id, v.mag_id FROM votes v JOIN mags USING (mag_id) JOIN agreed a USING (contig_id) WHERE a.distinct_groups > 1
), core_rows AS (SELECT s.mag_id, c.contig_id, c.gc_content, v.mean_depth FROM stands s JOIN contigs c USING (contig_id) LEFT JOIN coverage v USING (contig_id) WHERE kind = 'core'),
core_means AS (SELECT mag_id, count(*) AS core_count, avg(gc_content) AS gc, avg(mean_depth) AS depth FROM core_rows GROUP BY mag_id)"""


def _pairs(spark, sf, rec):
    return evidence.candidates(rec.votes, rec.mags, rec.agreement)


_CODING = f"""{_FRAMES.removeprefix(d.SEQUENCES + ", ")}, aa_parts AS (SELECT contig_id, length(unnest(string_split(aa, '*'))) AS n FROM frames),
coding AS (SELECT s.contig_id, coalesce(sum(n) FILTER (WHERE n >= 20) / nullif(sum(n), 0)::DOUBLE, 0) AS coding FROM seqs s LEFT JOIN aa_parts USING (contig_id) GROUP BY s.contig_id),
core_coding AS (SELECT s.mag_id, avg(coding) AS mean_coding FROM stands s JOIN coding USING (contig_id) WHERE kind = 'core' GROUP BY s.mag_id)"""


@query(f"""WITH RECURSIVE {_PAIRED}, {_CODING} SELECT p.contig_id, p.mag_id, coalesce(core_count, 0) AS core_count, round(100 * gc_content - 100 * gc, 6) AS gc_diff, round(100 * coding - 100 * mean_coding, 6) AS coding_diff,
  round(CASE WHEN depth > 0 THEN mean_depth / depth END, 6) AS coverage_ratio FROM cand p JOIN contigs c USING (contig_id) JOIN coding USING (contig_id) LEFT JOIN coverage v USING (contig_id) LEFT JOIN core_means m USING (mag_id)
  LEFT JOIN core_coding USING (mag_id)""")
def contig_evidence(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    stats = d.sequences(spark, sf).select("contig_id", udfs.contig_stats("seq").alias("s")).select("contig_id", "s.gc_content", "s.coding_density")
    rows = evidence.coverage_attached(checkpointed(stats), d.coverage(spark, sf))
    out = evidence.evidence(_pairs(spark, sf, rec), rec.standing, rows)
    return out.select("contig_id", "mag_id", "core_count", r6("gc_diff", "gc_diff"), r6("coding_diff", "coding_diff"), r6("coverage_ratio", "coverage_ratio"))


@query(f"""WITH RECURSIVE {d.MAGS}, {d.HITS}, cand AS (SELECT DISTINCT v.contig_id, v.mag_id FROM votes v JOIN mags USING (mag_id) JOIN agreed a USING (contig_id) WHERE a.distinct_groups > 1),
held AS (SELECT DISTINCT mag_id, family FROM stands JOIN hits USING (contig_id) WHERE kind = 'core')
SELECT c.contig_id, c.mag_id, h.family, d.family IS NOT NULL AS redundant FROM cand c JOIN hits h USING (contig_id) LEFT JOIN held d ON d.mag_id = c.mag_id AND d.family = h.family""")
def marker_status(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    return evidence.marker_status(_pairs(spark, sf, rec), rec.standing, d.marker_hits(spark, sf))


_VECTORS = f"""freq AS (SELECT contig_id, kmer, n / sum(n) OVER (PARTITION BY contig_id)::DOUBLE AS v FROM kmers),
names AS (SELECT DISTINCT kmer FROM kmers), vectors AS (SELECT c.contig_id, k.kmer, coalesce(f.v, 0) AS v FROM (SELECT contig_id FROM seqs) c CROSS JOIN names k LEFT JOIN freq f ON f.contig_id = c.contig_id AND f.kmer = k.kmer)"""
_KMER_PART = _KMERS.removeprefix(d.SEQUENCES + ", ")


@query(f"""WITH RECURSIVE {d.MAGS}, {d.SEQUENCES}, {_KMER_PART}, {_VECTORS},
cand AS (SELECT DISTINCT v.contig_id, v.mag_id FROM votes v JOIN mags USING (mag_id) JOIN agreed a USING (contig_id) WHERE a.distinct_groups > 1),
own AS (SELECT mag_id, contig_id, kmer, v FROM stands JOIN vectors USING (contig_id) WHERE kind = 'core'), centre AS (SELECT mag_id, kmer, avg(v) AS c FROM own GROUP BY ALL),
away AS (SELECT mag_id, contig_id, sqrt(sum((v - c) ** 2)) AS dist FROM own JOIN centre USING (mag_id, kmer) GROUP BY ALL),
spread AS (SELECT mag_id, avg(dist) AS m, stddev_pop(dist) AS s, count(*) AS n FROM away GROUP BY mag_id),
asked AS (SELECT c.contig_id, c.mag_id, sqrt(sum((v - e.c) ** 2)) AS dist FROM cand c JOIN vectors x USING (contig_id) JOIN centre e ON e.mag_id = c.mag_id AND e.kmer = x.kmer GROUP BY ALL)
SELECT c.contig_id, c.mag_id, round(CASE WHEN coalesce(n, 0) < 2 THEN NULL WHEN s < 1e-12 THEN 0 ELSE (dist - m) / s END, 4) AS z FROM cand c LEFT JOIN asked a USING (contig_id, mag_id) LEFT JOIN spread USING (mag_id)""")
def composition_z(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    rows = d.sequences(spark, sf).select("contig_id", udfs.contig_stats("seq")["composition"].alias("composition"))
    out = evidence.composition_z(_pairs(spark, sf, rec), rec.standing, rows)
    return out.withColumn("z", F.round("z", 4))


_OUTLIERS = f"""{d.SEQUENCES}, {d.ASSIGNMENTS}, {_KMER_PART}, {_VECTORS}, coverage AS (SELECT 'contig_' || doc_id AS contig_id, n_chars / 1000::DOUBLE AS mean_depth FROM documents),
bin_members AS (SELECT DISTINCT bin_id, contig_id FROM assignments JOIN seqs USING (contig_id) WHERE tool = 'A'),
bin_vectors AS (SELECT bin_id, contig_id, kmer, v FROM bin_members JOIN vectors USING (contig_id)),
bin_centres AS (SELECT bin_id, kmer, avg(v) AS c FROM bin_vectors GROUP BY ALL),
away AS (SELECT bin_id, contig_id, sqrt(sum((v - c) ** 2)) AS dist FROM bin_vectors JOIN bin_centres USING (bin_id, kmer) GROUP BY ALL),
placed AS (SELECT away.*, mean_depth FROM away LEFT JOIN coverage USING (contig_id)),
spread AS (SELECT bin_id, avg(dist) AS m, stddev_pop(dist) AS s, avg(mean_depth) AS cm, stddev_pop(mean_depth) AS cs, count(mean_depth) = count(*) AS covered, count(*) AS n FROM placed GROUP BY bin_id),
outliers AS (SELECT bin_id, contig_id, CASE WHEN n < 2 THEN NULL WHEN s < 1e-12 THEN 0 ELSE (dist - m) / s END AS composition_z,
  CASE WHEN NOT covered OR n < 2 THEN NULL WHEN cs < 1e-12 THEN 0 ELSE abs(mean_depth - cm) / cs END AS coverage_z FROM placed JOIN spread USING (bin_id))"""


def _outliers(spark, sf):
    rows = d.sequences(spark, sf).select("contig_id", udfs.contig_stats("seq")["composition"].alias("composition"))
    docs = d.table(spark, sf, "documents")  # n_chars is told as depth, so that all contigs have one
    depths = docs.select(F.col("doc_id").alias("row_idx"), F.concat(F.lit("contig_"), "doc_id").alias("contig_id"), F.array(F.col("n_chars") / 1000).alias("depths"))
    return evidence.outliers(_tool_a(spark, sf), evidence.coverage_attached(checkpointed(rows), depths))


@query(f"""WITH {_OUTLIERS} SELECT bin_id, contig_id, round(composition_z, 4) AS composition_z, round(coverage_z, 4) AS coverage_z, round(greatest(composition_z, coverage_z), 4) AS z FROM outliers""")
def contig_outliers(spark, sf):
    return _outliers(spark, sf).withColumns({c: F.round(c, 4) for c in ("composition_z", "coverage_z", "z")})


@query(f"""WITH {d.CONTIGS}, {d.ASSIGNMENTS}, {_KMER_PART}, {_VECTORS}, bin_members AS (SELECT DISTINCT bin_id, contig_id FROM assignments JOIN seqs USING (contig_id) WHERE tool = 'A'),
bin_centres AS (SELECT bin_id, kmer, avg(v) AS v FROM bin_members JOIN vectors USING (contig_id) GROUP BY ALL),
bin_gc AS (SELECT bin_id, avg(gc_content) AS gc FROM bin_members JOIN contigs USING (contig_id) GROUP BY bin_id),
far AS (SELECT a.bin_id AS bin_a, b.bin_id AS bin_b, sqrt(sum((a.v - b.v) ** 2)) AS distance FROM bin_centres a JOIN bin_centres b ON a.kmer = b.kmer AND a.bin_id < b.bin_id GROUP BY ALL)
SELECT bin_a, bin_b, round(distance, 6) AS distance, round(abs(x.gc - y.gc), 6) AS gc_diff FROM far JOIN bin_gc x ON x.bin_id = bin_a JOIN bin_gc y ON y.bin_id = bin_b WHERE distance <= 0.02 AND abs(x.gc - y.gc) <= 0.02""")
def similar_bins(spark, sf):
    s = udfs.contig_stats("seq")
    rows = d.sequences(spark, sf).select("contig_id", s["composition"].alias("composition"), s["gc_content"].alias("gc_content"))
    out = evidence.similar_bins(_tool_a(spark, sf), checkpointed(rows))
    return out.withColumns({"distance": r6("distance"), "gc_diff": r6("gc_diff")})


_LEAVES = f"""{d.STATE}, contested AS (SELECT contig_id FROM agreed WHERE distinct_groups > 1), known AS (SELECT DISTINCT contig_id, mag_id FROM votes WHERE mag_id IN (SELECT mag_id FROM mags)),
weights AS (SELECT a.mag_id, v.mag_id AS rival, count(*) AS weight FROM known a JOIN contested USING (contig_id) JOIN (SELECT contig_id, mag_id FROM votes WHERE mag_id IN (SELECT mag_id FROM mags)) v USING (contig_id) WHERE a.mag_id <> v.mag_id GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY mag_id ORDER BY weight DESC, rival) AS place FROM weights),
shown AS (SELECT mag_id, rival AS hub FROM placed WHERE place <= 40 UNION ALL SELECT mag_id, mag_id FROM mags),
linked AS (SELECT a.mag_id, a.contig_id, count(*) AS n_hubs FROM known a JOIN (SELECT DISTINCT contig_id, mag_id AS hub FROM votes) h USING (contig_id) JOIN shown s ON s.mag_id = a.mag_id AND s.hub = h.hub GROUP BY ALL),
leaves AS (SELECT l.mag_id, l.contig_id, n_hubs, CASE WHEN n_hubs = 1 THEN 'core' WHEN t.bin_id IS NULL THEN 'tied' WHEN t.bin_id = 'excluded' THEN 'excluded' WHEN t.bin_id = l.mag_id THEN 'held-here' ELSE 'held-elsewhere' END AS state
  FROM linked l JOIN contested USING (contig_id) LEFT JOIN state t USING (contig_id) WHERE n_hubs > 1)"""


@query(f"WITH RECURSIVE {_LEAVES} SELECT mag_id, contig_id, state, n_hubs FROM leaves")
def mag_neighbourhood(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    return network.leaves(rec.votes, rec.mags, rec.agreement, _state(spark, sf, rec))


@query(f"WITH RECURSIVE {_LEAVES} SELECT mag_id, rival, weight, place::INT AS place FROM placed")
def mag_rivals(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    return network.rivals(rec.votes, rec.mags, rec.agreement)


_NETWORK = f"""{_LEAVES}, top AS (SELECT mag_id, contig_id FROM (SELECT l.mag_id, l.contig_id, row_number() OVER (PARTITION BY l.mag_id ORDER BY l.contig_id) AS k
  FROM linked l JOIN agreed a USING (contig_id) WHERE a.distinct_groups = 1 OR l.n_hubs > 1) WHERE k <= 300),
lh AS (SELECT DISTINCT l.mag_id, l.contig_id, h.hub FROM top l JOIN (SELECT DISTINCT contig_id, mag_id AS hub FROM votes) h USING (contig_id) JOIN shown s ON s.mag_id = l.mag_id AND s.hub = h.hub)"""


def _network(spark, sf):
    """Leaves in any state, edges and hubs around each MAG."""
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    shown = network.limited(network.leaves(rec.votes, rec.mags, rec.agreement, _state(spark, sf, rec), network.View(uncontended=True)))
    return shown, network.edges(shown, rec.votes, rec.mags), network.hubs(rec.votes, rec.mags, rec.agreement)


@query(f"""WITH RECURSIVE {_NETWORK}, sec AS (SELECT mag_id, hub, 2 * pi() * (row_number() OVER (PARTITION BY mag_id ORDER BY hub) - 1) / count(*) OVER (PARTITION BY mag_id) - pi() / 2 AS middle,
  2 * pi() / count(*) OVER (PARTITION BY mag_id) AS sector FROM shown WHERE hub <> mag_id),
own AS (SELECT mag_id, contig_id, count(*) AS n, min(hub) FILTER (WHERE hub <> mag_id) AS hub FROM lh GROUP BY ALL),
fan AS (SELECT *, count(*) OVER w AS many, row_number() OVER (w ORDER BY contig_id) - 1 AS i FROM own LEFT JOIN sec USING (mag_id, hub) WINDOW w AS (PARTITION BY mag_id, hub, n > 1)),
placed_leaves AS (SELECT mag_id, contig_id, CASE WHEN hub IS NULL THEN 2 * pi() * i / many - pi() / 2
  ELSE middle + (CASE WHEN many = 1 THEN 0.5 ELSE i / (many - 1)::DOUBLE END - 0.5) * sector * CASE WHEN n > 1 THEN 0.8 ELSE 0.5 END END AS angle,
  168 * CASE WHEN hub IS NULL THEN 0.18 WHEN n > 1 THEN 0.55 ELSE 0.85 END AS r FROM fan)
SELECT mag_id, contig_id, round(200 + r * cos(angle), 4) AS x, round(200 + r * sin(angle), 4) AS y FROM placed_leaves""")
def ring_layout(spark, sf):
    return network.layout("ring", *_network(spark, sf)).withColumns({c: F.round(c, 4) for c in "xy"})


@query(f"""WITH RECURSIVE {_NETWORK}, inner_ring AS (SELECT mag_id, hub, 2 * pi() * (row_number() OVER (PARTITION BY mag_id ORDER BY hub) - 1) / count(*) OVER (PARTITION BY mag_id) - pi() / 2 AS middle,
  2 * pi() / count(*) OVER (PARTITION BY mag_id) * 0.8 AS span FROM shown),
own AS (SELECT mag_id, contig_id, min(hub) AS hub FROM lh GROUP BY ALL),
fan AS (SELECT *, count(*) OVER w AS many, row_number() OVER (w ORDER BY contig_id) - 1 AS i FROM own JOIN inner_ring USING (mag_id, hub) WINDOW w AS (PARTITION BY mag_id, hub)),
placed_leaves AS (SELECT mag_id, contig_id, middle + (CASE WHEN many = 1 THEN 0.5 ELSE i / (many - 1)::DOUBLE END - 0.5) * span AS angle FROM fan)
SELECT mag_id, contig_id, round(200 + 168 * cos(angle), 4) AS x, round(200 + 168 * sin(angle), 4) AS y FROM placed_leaves""")
def petal_layout(spark, sf):
    return network.layout("petal", *_network(spark, sf)).withColumns({c: F.round(c, 4) for c in "xy"})


_VIEWS = "views AS (SELECT u AS uncontended, r AS resolved, c AS connected FROM (VALUES (true), (false)) a(u), (VALUES (true), (false)) b(r), (VALUES (true), (false)) d(c))"
_AROUND = f"""{_LEAVES.replace("place <= 40", "place <= 2")}, {_VIEWS},
held AS (SELECT s.mag_id, h.contig_id, count(*) AS n_hubs, count(*) FILTER (WHERE s.hub = s.mag_id) AS own, count(*) FILTER (WHERE s.hub <> s.mag_id) AS others
  FROM shown s JOIN (SELECT DISTINCT contig_id, mag_id AS hub FROM votes) h USING (hub) GROUP BY ALL),
told AS (SELECT held.*, t.bin_id, distinct_groups FROM held JOIN agreed USING (contig_id) LEFT JOIN state t USING (contig_id)),
seen AS (SELECT *, own > 0 AND CASE WHEN distinct_groups <= 1 THEN uncontended WHEN n_hubs = 1 THEN false WHEN bin_id IS NULL THEN true ELSE resolved END AS is_own FROM told, views)"""
_VIEW_COLUMNS = ("uncontended", "resolved", "connected")


def _in_all_views(spark, sf, per_view):
    """What ``per_view(around, rivals, mags, view)`` gives for each set of toggles, with two hubs at most."""
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    found = checkpointed(network.around(rec.votes, rec.mags, rec.agreement, _state(spark, sf, rec), 2))
    contenders = checkpointed(network.rivals(rec.votes, rec.mags, rec.agreement))
    parts = []
    for flags in product((True, False), repeat=3):
        rows = per_view(found, contenders, rec.mags, network.View(*flags))
        parts.append(rows.withColumns({c: F.lit(f) for c, f in zip(_VIEW_COLUMNS, flags, strict=True)}))
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH RECURSIVE {_AROUND} SELECT uncontended, resolved, connected, mag_id, contig_id, n_hubs, CASE WHEN n_hubs = 1 THEN 'core' WHEN bin_id IS NULL THEN 'tied' WHEN bin_id = 'excluded' THEN 'excluded'
  WHEN bin_id = mag_id THEN 'held-here' ELSE 'held-elsewhere' END AS state FROM seen WHERE is_own OR (connected AND others > 0)""")
def neighbourhood_views(spark, sf):
    return _in_all_views(spark, sf, lambda found, _, __, view: network.viewed(found, view))


@query(f"""WITH RECURSIVE {_AROUND}, shown_leaves AS (SELECT *, row_number() OVER (PARTITION BY uncontended, resolved, connected, mag_id ORDER BY contig_id) AS k FROM seen WHERE is_own OR (connected AND others > 0)),
counted AS (SELECT uncontended, resolved, connected, mag_id, count(*) AS n, count(*) FILTER (WHERE k <= 50 AND n_hubs > 1 AND bin_id IS NULL) AS tied FROM shown_leaves GROUP BY ALL),
lost AS (SELECT uncontended, resolved, connected, mag_id, count(*) FILTER (WHERE own > 0 AND distinct_groups <= 1 AND NOT uncontended) AS hidden_uncontended, count(*) FILTER (WHERE own > 0 AND distinct_groups > 1 AND n_hubs = 1) AS hidden_low_relevance,
  count(*) FILTER (WHERE own > 0 AND distinct_groups > 1 AND n_hubs > 1 AND bin_id IS NOT NULL AND NOT resolved) AS hidden_resolved, coalesce(sum(others) FILTER (WHERE NOT is_own AND NOT connected), 0)::BIGINT AS hidden_connected FROM seen GROUP BY ALL),
r AS (SELECT mag_id, count(*) AS n FROM placed GROUP BY mag_id)
SELECT v.uncontended, v.resolved, v.connected, m.mag_id, least(coalesce(r.n, 0), 2)::BIGINT AS hubs, coalesce(r.n, 0)::BIGINT AS all_hubs, greatest(coalesce(r.n, 0) - 2, 0)::BIGINT AS hidden_hubs, least(coalesce(counted.n, 0), 50)::BIGINT AS leaves,
  coalesce(counted.n, 0)::BIGINT AS all_leaves, coalesce(counted.n, 0) > 50 AS truncated, coalesce(counted.tied, 0)::BIGINT AS tied, coalesce(hidden_uncontended, 0)::BIGINT AS hidden_uncontended, coalesce(hidden_low_relevance, 0)::BIGINT AS hidden_low_relevance,
  coalesce(hidden_resolved, 0)::BIGINT AS hidden_resolved, coalesce(hidden_connected, 0)::BIGINT AS hidden_connected
FROM mags m CROSS JOIN views v LEFT JOIN r USING (mag_id) LEFT JOIN counted USING (uncontended, resolved, connected, mag_id) LEFT JOIN lost USING (uncontended, resolved, connected, mag_id)""")
def neighbourhood_totals(spark, sf):
    return _in_all_views(spark, sf, lambda found, contenders, mags, view: network.view_totals(found, contenders, mags, view, 2, 50))


@query(f"""WITH RECURSIVE {_LEAVES}, every AS (SELECT mag_id, count(*) AS n FROM linked JOIN agreed a USING (contig_id) WHERE a.distinct_groups = 1 OR n_hubs > 1 GROUP BY mag_id), r AS (SELECT mag_id, count(*) AS n FROM placed GROUP BY mag_id)
SELECT mag_id, greatest(coalesce(r.n, 0) - 1, 0)::BIGINT AS hidden_hubs, greatest(coalesce(every.n, 0) - 30, 0)::BIGINT AS hidden_leaves FROM mags LEFT JOIN r USING (mag_id) LEFT JOIN every USING (mag_id)""")
def hidden_counts(spark, sf):
    rec = reconcile.Reconciliation(d.assignments(spark, sf))
    rows = network.leaves(rec.votes, rec.mags, rec.agreement, _state(spark, sf, rec), network.View(uncontended=True))
    return network.hidden_counts(network.rivals(rec.votes, rec.mags, rec.agreement), rows, rec.mags, 1, 30)


@query(f"WITH {d.CONTIGS}, {d.COVERAGE} SELECT c.contig_id, length, round(mean_depth, 6) AS mean_depth FROM contigs c LEFT JOIN coverage USING (contig_id)")
def coverage_attach(spark, sf):
    rows = evidence.coverage_attached(d.contigs(spark, sf), d.coverage(spark, sf))
    return rows.select("contig_id", "length", r6("mean_depth", "mean_depth"))


@query(f"""WITH {d.ASSIGNMENTS}, l AS (SELECT 'contig_' || doc_id AS contig_id, lang AS label FROM documents), r AS (SELECT bin_id, contig_id, label FROM assignments JOIN l USING (contig_id) WHERE tool = 'A'),
top AS (SELECT bin_id, label AS majority FROM (SELECT bin_id, label, row_number() OVER (PARTITION BY bin_id ORDER BY count(*) DESC, label) AS k FROM r GROUP BY bin_id, label) WHERE k = 1)
SELECT r.bin_id, contig_id, label, majority FROM r JOIN top USING (bin_id) WHERE label <> majority""")
def taxon_mismatch(spark, sf):
    labels = d.table(spark, sf, "documents").select(F.concat(F.lit("contig_"), "doc_id").alias("contig_id"), F.col("lang").alias("label"))
    return evidence.majority_mismatch(_tool_a(spark, sf), labels)


@query(f"""WITH {_OUTLIERS}, l AS (SELECT 'contig_' || doc_id AS contig_id, lang AS label FROM documents), r AS (SELECT bin_id, contig_id, label FROM bin_members JOIN l USING (contig_id)),
top AS (SELECT bin_id, label AS majority FROM (SELECT bin_id, label, row_number() OVER (PARTITION BY bin_id ORDER BY count(*) DESC, label) AS k FROM r GROUP BY bin_id, label) WHERE k = 1)
SELECT bin_id, contig_id, count(*) AS flags FROM (SELECT bin_id, contig_id FROM outliers WHERE composition_z > 2 UNION ALL SELECT bin_id, contig_id FROM outliers WHERE coverage_z > 2
  UNION ALL SELECT bin_id, contig_id FROM r JOIN top USING (bin_id) WHERE label <> majority) GROUP BY ALL""")
def contig_flags(spark, sf):
    return evidence.flag_counts(_outliers(spark, sf), taxon_mismatch(spark, sf)).withColumn("flags", F.col("flags").cast("long"))


# Marker search: the benchmark's passages are the references


def _refs(spark, sf):
    rows = d.table(spark, sf, "benchmark")
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    seq = sequence.translate_frame(F.translate(letters, d.LETTERS, d.BASES), 0)
    return rows.select(F.col("item_id").alias("ref_id"), F.concat(F.lit("COG"), F.lpad((F.col("item_id") % 40).cast("string"), 4, "0")).alias("family"), F.col("item_id").alias("tax_id"), F.regexp_replace(seq, r"\*", "X").alias("residues")).withColumn("len", F.length("residues"))


_REFS = f"""refseqs AS (SELECT item_id AS ref_id, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{d.LETTERS}', '{d.BASES}') AS s FROM benchmark),
refaa AS (SELECT ref_id, string_agg(coalesce(CASE amino WHEN '*' THEN 'X' ELSE amino END, 'X'), '' ORDER BY k) AS aa FROM (
  SELECT ref_id, k, substr(s, 3 * k + 1, 3) AS codon FROM (SELECT *, unnest(range(0, length(s) // 3)) AS k FROM refseqs)) LEFT JOIN codons USING (codon) GROUP BY ref_id),
refseg AS (SELECT ref_id, s, sum(length(s) + 1) OVER (PARTITION BY ref_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(s) - 1 AS off FROM (SELECT ref_id, unnest(string_split(aa, 'X')) AS s, generate_subscripts(string_split(aa, 'X'), 1) AS i FROM refaa)),
refhits AS (SELECT ref_id, (off + p)::INT AS ref_pos, translate(substr(s, p + 1, 9), '{_GROUPS}', '{_DIGITS}')::BIGINT AS code FROM (SELECT *, unnest(range(0, length(s) - 8)) AS p FROM refseg WHERE length(s) >= 9))"""
_THINNED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ref_id, ref_pos) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM refhits),
picks AS (SELECT DISTINCT code, floor(j * (n / {most}::DOUBLE))::BIGINT AS i FROM (SELECT DISTINCT code, n FROM numbered WHERE n > {most}), range({most}) t(j)),
kept AS (SELECT code, ref_id, ref_pos FROM numbered WHERE n >= {least} AND (n <= {most} OR (code, i) IN (SELECT (code, i) FROM picks)))"""
_DIAGONALS = f"""{_SEEDS}, {_REFS}, {_THINNED.format(least=1, most=2)},
diagonals AS (SELECT contig_id, frame, ref_id, frame_pos - ref_pos AS diagonal, count(*) AS n, min(frame_pos) AS frame_pos FROM seeds JOIN kept USING (code) GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {_FRAMES}, {_REFS}, {_THINNED.format(least=2, most=3)} SELECT code, ref_id, ref_pos FROM kept")
def seed_index(spark, sf):
    return markers.seed_index(_refs(spark, sf), min_hits=2, max_hits=3)


@query(f"WITH {_DIAGONALS} SELECT contig_id, frame, ref_id, diagonal, n, frame_pos FROM diagonals")
def diagonal_two_hit(spark, sf):
    refs = _refs(spark, sf)
    frames = markers.frames_of(d.sequences(spark, sf))
    return markers.diagonals(markers.seeds(frames), markers.seed_index(refs, min_hits=1, max_hits=2))


_AMINO = "ARNDCQEGHILKMFPSTWYVX*"
_BLOSUM = ", ".join(f"('{a}', '{b}', {int(kernels.scores()[ord(a), ord(b)])})" for a in _AMINO for b in _AMINO)
# To both sides of the anchor: running sums, where they first fall too far below their best, and the best before that.
_EXTENDED = f"""{_SEEDS}, {_REFS}, {_THINNED.format(least=1, most=20)},
diagonals AS (SELECT contig_id, frame, ref_id, frame_pos - ref_pos AS diagonal, min(frame_pos) AS frame_pos FROM seeds JOIN kept USING (code) GROUP BY ALL HAVING count(*) >= 2),
blosum(a, b, s) AS (VALUES {_BLOSUM}),
sides AS (SELECT d.*, f.aa AS q, r.aa AS ref, length(r.aa) AS len, frame_pos - diagonal AS ref_pos FROM diagonals d JOIN frames f USING (contig_id, frame) JOIN refaa r USING (ref_id)),
walk AS (
  SELECT *, 1 AS way FROM (SELECT *, unnest(range(0, least(length(q) - frame_pos, len - ref_pos))) AS i FROM sides)
  UNION ALL SELECT *, -1 FROM (SELECT *, unnest(range(1, least(frame_pos, ref_pos) + 1)) AS i FROM sides)
), scored AS (SELECT w.contig_id, w.frame, w.ref_id, w.diagonal, w.way, w.i, b.s FROM walk w JOIN blosum b ON b.a = substr(q, frame_pos + 1 + way * i, 1) AND b.b = substr(ref, ref_pos + 1 + way * i, 1)),
runs AS (SELECT *, sum(s) OVER (PARTITION BY contig_id, frame, ref_id, diagonal, way ORDER BY i) AS run FROM scored),
tops AS (SELECT *, greatest(max(run) OVER (PARTITION BY contig_id, frame, ref_id, diagonal, way ORDER BY i), CASE way WHEN -1 THEN 0 ELSE run END) AS top FROM runs),
stops AS (SELECT contig_id, frame, ref_id, diagonal, way, min(i) FILTER (WHERE top - run > 15) AS stop FROM tops GROUP BY ALL),
bests AS (SELECT contig_id, frame, ref_id, diagonal, way, i, run FROM tops JOIN stops USING (contig_id, frame, ref_id, diagonal, way) WHERE (stop IS NULL OR i < stop) AND (way = 1 OR run > 0)
  QUALIFY row_number() OVER (PARTITION BY contig_id, frame, ref_id, diagonal, way ORDER BY run DESC, i) = 1),
grown AS (SELECT s.contig_id, s.ref_id, s.frame, s.len, s.frame_pos, s.diagonal, x.run + coalesce(y.run, 0) AS score, x.i + 1 + coalesce(y.i, 0) AS aligned FROM sides s
  JOIN bests x ON x.way = 1 AND (x.contig_id, x.frame, x.ref_id, x.diagonal) = (s.contig_id, s.frame, s.ref_id, s.diagonal)
  LEFT JOIN bests y ON y.way = -1 AND (y.contig_id, y.frame, y.ref_id, y.diagonal) = (s.contig_id, s.frame, s.ref_id, s.diagonal)),
extended AS (SELECT contig_id, ref_id, 'COG' || lpad((ref_id % 40)::VARCHAR, 4, '0') AS family, ref_id AS tax_id, score::INT AS score, aligned / len::DOUBLE AS coverage, frame FROM grown
  QUALIFY row_number() OVER (PARTITION BY contig_id, ref_id ORDER BY score DESC, frame, frame_pos, diagonal) = 1)"""
# Of extended(contig_id, family, ref_id, tax_id, score, coverage) and own(family, min_score, min_coverage, min_margin, min_representatives).
_CALLED = """ok AS (SELECT e.*, coalesce(min_margin, {margin}) AS margin, coalesce(min_representatives, {least}) AS least FROM extended e LEFT JOIN own USING (family)
  WHERE score >= coalesce(min_score, 50) AND coverage >= coalesce(min_coverage, 0.3)),
fam AS (SELECT contig_id, family, count(*) AS representatives, max(score) AS score, arg_max(tax_id, (score, -ref_id)) AS tax_id, any_value(margin) AS margin, any_value(least) AS least FROM ok GROUP BY ALL),
called AS (SELECT f.contig_id, f.family, f.representatives, f.score, f.tax_id FROM fam f
  WHERE f.representatives >= f.least AND f.score - greatest(0, coalesce((SELECT max(o.score) FROM fam o WHERE o.contig_id = f.contig_id AND o.family <> f.family), 0)) >= f.margin)"""


@query(f"WITH {_EXTENDED} SELECT contig_id, ref_id, family, tax_id, score, coverage, frame FROM extended")
def marker_extensions(spark, sf):
    refs = _refs(spark, sf)
    return markers.extended(d.sequences(spark, sf), refs, markers.seed_index(refs, min_hits=1))


@query(f"""WITH {_EXTENDED}, own AS (SELECT NULL::VARCHAR AS family, NULL::DOUBLE AS min_score, NULL::DOUBLE AS min_coverage, NULL::DOUBLE AS min_margin, NULL::INT AS min_representatives WHERE false),
{_CALLED.format(margin=10, least=1)} SELECT contig_id, family, representatives, score, tax_id FROM called""")
def marker_calls(spark, sf):
    refs = _refs(spark, sf)
    return markers.search(d.sequences(spark, sf), refs, markers.seed_index(refs, min_hits=1), markers.Search(min_representatives=1))


@query(f"""WITH extended AS (SELECT l_orderkey AS contig_id, 'COG' || (l_suppkey % 40) AS family, l_linenumber AS ref_id, l_partkey AS tax_id, (l_quantity * 3)::INT AS score, l_discount * 10 AS coverage FROM lineitem),
own AS (SELECT 'COG' || n_nationkey AS family, CASE WHEN n_nationkey % 3 = 0 THEN 20.0 + n_nationkey END AS min_score, CASE WHEN n_nationkey % 4 = 0 THEN 0.1 END AS min_coverage,
  CASE WHEN n_nationkey % 5 < 2 THEN n_nationkey::DOUBLE END AS min_margin, CASE WHEN n_nationkey % 2 = 0 THEN 1 END AS min_representatives FROM nation),
{_CALLED.format(margin=10, least=2)} SELECT contig_id, family, representatives, score, tax_id FROM called""")
def calls_by_family(spark, sf):
    """Calls among given extensions, with a table of what families have of their own."""
    rows = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("contig_id"), F.concat(F.lit("COG"), F.col("l_suppkey") % 40).alias("family"), F.col("l_linenumber").alias("ref_id"), F.col("l_partkey").alias("tax_id"),
        (F.col("l_quantity") * 3).cast("int").alias("score"), (F.col("l_discount") * 10).alias("coverage"),
        # Orders repeat line numbers: of equal rows the table's first counts.
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    k = F.col("n_nationkey")
    own = d.table(spark, sf, "nation").select(
        F.concat(F.lit("COG"), k).alias("family"), F.when(k % 3 == 0, k + 20.0).alias("min_score"), F.when(k % 4 == 0, 0.1).alias("min_coverage"),
        F.when(k % 5 < 2, k.cast("double")).alias("min_margin"), F.when(k % 2 == 0, 1).alias("min_representatives"),
    )
    return markers.calls(rows, markers.Search(), own, ("file", "row"))


@query("""WITH r AS (SELECT 'COG' || (l_suppkey % 40) AS family, list_sort(list(l_linenumber)) AS reps, list_sort(list(l_quantity::INT)) AS gaps, count(*) AS n FROM lineitem GROUP BY ALL),
v AS (SELECT family, greatest(1, floor(reps[least(n - 1, floor(n * 0.1)::BIGINT) + 1] * 0.8))::BIGINT AS r, greatest(0, floor(gaps[least(n - 1, floor(n * 0.1)::BIGINT) + 1] * 0.8))::BIGINT AS m FROM r)
SELECT family, CASE WHEN r < 2 THEN r END AS min_representatives, CASE WHEN m < 10 THEN m END AS min_margin FROM v WHERE r < 2 OR m < 10""")
def calibration(spark, sf):
    rows = d.table(spark, sf, "lineitem").select(F.concat(F.lit("COG"), F.col("l_suppkey") % 40).alias("family"), F.col("l_linenumber").alias("representatives"), F.col("l_quantity").cast("int").alias("margin"))
    found = markers.calibration(rows)
    return found.select("family", F.col("min_representatives").cast("long"), F.col("min_margin").cast("long"))


_NAMED = "ARNDCQEGHILKMFPSTWYVARNDCQ"
_SCORE_LIST = ", ".join(str(int(kernels.scores()[ord(a), ord(b)])) for a in _AMINO for b in _AMINO)


@query(f"""WITH RECURSIVE texts AS (SELECT p_partkey, translate(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '{d.LETTERS}', '{_NAMED}') AS q, translate(upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')), '{d.LETTERS}', '{_NAMED}') AS r FROM part),
s AS (SELECT [{_SCORE_LIST}] AS s),
sides AS (SELECT p_partkey, 1 AS way, substr(q, 3) AS q, substr(r, 4) AS r FROM texts UNION ALL SELECT p_partkey, -1, reverse(substr(q, 1, 1)), reverse(substr(r, 1, 2)) FROM texts),
rows_ AS (
  SELECT p_partkey, way, q, r, 0 AS i, list_transform(range(1, 8), lambda k: CASE WHEN k = 4 THEN 0 ELSE -1000000000 END) AS row_, 0 AS best, 0 AS taken, length(q) > 0 AS go FROM sides
  UNION ALL
  SELECT p_partkey, way, q, r, i, cell, greatest(best, list_max(cell)), CASE WHEN list_max(cell) > best THEN i + list_position(cell, list_max(cell)) - 4 ELSE taken END, list_max(cell) >= greatest(best, list_max(cell)) - 15 AND i < length(q)
  FROM (SELECT p_partkey, way, q, r, i, best, taken, list_transform(range(1, 8), lambda k: CASE WHEN i + k - 4 BETWEEN 0 AND length(r) THEN list_max(list_transform(range(1, k + 1), lambda h: base[h] - 8 * (k - h))) ELSE -1000000000 END) AS cell
    FROM (SELECT p_partkey, way, q, r, w.i + 1 AS i, best, taken, list_transform(range(1, 8), lambda k: CASE WHEN w.i + k - 3 BETWEEN 0 AND length(r) THEN greatest(
        CASE WHEN w.i + k - 3 >= 1 THEN row_[k] + s.s[22 * (instr('{_AMINO}', substr(q, (w.i + 1)::BIGINT, 1)) - 1) + instr('{_AMINO}', substr(r, (w.i + k - 3)::BIGINT, 1))] ELSE -1000000000 END,
        coalesce(row_[k + 1], -1000000000) - 8) ELSE -1000000000 END) AS base FROM rows_ w, s WHERE go))
), last AS (SELECT p_partkey, way, arg_max(best, i) AS best, arg_max(taken, i) AS taken FROM rows_ GROUP BY ALL)
SELECT p_partkey, (s.s[22 * (instr('{_AMINO}', substr(q, 2, 1)) - 1) + instr('{_AMINO}', substr(r, 3, 1))] + a.best + b.best)::INT AS score, (1 + a.taken + b.taken)::INT AS aligned
FROM texts JOIN last a USING (p_partkey) JOIN last b USING (p_partkey), s WHERE a.way = 1 AND b.way = -1""")
def gapped_extensions(spark, sf):
    """Names of parts aligned with their types, anchored at the second and third letter, with gaps in a narrow band."""
    told = lambda c: F.translate(F.upper(F.regexp_replace(c, "[^A-Za-z]", "")), d.LETTERS, _NAMED)
    rows = d.spread(d.table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "p_partkey")
    ext = udfs.extend_gapped(told("p_name"), told("p_type"), F.lit(1), F.lit(2), F.lit(15), F.lit(8), F.lit(3))
    return rows.select("p_partkey", ext.alias("e")).select("p_partkey", "e.score", "e.aligned")


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
picks AS (SELECT DISTINCT l_suppkey, floor(j * (n / 20::DOUBLE))::BIGINT AS i FROM (SELECT DISTINCT l_suppkey, n FROM r WHERE n > 20), range(20) t(j))
SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE n >= 3 AND (n <= 20 OR (l_suppkey, i) IN (SELECT (l_suppkey, i) FROM picks))""")
def index_key_cap(spark, sf):
    rows = d.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return markers.thinned(rows, "l_suppkey", ("l_orderkey", "l_linenumber"), 3, 20)


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
picks AS (SELECT DISTINCT l_suppkey, floor(j * (n / 150::DOUBLE))::BIGINT AS i FROM (SELECT DISTINCT l_suppkey, n FROM r WHERE n > 150), range(150) t(j))
SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE n <= 150 OR (l_suppkey, i) IN (SELECT (l_suppkey, i) FROM picks)""")
def even_sample(spark, sf):
    rows = d.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return markers.even_sample(rows, "l_suppkey", ("l_orderkey", "l_linenumber"), 150)


@query("""WITH r AS (SELECT l_partkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
SELECT l_partkey, v AS l_extendedprice FROM r WHERE i = least(n - 1, floor(n * 0.1))""")
def percentile_floor(spark, sf):
    return markers.percentile_floor(d.table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice", 0.1)


def _proteins(spark, sf):
    rows = d.table(spark, sf, "part")
    return rows.select(F.col("p_brand").alias("family"), F.col("p_partkey").cast("string").alias("header"), F.concat("p_name", F.lit(" "), "p_type").alias("seq"))


# Signatures by a fold over the letters, similar pairs, and the greedy choice record by record.
_CLUSTERS = """recs AS (SELECT p_brand AS family, p_partkey::VARCHAR AS header, p_name || ' ' || p_type AS seq FROM part),
ordered AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY length(seq) DESC, header) AS i FROM recs),
kmers AS (SELECT DISTINCT family, i, substr(seq, p, 5) AS k FROM (SELECT *, unnest(range(1, length(seq) - 3)) AS p FROM ordered WHERE length(seq) >= 5)),
words AS (SELECT DISTINCT k FROM kmers),
hashed AS (SELECT k, h, list_reduce(list_prepend(xor(2166136261, (h * 2654435761) % 4294967296)::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296) AS v
  FROM words, range(24) t(h)),
sig AS (SELECT family, i, h, min(v) AS v FROM kmers JOIN hashed USING (k) GROUP BY ALL),
pairs AS (SELECT b.family, b.i, a.i AS j FROM sig a JOIN sig b ON a.family = b.family AND a.h = b.h AND a.v = b.v AND a.i < b.i GROUP BY ALL HAVING count(*) >= 12),
near AS (SELECT family, i, list(j ORDER BY j) AS near FROM pairs GROUP BY ALL),
steps AS (
  SELECT family, 1::BIGINT AS i, [1::BIGINT] AS reps, 1::BIGINT AS rep FROM ordered WHERE i = 1
  UNION ALL SELECT s.family, s.i + 1, CASE WHEN m.r IS NULL THEN list_append(s.reps, s.i + 1) ELSE s.reps END, coalesce(m.r, s.i + 1)
  FROM steps s JOIN ordered o ON o.family = s.family AND o.i = s.i + 1 LEFT JOIN near n ON n.family = o.family AND n.i = o.i,
  LATERAL (SELECT list_filter(coalesce(n.near, []), lambda x: list_contains(s.reps, x))[1] AS r) m
), clustered AS (SELECT o.family, o.header, r.header AS representative FROM steps s JOIN ordered o USING (family, i) JOIN ordered r ON r.family = s.family AND r.i = s.rep)"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT family, header, representative FROM clustered")
def minhash_clusters(spark, sf):
    return clusters.greedy_clusters(_proteins(spark, sf))


@query(f"""WITH RECURSIVE {_CLUSTERS} SELECT coalesce(family, 'TOTAL') AS family, count(*) AS originals, count(*) FILTER (WHERE header = representative) AS clusters,
  round(count(*) FILTER (WHERE header = representative) / count(*)::DOUBLE, 6) AS kept FROM clustered GROUP BY ROLLUP (family)""")
def cluster_report(spark, sf):
    return clusters.cluster_report(clusters.greedy_clusters(_proteins(spark, sf))).withColumn("kept", r6("kept"))


# Files and exports


@query("""WITH f AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS len, 60 AS b, CASE WHEN o_orderkey % 2 = 0 THEN 61 ELSE 62 END AS w, o_orderkey % 5 <> 0 AS u FROM orders)
SELECT o_orderkey, CASE WHEN u AND len > 0 THEN len // b * w + CASE WHEN len % b > 0 THEN len % b + w - b ELSE 0 END END AS bytes FROM f""")
def byte_span(spark, sf):
    key = F.col("o_orderkey")
    rows = d.table(spark, sf, "orders")
    length = F.floor("o_totalprice").cast("long")
    return rows.select("o_orderkey", sequence.byte_span(length, F.lit(60), F.when(key % 2 == 0, 61).otherwise(62), key % 5 != 0).alias("bytes"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[",\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def csv_fields(spark, sf):
    return d.table(spark, sf, "conversations").select("conv_id", "turn", text.csv_field(F.col("text")).alias("field"))


@query(f"""WITH {d.SEQUENCES} SELECT contig_id, md5(rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10))) AS digest FROM seqs""")
def wrap_sequence(spark, sf):
    return d.sequences(spark, sf).select("contig_id", F.md5(sequence.wrapped(F.col("seq"))).alias("digest"))


@query(f"""WITH {_BINS} SELECT bin_id, bin_id || ',' || contig_count || ',' || total_length || ',' || n50 || ',' || printf('%.2f', mean_gc * 100) || ',' || printf('%.2f', completeness) || ','
  || printf('%.2f', redundancy) || ',,' || tier AS line FROM tiers""")
def summary_csv(spark, sf):
    return export.summary_lines(_summary(spark, sf))


@query(f"WITH {d.ASSIGNMENTS} SELECT contig_id || ',' || bin_id AS line FROM assignments WHERE tool = 'A'")
def assignment_csv(spark, sf):
    return export.assignment_lines(_tool_a(spark, sf))


def _fasta_texts(spark, sf):
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    return d.documents(spark, sf).select("doc_id", letters.alias("letters"))


def _written_fasta(spark, sf):
    """The tables' letters as FASTA files in the shared folder; their path."""
    path = _new_folder(spark, "fasta")
    value = F.concat(F.lit(">contig_"), "doc_id", F.lit(" made of text\n"), sequence.wrapped(F.col("letters")))
    files = _fasta_texts(spark, sf).select(F.floor(F.col("doc_id") / 500).alias("g"), "doc_id", value.alias("value"))
    files.repartition("g").sortWithinPartitions("g", "doc_id").select("g", "value").write.partitionBy("g").text(path)
    return path


def _new_folder(spark, label):
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("""WITH f AS (SELECT doc_id, doc_id // 500 AS g, 'contig_' || doc_id || ' made of text' AS head, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS n FROM documents),
s AS (SELECT *, length(head) + 3 + n + CASE WHEN n > 0 THEN (n - 1) // 60 ELSE 0 END AS bytes FROM f)
SELECT 'contig_' || doc_id AS contig_id, n::BIGINT AS length, (sum(bytes) OVER (PARTITION BY g ORDER BY doc_id) - bytes + length(head) + 2)::BIGINT AS "offset",
       CASE WHEN n > 0 THEN least(n, 60)::BIGINT END AS line_bases, CASE WHEN n > 0 THEN least(n, 60)::BIGINT + 1 END AS line_width FROM s""")
def fasta_index(spark, sf):
    """The tables' letters as FASTA files, written and scanned by their bytes."""
    path = _written_fasta(spark, sf)
    rows = fasta.read_fasta(spark, f"{path}/g=*")
    return rows.select(F.col("id").alias("contig_id"), "fai.length", "fai.offset", "fai.line_bases", "fai.line_width")


@query("""SELECT 'contig_' || doc_id AS contig_id, length(s) AS length, length(s) > 0 AS spanned, md5(s) AS digest FROM (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS s FROM documents)""")
def fasta_records(spark, sf):
    rows = _fasta_texts(spark, sf)
    body = F.concat(F.lit("contig_"), "doc_id", F.lit(" made of text\r\n"), sequence.wrapped(F.col("letters")), F.lit("\n"))
    parsed = fasta.parse_records(rows.select(F.lit("memory").alias("file"), F.col("doc_id").alias("ord"), F.lit(1).cast("long").alias("at"), body.alias("body")))
    return parsed.select(F.col("id").alias("contig_id"), F.length("seq").alias("length"), fasta.span("fai").isNotNull().alias("spanned"), F.md5("seq").alias("digest"))


@query(f"""WITH {d.ASSIGNMENTS}, texts AS (
  SELECT 'contig_' || doc_id AS id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS s FROM documents
), whole AS (
  SELECT id, length(s) > 0 AS spanned, length(s) + (length(s) - 1) // 60 + 1 AS bytes,
         '>' || id || ' made of text' || chr(10) || rtrim(regexp_replace(s, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) || chr(10) AS value FROM texts
)
SELECT bin_id, id AS contig_id, CASE WHEN spanned THEN md5(value) END AS digest, NOT spanned AS skipped
FROM assignments JOIN whole ON id = contig_id WHERE tool = 'A'""")
def bin_fasta(spark, sf):
    """Every bin of a tool as FASTA text, read from written files by the spans of an index."""
    path, index = _written_fasta(spark, sf), _new_folder(spark, "fasta-index")
    indexed.write_index(fasta.read_fasta(spark, f"{path}/g=*"), index)
    groups = _tool_a(spark, sf).select(F.col("bin_id").alias("grp"), F.col("contig_id").alias("id"), F.col("row_idx").alias("pos"))
    texts, skipped = indexed.extracted(groups, spark.read.parquet(index))
    rows = texts.select("grp", "id", F.md5(F.col("value").cast("binary")).alias("digest"), F.lit(False).alias("skipped"))
    rows = rows.unionByName(skipped.select("grp", "id", F.lit(None).cast("string").alias("digest"), F.lit(True).alias("skipped")))
    return rows.select(F.col("grp").alias("bin_id"), F.col("id").alias("contig_id"), "digest", "skipped")


@query("""SELECT 'contig_' || doc_id AS contig_id, CASE WHEN length(s) > 0 THEN md5(s) END AS digest, CASE WHEN length(s) > 0 THEN length(s) + (length(s) - 1) // 60 + 1 ELSE 0 END::BIGINT AS bytes
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS s FROM documents)""")
def sequence_spans(spark, sf):
    """All sequences of written files by the data source that seeks; the bytes it read for each."""
    path, index = _written_fasta(spark, sf), _new_folder(spark, "fasta-index")
    indexed.write_index(fasta.read_fasta(spark, f"{path}/g=*"), index)
    rows = indexed.sequences(spark, index)
    return rows.select(F.col("id").alias("contig_id"), F.md5("seq").alias("digest"), "bytes")


# Taxonomy: parts below their types, types below their first word, all below one root


def _tree(spark, sf):
    keys = d.table(spark, sf, "part").select(F.col("p_partkey").alias("tax_id"))
    up = keys.select("tax_id", F.floor(F.col("tax_id") / 2).cast("long").alias("parent"), F.lit("species").alias("rank"))
    return up.select("tax_id", F.when(F.col("tax_id") <= 1, F.col("tax_id")).otherwise(F.col("parent")).alias("parent"), "rank")


_TREE = "tree AS (SELECT p_partkey AS tax_id, CASE WHEN p_partkey <= 1 THEN p_partkey ELSE p_partkey // 2 END AS parent FROM part)"
_CHAINS = f"""{_TREE}, chains AS (SELECT tax_id, 0 AS depth, tax_id AS ancestor FROM tree
  UNION ALL SELECT c.tax_id, c.depth + 1, t.parent FROM chains c JOIN tree t ON t.tax_id = c.ancestor WHERE t.parent <> t.tax_id)"""


@query(f"WITH RECURSIVE {_CHAINS} SELECT tax_id, depth, ancestor FROM chains")
def lineage_closure(spark, sf):
    tree = _tree(spark, sf)
    return taxonomy.lineage(tree.select("tax_id"), tree)


@query("""WITH tree AS (SELECT p_partkey AS tax_id FROM part), merged AS (SELECT -l_partkey AS old, max(l_partkey + l_suppkey) AS new FROM lineitem WHERE l_partkey > 0 GROUP BY l_partkey), ids AS (SELECT tax_id FROM tree UNION SELECT DISTINCT -ps FROM (SELECT l_partkey + 7 AS ps FROM lineitem)),
gone AS (SELECT -p_partkey * 1 AS tax_id FROM part WHERE p_size > 25)
SELECT CASE WHEN t.tax_id IS NOT NULL THEN CASE WHEN m.new IS NOT NULL THEN 'merged' ELSE 'current' END WHEN g.tax_id IS NOT NULL THEN 'deleted' ELSE 'unknown' END AS status, count(*) AS n
FROM ids i LEFT JOIN merged m ON m.old = i.tax_id LEFT JOIN gone g ON g.tax_id = i.tax_id LEFT JOIN tree t ON t.tax_id = coalesce(m.new, i.tax_id) GROUP BY ALL""")
def taxon_statuses(spark, sf):
    """Ids that orders name, negative where they are old ones: merged into others, deleted, or unknown."""
    lines, parts = d.table(spark, sf, "lineitem"), d.table(spark, sf, "part")
    merged = lines.where("l_partkey > 0").groupBy((-F.col("l_partkey")).alias("old")).agg(F.max(F.col("l_partkey") + F.col("l_suppkey")).alias("new"))
    tree = _tree(spark, sf)
    ids = tree.select("tax_id").unionAll(lines.select(-(F.col("l_partkey") + 7))).distinct()
    gone = parts.where("p_size > 25").select((-F.col("p_partkey")).alias("tax_id"))
    return taxonomy.id_counts(taxonomy.resolved_ids(ids, tree, merged, gone))


_GROUPED = "groups AS (SELECT p_brand AS grp, p_partkey AS tax_id FROM part)"


@query(f"""WITH RECURSIVE {_CHAINS}, {_GROUPED}, sizes AS (SELECT grp, count(*) AS members FROM groups GROUP BY grp), shared AS (SELECT grp, ancestor, count(*) AS n, min(depth) AS depth FROM groups JOIN chains USING (tax_id) GROUP BY ALL)
SELECT grp, (list(ancestor ORDER BY depth, ancestor))[1] AS ancestor, any_value(members) AS members FROM shared JOIN sizes USING (grp) WHERE n = members GROUP BY grp""")
def lowest_common_ancestor(spark, sf):
    tree = _tree(spark, sf)
    groups = d.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("tax_id"))
    return taxonomy.common_ancestor(groups, taxonomy.lineage(tree.select("tax_id"), tree))


@query(f"""WITH RECURSIVE {_CHAINS}, {_GROUPED}, sizes AS (SELECT grp, count(*) AS m FROM groups GROUP BY grp), held AS (SELECT grp, tax_id, ancestor, depth FROM groups JOIN chains USING (tax_id)),
shared AS (SELECT grp, ancestor FROM held JOIN sizes USING (grp) WHERE m > 1 GROUP BY grp, ancestor HAVING count(*) = any_value(m))
SELECT grp, tax_id, min(depth) AS distance FROM held JOIN shared USING (grp, ancestor) GROUP BY grp, tax_id""")
def lineage_distance(spark, sf):
    tree = _tree(spark, sf)
    groups = d.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("tax_id"))
    return taxonomy.distance_to_group(groups, taxonomy.lineage(tree.select("tax_id"), tree))
