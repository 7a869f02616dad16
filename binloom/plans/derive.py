"""The engine's relations, derived from the driver's tables; the SQL text says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAN"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a file with fewer row groups than the session has cores, dealt over all cores; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= 4 * cores:
        return rows
    filled = rows.select(F.spark_partition_id()).distinct().count()  # reads footers only
    return rows.repartition(cores, key) if filled < cores else rows


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text) over all cores, for work on each text."""
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(contig_id, doc_id, seq): a document's letters, told as bases."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return documents(spark, sf).select(F.concat(F.lit("contig_"), F.col("doc_id")).alias("contig_id"), "doc_id", F.translate(letters, LETTERS, BASES).alias("seq"))


SEQUENCES = f"""seqs AS (
  SELECT 'contig_' || doc_id AS contig_id, doc_id, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS seq FROM documents
)"""


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    """(contig_id, length, gc_content)."""
    from ..functions.sequence import gc_content

    return sequences(spark, sf).select("contig_id", F.length("seq").cast("long").alias("length"), gc_content(F.col("seq")).alias("gc_content"))


CONTIGS = f"""{SEQUENCES}, contigs AS (
  SELECT contig_id, length(seq)::BIGINT AS length,
         CASE WHEN length(seq) = 0 THEN 0.0 ELSE (length(seq) - length(translate(seq, 'GC', ''))) / length(seq)::DOUBLE END AS gc_content FROM seqs
)"""


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    """(tool, row_idx, contig_id, bin_id) of three binning tools."""
    docs = table(spark, sf, "documents")
    d = F.col("doc_id")
    kinds = F.array(
        F.struct(F.lit("A").alias("tool"), F.when(d % 11 == 0, "unbinned").otherwise(F.col("source")).alias("bin_id")),
        F.struct(F.lit("B").alias("tool"), F.when(d % 13 == 0, "NA").when(d % 7 == 0, "src0").otherwise(F.col("source")).alias("bin_id")),
        F.struct(F.lit("C").alias("tool"), F.when(d % 17 == 0, "None").otherwise(F.col("lang")).alias("bin_id")),
    )
    rows = docs.select(d.alias("row_idx"), F.concat(F.lit("contig_"), d).alias("contig_id"), F.explode(kinds).alias("k"))
    return rows.select("k.tool", "row_idx", "contig_id", "k.bin_id")


ASSIGNMENTS = """assignments AS (
  SELECT 'A' AS tool, doc_id AS row_idx, 'contig_' || doc_id AS contig_id, CASE WHEN doc_id % 11 = 0 THEN 'unbinned' ELSE source END AS bin_id FROM documents
  UNION ALL SELECT 'B', doc_id, 'contig_' || doc_id, CASE WHEN doc_id % 13 = 0 THEN 'NA' WHEN doc_id % 7 = 0 THEN 'src0' ELSE source END FROM documents
  UNION ALL SELECT 'C', doc_id, 'contig_' || doc_id, CASE WHEN doc_id % 17 = 0 THEN 'None' ELSE lang END FROM documents
)"""


def marker_hits(spark: SparkSession, sf: str) -> DataFrame:
    """(contig_id, family)."""
    rows = table(spark, sf, "lineitem")
    return rows.select(F.concat(F.lit("contig_"), "l_partkey").alias("contig_id"), F.concat(F.lit("COG"), F.col("l_suppkey") % 40).alias("family")).distinct()


HITS = "hits AS (SELECT DISTINCT 'contig_' || l_partkey AS contig_id, 'COG' || (l_suppkey % 40) AS family FROM lineitem)"


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """(row_idx, contig_id, depths)."""
    depths = F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_idx"), F.concat(F.lit("contig_"), "vec_id").alias("contig_id"), depths.alias("depths"))


COVERAGE = """coverage AS (SELECT 'contig_' || vec_id AS contig_id,
  (abs(embedding[1]::DOUBLE) + abs(embedding[2]::DOUBLE) + abs(embedding[3]::DOUBLE) + abs(embedding[4]::DOUBLE)) / 4 AS mean_depth FROM embeddings)"""


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, contig_id, bin_id)."""
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("contig_"), "user_id").alias("contig_id"), F.col("event_type").alias("bin_id"))


EDITS = "edits AS (SELECT event_id AS seq, 'contig_' || user_id AS contig_id, event_type AS bin_id FROM events)"

# Reconciliation in SQL.
CAST = f"""{ASSIGNMENTS}, cast_votes AS (
  SELECT tool, contig_id, arg_max(bin_id, row_idx) AS bin_id FROM assignments
  WHERE lower(trim(bin_id)) NOT IN ('unbinned', 'none', 'na', 'n/a', 'unassigned', 'unclustered') GROUP BY tool, contig_id
)"""
PAIRS = f"""{CAST}, sizes AS (SELECT tool, bin_id, count(*) AS n FROM cast_votes GROUP BY ALL),
shared AS (
  SELECT a.tool AS tool_a, a.bin_id AS bin_a, b.tool AS tool_b, b.bin_id AS bin_b, count(*) AS shared
  FROM cast_votes a JOIN cast_votes b ON a.contig_id = b.contig_id AND a.tool < b.tool GROUP BY ALL
), pairs AS (
  SELECT s.*, shared / (x.n + y.n - shared)::DOUBLE AS jaccard FROM shared s
  JOIN sizes x ON x.tool = tool_a AND x.bin_id = bin_a JOIN sizes y ON y.tool = tool_b AND y.bin_id = bin_b
)"""
BEST = f"""{PAIRS}, best AS (
  SELECT tool_a, bin_a, tool_b, bin_b, shared, jaccard FROM (
    SELECT *, row_number() OVER (PARTITION BY tool_a, bin_a, tool_b ORDER BY jaccard DESC, bin_b) AS down,
           row_number() OVER (PARTITION BY tool_b, bin_b, tool_a ORDER BY jaccard DESC, bin_a) AS up FROM pairs)
  WHERE down = 1 AND up = 1 AND jaccard >= 0.1
)"""
# Edge after edge from the best down: all bins with their groups are one list, relabelled where no tool would be twice.
GROUPED = """edges AS (
  SELECT row_number() OVER (ORDER BY jaccard DESC, tool_a || chr(31) || bin_a, tool_b || chr(31) || bin_b) AS e, tool_a || chr(31) || bin_a AS u, tool_b || chr(31) || bin_b AS v FROM best
), steps AS (
  SELECT 0::BIGINT AS e, (SELECT list({'node': tool || chr(31) || bin_id, 'tool': tool, 'grp': tool || chr(31) || bin_id}) FROM sizes) AS m
  UNION ALL
  SELECT e, CASE WHEN x <> y AND NOT list_has_any(list_transform(list_filter(m, lambda n: n.grp = x), lambda n: n.tool), list_transform(list_filter(m, lambda n: n.grp = y), lambda n: n.tool))
    THEN list_transform(m, lambda n: {'node': n.node, 'tool': n.tool, 'grp': CASE WHEN n.grp IN (x, y) THEN least(x, y) ELSE n.grp END}) ELSE m END
  FROM (SELECT edges.e, m, list_filter(m, lambda n: n.node = u)[1].grp AS x, list_filter(m, lambda n: n.node = v)[1].grp AS y FROM steps JOIN edges ON edges.e = steps.e + 1)
), grouped AS (SELECT r.node AS node, r.grp AS grp FROM (SELECT unnest(m) AS r FROM steps WHERE e = (SELECT max(e) FROM steps)))"""
MAGS = f"""{BEST}, {GROUPED},
members AS (SELECT c.tool, c.bin_id, c.contig_id, g.grp FROM cast_votes c JOIN grouped g ON g.node = c.tool || chr(31) || c.bin_id),
named AS (SELECT grp, 'MAG_' || row_number() OVER (ORDER BY count(DISTINCT contig_id) DESC, grp) AS mag_id FROM members GROUP BY grp),
mag_bins AS (SELECT mag_id, tool, bin_id, count(*) AS contig_count FROM members JOIN named USING (grp) GROUP BY ALL),
votes AS (SELECT contig_id, tool, mag_id FROM members JOIN named USING (grp)),
tally AS (SELECT contig_id, mag_id, count(*) AS n FROM votes GROUP BY ALL),
agreed AS (
  SELECT contig_id, sum(n)::BIGINT AS total_votes, max(n) / sum(n)::DOUBLE AS agreement, count(*) AS distinct_groups,
         CASE WHEN count(*) FILTER (WHERE n = top) = 1 THEN arg_max(mag_id, n) END AS majority_mag
  FROM (SELECT *, max(n) OVER (PARTITION BY contig_id) AS top FROM tally) GROUP BY contig_id
), stands AS (
  SELECT majority_mag AS mag_id, contig_id, CASE WHEN agreement = 1 THEN 'core' ELSE 'disputed' END AS kind FROM agreed WHERE majority_mag IS NOT NULL
), mags AS (
  SELECT b.mag_id, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, count(DISTINCT tool || chr(31) || bin_id) AS n_members FROM mag_bins b
  WHERE mag_id IN (SELECT mag_id FROM stands) GROUP BY b.mag_id
)"""
STATE = f"""{MAGS}, {EDITS}, state AS (
  SELECT contig_id, arg_max(bin_id, seq) AS bin_id FROM (
    SELECT contig_id, majority_mag AS bin_id, -1 AS seq FROM agreed WHERE majority_mag IS NOT NULL
    UNION ALL SELECT contig_id, CASE bin_id WHEN 'click' THEN 'excluded' ELSE 'MAG_1' END, seq FROM edits) GROUP BY contig_id
)"""
SUMMARY = """bin_rows AS (SELECT a.bin_id, a.contig_id, c.length, c.gc_content FROM {source} a JOIN contigs c USING (contig_id)),
ranked AS (
  SELECT *, sum(length) OVER (PARTITION BY bin_id) AS total, sum(length) OVER (PARTITION BY bin_id ORDER BY length DESC, contig_id ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY bin_id ORDER BY length DESC, contig_id) AS r FROM bin_rows
), half AS (SELECT bin_id, arg_min(length, r) AS n50, min(r) AS l50 FROM ranked WHERE total > 0 AND upto >= total / 2 GROUP BY bin_id),
fam AS (SELECT bin_id, family, count(DISTINCT contig_id) AS n FROM bin_rows JOIN hits USING (contig_id) GROUP BY ALL),
quality AS (
  SELECT bin_id, count(*) AS families_found, least(100.0, count(*) / (40 * 0.74) * 100)::DOUBLE AS completeness,
         (count(*) FILTER (WHERE n > 1) / (40 * 0.74) * 100)::DOUBLE AS redundancy, count(*) / 40.0::DOUBLE * 100 AS raw_completeness FROM fam GROUP BY bin_id
), summary AS (
  SELECT b.bin_id, count(*) AS contig_count, sum(length)::BIGINT AS total_length, coalesce(any_value(n50), 0) AS n50, coalesce(any_value(l50), 0) AS l50, avg(gc_content) AS mean_gc,
         coalesce(any_value(families_found), 0) AS families_found, coalesce(any_value(completeness), 0) AS completeness, coalesce(any_value(redundancy), 0) AS redundancy,
         coalesce(any_value(raw_completeness), 0) AS raw_completeness
  FROM bin_rows b LEFT JOIN half h USING (bin_id) LEFT JOIN quality q USING (bin_id) GROUP BY b.bin_id
), tiers AS (
  SELECT *, CASE WHEN completeness > 90 AND redundancy < 5 THEN 'high' WHEN completeness >= 50 AND redundancy < 10 THEN 'medium' ELSE 'low' END AS tier FROM summary
)"""


def edit_targets(rows: DataFrame) -> DataFrame:
    """Edits whose targets are MAGs: clicks exclude, the rest move to the largest MAG."""
    return rows.withColumn("bin_id", F.when(F.col("bin_id") == "click", "excluded").otherwise("MAG_1"))
