"""CSV text of assignments and bin summaries, as columns and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, to_fixed


def _line(*cells):
    return F.concat_ws(",", *[csv_field(c) for c in cells])


def assignment_lines(assignment: DataFrame) -> DataFrame:
    """(line) for each contig; the header is ASSIGNMENT_HEADER."""
    return assignment.select(_line(F.col("contig_id"), F.col("bin_id")).alias("line"))


# The columns of an assignment.
ASSIGNMENT_HEADER = "contig_id,bin_id"
# The columns of the summary, in the order of the format.
SUMMARY_HEADER = "bin_id,contig_count,total_length_bp,n50_bp,mean_gc_pct,completeness_pct,redundancy_pct,tool_agreement_fraction,mimag_tier"


def summary_lines(summary: DataFrame) -> DataFrame:
    """(bin_id, line): percentages with two decimals, agreement with three or blank."""
    two, three = F.lit(2), F.lit(3)
    agreement = F.when(F.col("agreement").isNotNull(), to_fixed(F.col("agreement"), three)) if "agreement" in summary.columns else F.lit(None).cast("string")
    return summary.select(
        "bin_id",
        _line(
            F.col("bin_id"), F.col("contig_count"), F.col("total_length"), F.col("n50"), F.when(F.col("mean_gc").isNotNull(), to_fixed(F.col("mean_gc") * 100, two)),
            to_fixed(F.col("completeness"), two), to_fixed(F.col("redundancy"), two), agreement, F.col("tier"),
        ).alias("line"),
    )


def write_lines(lines: DataFrame, header: str, path: str, *order: str) -> None:
    """Text files in order, the header as the first line of the first file."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(header,)], "value string")
    body = (lines.orderBy(*order) if order else lines).select(F.col("line").alias("value"))
    head.unionAll(body).write.text(path)
