"""Contig-to-bin and coverage tables: parsing and format detection, of texts in columns and of files in any splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_label, full_trim, is_blank, is_number, to_number
from .blocks import from_splits, placed

# Names of the first column that mark a header.
HEADER_NAMES = (
    "contig", "contigid", "contig_id", "contigname", "contig_name", "scaffold", "scaffoldid", "scaffold_id",
    "sequence", "sequence_id", "sequenceid", "name",
)
# Coverage columns that are no samples.
NOT_SAMPLES = ("contigname", "contig", "contig_id", "contiglen", "totalavgdepth")


def lines_of(text: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(text, "\r?\n"), lambda x: ~is_blank(x))


def _with(value: Column, then) -> Column:
    """``then(value)``, with the value computed once: an expression that is named again would be computed again, in a
    lambda for each of its elements."""
    return F.transform(F.array(value), then)[0]


def delimiter(lines: Column) -> Column:
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.regexp_count(first, F.lit("\t")) >= F.regexp_count(first, F.lit(",")), F.lit("\t")).otherwise(F.lit(","))


def _cells(lines: Column, mark: Column) -> Column:
    return F.transform(lines, lambda x: F.when(mark == "\t", F.split(x, "\t")).otherwise(F.split(x, ",")))


def _split_lines(lines: Column) -> Column:
    return _with(delimiter(lines), lambda mark: _cells(lines, mark))


def read_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, label, text) of each file, whole; for files of any size there is ``read_lines``."""
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _labelled(rows, "path").select("path", "label", "text")


def parse_bins(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, row_idx, contig_id, bin_id) from ``text``; short and blank rows and a header are dropped."""
    rows = texts.select(*keys, lines_of(F.col("text")).alias("lines"))
    return _bin_rows(rows.select(*keys, F.posexplode(_with(F.col("lines"), _split_lines)).alias("row_idx", "cells")), *keys)


def _bin_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Of (keys, row_idx, cells)."""
    contig, bin_id = full_trim(F.get("cells", F.lit(0))), full_trim(F.get("cells", F.lit(1)))
    rows = rows.select(*keys, "row_idx", contig.alias("contig_id"), bin_id.alias("bin_id"))
    header = (F.col("row_idx") == 0) & F.lower("contig_id").isin(*HEADER_NAMES)
    return rows.where(~header & (F.col("contig_id") != "") & (F.col("bin_id") != ""))


def parse_coverage(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, row_idx, contig_id, sample, sample_idx, depth) from ``text``, in long form."""
    rows = texts.select(*keys, lines_of(F.col("text")).alias("lines"))
    rows = rows.select(*keys, _with(F.col("lines"), _split_lines).alias("rows"))
    first = F.get("rows", F.lit(0))
    rows = rows.withColumn("head", first).withColumn("named", _names(first))
    return _coverage_rows(rows.select(*keys, "head", "named", F.posexplode("rows").alias("row_idx", "cells")), *keys)


def _coverage_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Of (keys, head, named, row_idx, cells): the file's first cells and whether they are names."""
    out = rows.where(~F.col("named") | (F.col("row_idx") > 0))
    out = out.select(*keys, "row_idx", "head", "named", full_trim(F.col("cells")[0]).alias("contig_id"), F.posexplode("cells").alias("col", "cell"))
    title = full_trim(F.get("head", F.col("col")))
    sample = F.when(F.col("named"), title).otherwise(F.concat(F.lit("sample"), F.col("col")))
    out = out.where((F.col("col") > 0) & (F.col("contig_id") != "")).withColumn("sample", sample)
    # Cells beyond the header have no sample; variances and derived columns are none.
    is_sample = ~F.col("named") | (F.col("sample").isNotNull() & ~F.lower("sample").isin(*NOT_SAMPLES) & ~F.lower("sample").endswith("-var"))
    return out.where(is_sample).select(*keys, "row_idx", "contig_id", "sample", F.col("col").alias("sample_idx"), to_number(F.col("cell")).alias("depth"))


# Files in any number of splits

#: Lines that tell a file's format; its first tells the delimiter and the header.
FIRST_LINES = 20


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, row_idx, line): the lines of each file that are not blank, numbered from 0, in as many tasks as splits."""
    raw = from_splits(spark.read.option("lineSep", "\n").text(paths))
    line = F.when(F.endswith("value", F.lit("\r")), F.substr("value", F.lit(1), F.length("value") - 1)).otherwise(F.col("value"))
    rows = raw.select(line.alias("line"), "file", "block").where(full_trim(F.col("line")) != "")
    return placed(rows, F.lit(1)).select("file", F.col("at").alias("row_idx"), "line")


def heads(lines: DataFrame) -> DataFrame:
    """(file, label, format, mark, head, named): what the first lines tell, a row for each file that has any."""
    first = lines.where(F.col("row_idx") < FIRST_LINES).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("r"))
    rows = first.select("file", F.col("r.line").alias("lines"))
    cells = F.get(_cells(F.col("lines"), delimiter(F.col("lines"))), F.lit(0))
    told = rows.select("file", sniff_lines(F.col("lines")).alias("format"), delimiter(F.col("lines")).alias("mark"), cells.alias("head"), _names(cells).alias("named"))
    return _labelled(told, "file").select("file", "label", "format", "mark", "head", "named")


def _labelled(files: DataFrame, path: str) -> DataFrame:
    """Files with ``label``, from their names; a label that occurs again gets a number, in the order of paths."""
    from pyspark.sql import Window as W

    named = files.withColumn("base", file_label(F.col(path)))
    nth = F.row_number().over(W.partitionBy("base").orderBy(path))
    return named.withColumn("label", F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), nth, F.lit(")")))).drop("base")


def _told(lines: DataFrame, told: DataFrame) -> DataFrame:
    """Lines with what is told of their files, and their cells."""
    rows = lines.join(F.broadcast(told), "file")  # a row for each file
    return rows.withColumn("cells", F.when(F.col("mark") == "\t", F.split("line", "\t")).otherwise(F.split("line", ",")))


def bins_of(lines: DataFrame, told: DataFrame) -> DataFrame:
    """(label, row_idx, contig_id, bin_id) of the files of ``told``."""
    return _bin_rows(_told(lines, told), "label")


def coverage_of(lines: DataFrame, told: DataFrame) -> DataFrame:
    """(label, row_idx, contig_id, sample, sample_idx, depth) of the files of ``told``."""
    return _coverage_rows(_told(lines, told), "label")


def _data_rows(lines: Column, most: int) -> Column:
    """Cells of the first lines, without a header: a first line with a cell, after the first, that is no number."""
    cells = _with(F.slice(lines, 1, most), _split_lines)
    return _with(cells, lambda c: F.when(_names(F.get(c, F.lit(0))), F.slice(c, 2, most)).otherwise(c))


def _names(cells: Column) -> Column:
    return F.coalesce(F.exists(_rest(cells), lambda x: ~is_number(x)), F.lit(False))


def _rest(cells: Column) -> Column:
    return F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))


def is_bin_table(lines: Column) -> Column:
    """The first 20 lines, but a header, have exactly two cells, none blank."""

    def told(cells: Column) -> Column:
        header = F.lower(full_trim(F.get(F.get(cells, F.lit(0)), F.lit(0)))).isin(*HEADER_NAMES)
        return F.when(F.coalesce(header, F.lit(False)), F.slice(cells, 2, 20)).otherwise(cells)

    cells = _with(F.slice(lines, 1, 20), _split_lines)
    pair = lambda r: (F.size(r) == 2) & ~is_blank(r[0]) & ~is_blank(r[1])
    return _with(_with(cells, told), lambda data: (F.size(data) > 0) & F.forall(data, pair))


def is_coverage(lines: Column) -> Column:
    """In the first ten lines, but a header, all cells after a contig name are blank or numbers."""
    row = lambda r: (F.size(r) >= 2) & ~is_blank(r[0]) & F.forall(_rest(r), is_number)
    return _with(_data_rows(lines, 10), lambda data: (F.size(data) > 0) & F.forall(data, row))


def sniff(text: Column) -> Column:
    """'coverage', 'contig-bin' or 'unknown'; a two-column numeric table is contig-bin."""
    return sniff_lines(lines_of(text))


def sniff_lines(lines: Column) -> Column:
    """``sniff`` of an array of lines that are not blank; the first 20 are enough."""
    return _with(F.slice(lines, 1, FIRST_LINES), _sniffed)


def _sniffed(lines: Column) -> Column:
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    columns = 1 + F.greatest(F.regexp_count(first, F.lit("\t")), F.regexp_count(first, F.lit(",")))
    return _with(
        is_coverage(lines),
        lambda coverage: F.when((columns >= 3) & coverage, F.lit("coverage"))
        .when(is_bin_table(lines), F.lit("contig-bin"))
        .when(coverage, F.lit("coverage"))
        .otherwise(F.lit("unknown")),
    )
