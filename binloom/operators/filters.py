"""Filters over contigs and MAGs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import full_trim

Range = tuple[float | None, float | None]
OPEN: Range = (None, None)


def raw_table(contigs: DataFrame) -> DataFrame:
    """Contigs by length, longest first, equal ones in file order (``ord``)."""
    return contigs.orderBy(F.desc("length"), "ord")


def within(c: Column, bounds: Range) -> Column:
    """Inclusive; an open side passes, and so does NaN."""
    low, high = bounds
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.isnan(c.cast("double")) | (c >= low))
    if high is not None:
        ok = ok & (F.isnan(c.cast("double")) | (c <= high))
    return ok


@dataclass(frozen=True)
class ContigFilter:
    length: Range = OPEN
    gc_percent: Range = OPEN
    coding_percent: Range = OPEN
    bin: tuple[str, str] | None = None  # tool and bin
    unbinned: bool = False
    max_agreement_percent: float | None = None
    search: str = ""


def last_rows(assignment: DataFrame) -> DataFrame:
    """(tool, contig_id, bin_id): the last row of each contig in each tool."""
    return assignment.groupBy("tool", "contig_id").agg(F.max_by("bin_id", "row_idx").alias("bin_id"))


def in_bin(contigs: DataFrame, assignment: DataFrame, tool: str, bin_id: str) -> DataFrame:
    wanted = last_rows(assignment.where(F.col("tool") == tool)).where(F.col("bin_id") == bin_id)
    return contigs.join(wanted, "contig_id", "left_semi")


def in_no_bin(contigs: DataFrame, assignment: DataFrame) -> DataFrame:
    return contigs.join(assignment, "contig_id", "left_anti")


def search(contigs: DataFrame, assignment: DataFrame, text: str) -> DataFrame:
    """Contigs whose id or one of whose bins holds the text, whatever the case."""
    want = text.strip().lower()
    if not want:
        return contigs
    by_bin = last_rows(assignment).where(F.lower("bin_id").contains(want)).select("contig_id")
    by_id = contigs.where(F.lower("contig_id").contains(want)).select("contig_id")
    return contigs.join(by_id.unionAll(by_bin), "contig_id", "left_semi")


def filter_contigs(contigs: DataFrame, assignment: DataFrame, agreed: DataFrame | None, f: ContigFilter) -> DataFrame:
    out = contigs.where(within(F.col("length"), f.length) & within(F.col("gc_content") * 100, f.gc_percent))
    if f.coding_percent != OPEN:
        out = out.where(within(F.col("coding_density") * 100, f.coding_percent))
    if f.unbinned:
        out = in_no_bin(out, assignment)
    elif f.bin:
        out = in_bin(out, assignment, *f.bin)
    if f.max_agreement_percent is not None:  # a contig without agreement fails
        if agreed is None:
            return out.where("false")
        out = out.join(agreed.where(F.col("agreement") * 100 <= f.max_agreement_percent), "contig_id", "left_semi")
    return search(out, assignment, f.search)


def bin_options(assignment: DataFrame) -> DataFrame:
    """(tool, bin_id), tools in their order, bins in locale order."""
    return assignment.select("tool", "bin_id").distinct().orderBy("tool", F.collate("bin_id", "UNICODE"), "bin_id")


@dataclass(frozen=True)
class MagFilter:
    search: str = ""
    tiers_off: tuple[str, ...] = ()
    core: Range = OPEN
    disputed: Range = OPEN
    completeness: Range = OPEN
    redundancy: Range = OPEN
    tool: str | None = None


def filter_mags(mags: DataFrame, f: MagFilter) -> DataFrame:
    """Over MAG summaries with ``tools`` joined by commas."""
    out = mags.where(F.lower("mag_id").contains(f.search.strip().lower()) & ~F.col("tier").isin(*f.tiers_off))
    for c, r in (("core_count", f.core), ("disputed_count", f.disputed), ("completeness", f.completeness), ("redundancy", f.redundancy)):
        if r != OPEN:
            out = out.where(within(F.col(c), r))
    return out.where(F.array_contains(F.split("tools", ","), f.tool)) if f.tool else out


def referenced(contigs: DataFrame, assignment: DataFrame) -> DataFrame:
    """Contigs that some table names, unbinned rows too."""
    return contigs.join(assignment.select("contig_id").distinct(), "contig_id", "left_semi")


def active_tools(assignment: DataFrame, tools: list[str]) -> DataFrame:
    if not tools:
        raise ValueError("one tool at least must stay on")
    return assignment.where(F.col("tool").isin(*tools))


def sort_column(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By number if at least half of the cells that aren't blank are numbers, else by text; blanks are last both ways."""
    text = full_trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    blank = F.lower(text).isin("", "n/a", "-", "–", "none")
    number = F.regexp_replace(text, "[,%]", "").try_cast("double")
    share = rows.agg(F.coalesce(F.avg(F.when(~blank, number.isNotNull().cast("int"))) >= 0.5, F.lit(False)).alias("_numeric"))
    told = rows.crossJoin(F.broadcast(share))  # one row
    by_number, by_text = F.when(~blank & F.col("_numeric"), number), F.when(~blank & ~F.col("_numeric"), F.lower(text))
    order = [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in (by_number, by_text)]
    return told.orderBy(*order).drop("_numeric")
