"""The whole way from files to a reviewed set of bins, lazily."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import contig_stats
from ..operators import assignment, bins, evidence, filters, idmatch, markers, network, reconcile
from ..operators.graph import checkpointed
from ..sources import export, fasta, tables


class Review:
    """One assembly, the bin tables of several tools, and optionally coverage, marker references and edits."""

    def __init__(
        self,
        spark: SparkSession,
        assembly: str,
        files: list[str],
        refs: DataFrame | None = None,
        index: DataFrame | None = None,
        search: markers.Search | None = None,
        supplied: DataFrame | None = None,
        min_jaccard: float = reconcile.MIN_JACCARD,
        recall: float = bins.RECALL,
    ):
        self.spark, self.refs, self.index, self.supplied = spark, refs, index, supplied
        self.search, self.min_jaccard, self.recall = search or markers.Search(), min_jaccard, recall
        if not fasta.looks_like_fasta(spark, assembly):
            raise ValueError(f"no FASTA: {assembly}")
        self.records = fasta.read_any_fasta(spark, assembly)
        self.lines = tables.read_lines(spark, files)
        self.heads = checkpointed(tables.heads(self.lines))
        self.edits: DataFrame | None = None

    @cached_property
    def raw_tables(self) -> DataFrame:
        """(tool, row_idx, contig_id, bin_id) as read."""
        rows = tables.bins_of(self.lines, self.heads.where("format = 'contig-bin'"))
        return rows.select(F.col("label").alias("tool"), "row_idx", "contig_id", "bin_id")

    @cached_property
    def repair(self) -> tuple[DataFrame, DataFrame]:
        ids = fasta.contig_ids(self.records).withColumnRenamed("id", "contig_id")
        return idmatch.repaired(self.raw_tables, ids)

    @property
    def tables(self) -> DataFrame:
        return self.repair[0]

    @cached_property
    def coverage(self) -> DataFrame:
        """(contig_id, row_idx, depths) of the first coverage table by path."""
        first = self.heads.where("format = 'coverage'").orderBy("file").limit(1)
        rows = tables.coverage_of(self.lines, first)
        depths = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "depth"))), lambda x: x["depth"])
        return rows.groupBy("row_idx", "contig_id").agg(depths.alias("depths"))

    @cached_property
    def contigs(self) -> DataFrame:
        """Statistics of the contigs that some table names, with coverage. The semi join runs before the statistics."""
        rows = self.records.select(F.col("id").alias("contig_id"), "header", "seq", "fai", "ord")
        wanted = filters.referenced(rows, self.tables)
        stats = wanted.select("contig_id", "fai", "ord", contig_stats("seq").alias("s")).select("contig_id", "fai", "ord", "s.*")
        return checkpointed(evidence.coverage_attached(bins.last_by(stats, "contig_id", "ord"), self.coverage))

    @cached_property
    def hits(self) -> DataFrame:
        """(contig_id, family, ...) of marker genes: those supplied (contig_id, family) come first, then the search's."""
        if self.supplied is not None:
            return bins.preferred_hits(self._searched, self.supplied)
        return self._searched

    @cached_property
    def _searched(self) -> DataFrame:
        if self.refs is None:
            return self.spark.createDataFrame([], "contig_id string, family string")
        index = self.index if self.index is not None else markers.seed_index(self.refs, self.search.k)
        rows = filters.referenced(self.records.select(F.col("id").alias("contig_id"), "seq"), self.tables)
        return checkpointed(markers.search(rows, self.refs, index, self.search))

    @cached_property
    def reconciliation(self) -> reconcile.Reconciliation:
        return reconcile.Reconciliation(self.tables, self.min_jaccard)

    @property
    def state(self) -> DataFrame:
        """(contig_id, bin_id) after the edits so far."""
        tools = self.raw_tables.select("tool").distinct().count()
        base = assignment.initial(self.tables, self.reconciliation.agreement if tools > 1 else None, tools)
        return assignment.fold(base, self.edits) if self.edits is not None else base

    def edit(self, edits: DataFrame) -> Review:
        """Append (seq, contig_id, bin_id) to the log."""
        self.edits = edits if self.edits is None else self.edits.unionByName(edits)
        return self

    def summary(self) -> DataFrame:
        return bins.bin_summary(self.state, self.contigs, self.hits, self.recall)

    def mag_summary(self) -> DataFrame:
        r = self.reconciliation
        return evidence.mag_summary(r.mags, r.votes, r.standing, self.state, self.contigs, self.hits)

    def evidence(self) -> DataFrame:
        r = self.reconciliation
        return evidence.evidence(evidence.candidates(r.votes, r.mags, r.agreement), r.standing, self.contigs)

    def neighbourhood(self, view: network.View = network.View()) -> DataFrame:
        r = self.reconciliation
        return network.leaves(r.votes, r.mags, r.agreement, self.state, view)

    def export(self, path: str, excluded_mags: DataFrame | None = None) -> DataFrame:
        """Assignment and summary as CSV text without the contigs of excluded MAGs (mag_id), and one FASTA folder for
        each bin of the whole state. Returns (bin_id, id) of members that no sequence could be written of."""
        kept = self.state if excluded_mags is None else assignment.exportable(self.state, excluded_mags)
        export.write_lines(export.assignment_lines(kept.orderBy("contig_id")), export.ASSIGNMENT_HEADER, f"{path}/assignment")
        export.write_lines(export.summary_lines(bins.bin_summary(kept, self.contigs, self.hits, self.recall)), export.SUMMARY_HEADER, f"{path}/summary", "bin_id")
        return fasta.write_bins(self.state.select("bin_id", F.col("contig_id").alias("id")), self.records, f"{path}/bins")
