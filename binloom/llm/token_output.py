"""Token-ID output: a folder of Parquet files with list columns, read back selectively.

Layout: ``tokens/`` holds (doc_id, local_start, n_tokens, tokens) in ascending doc_id order, file after file, with
row groups of a set size, page indexes and dictionary pages for the token lists; the ascending doc_id and
local_start columns take version 2 delta encoding. ``manifest/`` has one row for each file: its name, the ids
before it and its doc_id range. A reader that wants some documents prunes files by the manifest, row groups and
pages by doc_id, and reads metadata columns without the lists.

Edge cases: a null or empty text is just the end id. A very long text is one row with all its ids. Rows with a null doc_id have no place in the order and are
left out. Rows that repeat a doc_id all stay, ordered by text. Extra columns are ignored. An empty table writes no
rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import encoder

TOKENS = "doc_id long, local_start long, n_tokens long, tokens array<int>"


@dataclass(frozen=True)
class Layout:
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.codec,
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#tokens.list.element": "true",
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.page.size": str(self.page_bytes),
            "parquet.page.write-checksum.enabled": "true",
        }


def _encode(tokenizer: str, end_id: int | None):
    def encode(batches):
        import numpy as np
        import pyarrow as pa

        enc, end = encoder(tokenizer), b"" if end_id is None else end_id.to_bytes(4, "little")
        before = 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [enc(t) + end for t in part.column(1).to_pylist()]
                n = np.fromiter((len(x) >> 2 for x in ids), dtype=np.int64, count=len(ids))
                ends = np.cumsum(n)
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(before + ends - n), pa.array(n), lists], names=["doc_id", "local_start", "n_tokens", "tokens"])
                before += int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, layout: Layout = Layout()) -> None:
    """Encode every whole text and write the folder. Only texts are shuffled, once, into doc_id order."""
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    spark = docs.sparkSession
    ranged.mapInArrow(_encode(tokenizer, end_id), TOKENS).write.options(**layout.options()).parquet(f"{path}/tokens")
    files = _files(spark, path).groupBy("file").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )
    # One row for each file.
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy(part_number(F.col("file"))).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("start", before).write.parquet(f"{path}/manifest")


def part_number(file: Column) -> Column:
    """Part files are numbered in range order; beyond five digits, their names do not sort as text."""
    return F.regexp_extract(file, r"^part-(\d+)", 1).cast("long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens").withColumn("file", F.col("_metadata.file_name"))


def read_tokens(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of all or a range of documents; pages outside the range are not read."""
    rows, manifest = _files(spark, path), spark.read.parquet(f"{path}/manifest").select("file", F.col("start").alias("_base"))
    if first_doc is not None:
        rows = rows.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        rows = rows.where(F.col("doc_id") <= last_doc)
    # The manifest has a row for each file of at least a task's size, so it stays small beside the tokens.
    joined = rows.join(manifest, "file")
    return joined.select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _checksums(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        lists = b.column(3)
        flat = np.asarray(lists.flatten()).astype("<u4")
        ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))
        crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)] if b.num_rows else []
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return digests(read_tokens(spark, path))
