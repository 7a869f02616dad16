"""Best-fit packing of documents into sequences, bulk-synchronously over sizes.

Documents are tokenized, and those longer than a sequence are cut into full pieces and a rest. Pieces are
range-sorted by length and ranked within it. In each superstep, all pieces of one length, from the longest down,
look for their successor among the range-sorted gaps of open sequences, the smallest gap that holds them; conflicts
are resolved by rank: the first ranks take the first gaps, as many as each gap holds; the gaps shrink, and pieces
without a gap open new sequences. This is best-fit decreasing, for all pieces of a length at once.

Pieces and gaps of one size differ only by rank, so a sweep matches rank intervals: the table it works on has a row
for each length (at most ``capacity``), not for each document. What is matched is joined back to the pieces by
length and rank, in parallel.

Edge cases: a null or empty text is one piece holding the end id. Rows with a null doc_id are left out. Rows that
repeat a doc_id are packed each for itself. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import maybe_broadcast, shared_dir, small_batches
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Pieces of one length are ranked in so many parts, so that no task holds all copies of a text.
SALTS = 64
#: Chunks that a worker remembers: after other stages its memory is less free than that of a worker which only encodes.
REMEMBERED = 150_000


def _cut(tokenizer: str, capacity: int, end_id: int):
    def cut(batches):
        import pyarrow as pa

        enc, end, step = encoder(tokenizer, REMEMBERED), end_id.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    p = ids[at : at + step]
                    out.append((doc, k, at >> 2, len(p) >> 2, zlib.crc32(p)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    return rows.mapInArrow(_cut(tokenizer, capacity, end_id), PIECES)


def ranked(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces with their rank within the length, and the number of pieces for each length."""
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    ranged = salted.repartitionByRange("length", "_salt").sortWithinPartitions("length", "_salt", "doc_id", "piece")
    local = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    runs = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # At most capacity x SALTS rows, whatever the input.
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = runs.select("length", "_salt", before.alias("_before"))
    joined = ranged.withColumn("_local", local).join(F.broadcast(bases), ["length", "_salt"])
    rank = (F.col("_before") + F.col("_local")).cast("long")
    return joined.withColumn("rank", rank).drop("_salt", "_local", "_before"), runs.groupBy("length").agg(F.sum("_n").alias("n"))


def match(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps over lengths: (length, first rank, end rank, first sequence, pieces a sequence, offset).

    ``sizes``: pieces by length. A gap run is a range of sequences with the same gap.
    """
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), sorted
    out, opened = [], 0
    for length in sorted(sizes, reverse=True):
        n, rank = sizes[length], 0
        while rank < n:
            k = bisect_left(gaps, (length,))
            gap, first, many = gaps.pop(k) if k < len(gaps) else (capacity, opened, 1 << 62)
            fresh = many == 1 << 62
            each = gap // length
            full = min(many, (n - rank) // each)
            rest = (n - rank) - full * each if full < many else 0
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - gap))
                if gap - each * length:
                    insort(gaps, (gap - each * length, first, full))
            if 0 < rest < each:
                at = rank + full * each
                out.append((length, at, at + rest, first + full, rest, capacity - gap))
                if gap - rest * length:
                    insort(gaps, (gap - rest * length, first + full, 1))
            used = full + bool(0 < rest < each)
            rank += full * each + (rest if 0 < rest < each else 0)
            if fresh:
                opened = first + used
            elif used < many:
                insort(gaps, (gap, first + used, many - used))
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = shared_dir(spark, "pieces")
    with small_batches(spark):
        pieces(docs, tokenizer, capacity, end_id).write.parquet(path)
    parts, by_length = ranked(spark.read.schema(PIECES).parquet(path))
    sizes = {r["length"]: r["n"] for r in by_length.collect()}  # at most ``capacity`` rows
    plan = match(sizes, capacity)
    schema = "length int, _lo long, _hi long, _first long, _each long, _offset long"
    steps = maybe_broadcast(spark.createDataFrame(plan, schema), len(plan), 48)
    placed = parts.join(steps, (parts.length == steps.length) & (parts["rank"] >= steps["_lo"]) & (parts["rank"] < steps["_hi"]))
    nth = F.col("rank") - F.col("_lo")
    return placed.select(
        "doc_id", "piece", "start", parts.length.cast("long").alias("length"), "ids_crc32",
        (F.col("_first") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_each")) * parts.length).cast("long").alias("offset"),
    )
