"""Places of rows in the files they come from, however Spark splits the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What tells a split: its file and the byte it starts at.
SPLIT = ("file", "block")


def from_splits(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with the file and block they are from."""
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def split_starts(rows: DataFrame, size: Column) -> DataFrame:
    """(file, block, block_at): the sum of ``size`` over the splits of the file before each split; a row for each split."""
    totals = rows.groupBy(*SPLIT).agg(F.sum(size).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return totals.select(*SPLIT, F.coalesce(before, F.lit(0)).cast("long").alias("block_at"))


class Running:
    """Sums of what a task has seen of the split it is in; batches come in file order."""

    def __init__(self):
        self.split, self.sum = None, 0

    def before(self, files, blocks, sizes):
        """For each row of a batch, the sum of the sizes before it in its split."""
        import numpy as np

        blocks, sizes = np.asarray(blocks), np.asarray(sizes)
        codes = files.dictionary_encode()
        key = np.stack([np.asarray(codes.indices), blocks], 1)
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        ends = np.cumsum(sizes)
        out = ends - sizes
        for i, at in enumerate(new):
            split = (codes.dictionary[int(key[at, 0])].as_py(), int(blocks[at]))
            carried = self.sum if split == self.split else 0
            stop = new[i + 1] if i + 1 < len(new) else len(sizes)
            base = out[at]
            out[at:stop] += carried - base
            self.split, self.sum = split, carried + int(ends[stop - 1] - base)
        return out


def placed(rows: DataFrame, size: Column) -> DataFrame:
    """``rows`` of ``from_splits`` with ``at``, the sum of ``size`` over the rows before each in its file.

    The rows are scanned twice, first for the sizes alone; nothing of them is shuffled but a sum for each split.
    """

    def run(batches):
        import pyarrow as pa

        running, names = Running(), None
        for b in batches:
            if b.num_rows:
                names = b.schema.names
                at = running.before(b.column(names.index("file")), b.column(names.index("block")), b.column(names.index("_size")))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(at)], names=[*names[:-1], "at"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = rows.withColumn("_size", size.cast("long")).mapInArrow(run, f"{kinds}, at long")
    # A row for each split.
    joined = local.join(F.broadcast(split_starts(rows, size)), list(SPLIT))
    return joined.select(*rows.columns, (F.col("at") + F.col("block_at")).alias("at"))
