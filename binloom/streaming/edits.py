"""The edit log as a stream: the latest target of each contig, and the state after moves and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assignment import replay


def latest(edits: DataFrame) -> DataFrame:
    """(contig_id, bin_id, seq) of the last edit of each contig; works on streams (update or complete mode) and tables."""
    return edits.groupBy("contig_id").agg(F.max(F.struct("seq", "bin_id")).alias("e")).select("contig_id", "e.bin_id", "e.seq")


def keep_state(edits: DataFrame, path: str, checkpoint: str):
    """Run what is there, writing each batch's changed contigs with its number, and stop. Late batches may repeat."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = latest(edits).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def current_state(changes: DataFrame) -> DataFrame:
    """State from all written changes."""
    return latest(changes)


def keep_replayed(log: DataFrame, base: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run what is there of a stream (seq, contig_id, source, target) and stop; returns the state (contig_id, bin_id).

    Each batch adds to the log and writes the next state, from the last state and its own events. If it brings events
    of before the last one, the state is replayed from ``base`` and the whole log, so that a late event counts where it
    belongs. A batch that is run again overwrites what it wrote.
    """
    spark = base.sparkSession
    kept = "seq long, contig_id string, source string, target string"

    def states() -> list[int]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        return [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(at)] if fs.exists(at) else []

    def write(batch: DataFrame, number: int) -> None:
        batch.select("seq", "contig_id", "source", "target").write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        before = [n for n in states() if n < number]
        logs = spark.read.schema(f"{kept}, batch int").parquet(f"{path}/log").where(F.col("batch") <= number)
        own = logs.where(F.col("batch") == number).agg(F.min("seq")).first()[0]
        last = logs.where(F.col("batch") < number).agg(F.max("seq")).first()[0]
        if before and (own is None or last is None or own > last):
            state = replay(spark.read.parquet(f"{path}/state/n={max(before)}"), logs.where(F.col("batch") == number))
        else:
            state = replay(base, logs)
        state.write.mode("overwrite").parquet(f"{path}/state/n={number}")

    query = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    done = states()
    return spark.read.parquet(f"{path}/state/n={max(done)}") if done else base
