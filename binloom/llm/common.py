"""Shared column helpers and shared-folder handling of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
WS_SPLIT = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side of a join is broadcast only when a count shows it under this many bytes.
BROADCAST_LIMIT = 64 << 20

#: Paths given out within ``fleeting``.
_given: ContextVar[list[str] | None] = ContextVar("given", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a local one is set if the session runs on this machine alone; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="binloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (given := _given.get()) is not None:
        given.append(path)
    return path


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back."""
    path = shared_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames, once nothing reads them any more."""
    for df in frames:
        _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def fleeting(spark: SparkSession):
    """All that is written to the shared folder within is deleted at the end, also after an error. The function it yields
    takes a stored frame and returns it; such a frame stays."""
    given, kept = [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    token = _given.set(given)
    try:
        yield keep
    finally:
        _given.reset(token)
        for path in given:
            if path not in kept:
                _delete(spark, path)
        if (outer := _given.get()) is not None:
            outer.extend(kept)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Python workers get so many rows at once: texts and token sets are long, and a batch is in memory several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast ``df`` when rows x row_bytes is proven small; else leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def words(c: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; null and blank texts have none."""
    t = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_SPLIT))


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it often at the cost of one evaluation."""
    return F.transform(F.array(value), body)[0]


def indices(n: Column) -> Column:
    """0 .. n-1, empty where n < 1."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))
