"""Line dedup: range-partitioned line hashes, streamed first occurrences, run-length keep bitmaps.

Only DataFrame functions. A line's key is the stripped, A-Z lower-cased line; keys are compared by 128 hash bits.
The hashes are range-partitioned together with a salt taken from the document, so that the rows of one very
frequent line spread over many tasks, and sorted by document and position within them: a document's first line
with a key is where the sorted stream changes document. Counts are combined per (key, salt), then per key.

Edge cases: a null or empty text is one empty line. A very long text is one row; its lines are rows like others, and
a line of any length counts by its hashes. Equal lines within a document stand or fall together. A row with a null doc_id takes no part in counting and keeps
every line. Rows that repeat a doc_id count as one document. Extra columns are ignored by ``keep_bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, ascii_lower, indices, let, stored, strip_ws

#: Pieces that the rows of one key are split into.
SALTS = 64

#: Keys that are broadcast although not all are.
HOT = 10_000

LINES = "array<struct<start:int,stop:int>>"


def _split(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def long_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, doc_id, row, pos) of every line whose key has ``min_chars`` code points."""
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(_split()).alias("pos", "line"))
    keyed = rows.select("doc_id", "row", "pos", strip_ws(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = keyed.select("doc_id", "row", "pos", ascii_lower(F.col("line")).alias("k"))
    return keyed.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"), "doc_id", "row", "pos")


def repeated_keys(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """(h1, h2, n, last_doc) of the keys that at least ``min_docs`` documents hold."""
    salted = lines.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "doc_id", "pos")
    ranged = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "pos")
    stream = W.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    first = ranged.withColumn("first", ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(stream)))
    part = first.groupBy("h1", "h2", "salt").agg(F.count_if("first").alias("n"), F.max("doc_id").alias("last_doc"))
    return part.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last_doc").alias("last_doc")).where(F.col("n") >= min_docs)


def _held(lines: DataFrame, keys: DataFrame, send: int) -> DataFrame:
    """The lines with repeated keys, with last_doc. Where the keys are too many to broadcast, those of many lines are
    broadcast (HOT of them at most), so that no frequent line's rows meet in one task."""
    rows, held = keys.agg(F.count(F.lit(1)), F.sum("n")).first()
    if 64 * rows <= send:
        return lines.join(F.broadcast(keys.drop("n")), ["h1", "h2"])
    hot = keys.where(F.col("n") * HOT >= held)  # n adds up to ``held``: at most HOT rows
    cold = keys.where(F.col("n") * HOT < held).drop("n")
    rest = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])
    return lines.join(F.broadcast(hot.drop("n")), ["h1", "h2"]).unionByName(rest)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, send: int = BROADCAST_LIMIT) -> DataFrame:
    """Documents that lose lines: (doc_id, row, keep), keep being the kept line ranges [start, stop) in order.

    ``stop`` of the last range is null: it reaches to the end of the text. ``row`` is xxhash64(text).
    """
    lines = long_lines(docs, min_chars)
    keys = stored(repeated_keys(lines, min_docs), "line-keys")
    lost = _held(lines, keys, send).where("doc_id <> last_doc")
    drop = lost.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("d"))
    runs = F.transform(
        indices(F.size("d") + 1),
        lambda i: F.struct(F.coalesce(F.get("d", i - 1) + 1, F.lit(0)).alias("start"), F.get("d", i).alias("stop")),
    )
    keep = F.filter(runs, lambda r: r["stop"].isNull() | (r["stop"] > r["start"]))
    return drop.select("doc_id", "row", F.size("d").cast("long").alias("n_dropped"), keep.cast(LINES).alias("keep"))


def kept(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc, n_lines, n_dropped, text) of each row: the row itself as a struct, its counts, its kept lines as text."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"), "text")
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "n_dropped", "keep")
    lines = _split()
    text = F.when(F.col("keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        let(lines, lambda x: F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(x, r["start"] + 1, F.coalesce(r["stop"], F.size(x)) - r["start"]))), "\n"))
    )
    n = F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")
    return rows.join(b, ["_id", "_row"], "left").select("doc", F.size(lines).cast("long").alias("n_lines"), n, text.alias("text"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with its kept lines as ``text``; its other columns stay as they are, whatever their names."""
    return kept(docs, bitmaps).select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
