"""FASTA scans, index entries and extraction, on Spark's splittable text reader."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import byte_span
from .blocks import Running, from_splits, split_starts


def listed(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(file, kind, size) of the files that ``path`` names: 'blocked' if its members tell their size, 'gzip' by its magic
    bytes, 'fasta' if it starts with >, or 'other'.

    At most 18 bytes of each file are read, whatever its name says.
    """
    from .indexed import is_blocked

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(at) or ():
        for status in fs.listStatus(found.getPath()) if found.isDirectory() else (found,):
            if status.isFile() and not status.getPath().getName().startswith(("_", ".")):
                stream = fs.open(status.getPath())
                head = bytes(b for b in (stream.read() for _ in range(18)) if b >= 0)
                stream.close()
                kind = "blocked" if is_blocked(head) else "gzip" if head.startswith(b"\x1f\x8b") else "fasta" if head.startswith(b">") else "other"
                out.append((status.getPath().toString(), kind, status.getLen()))
    return sorted(out)


def peeked(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, kind): 'gzip', 'fasta' or 'other'."""
    return [(f, "gzip" if kind == "blocked" else kind) for f, kind, _ in listed(spark, path)]


def looks_like_fasta(spark: SparkSession, path: str) -> bool:
    """Compressed files are taken for FASTA; others start with >."""
    return all(kind != "other" for _, kind, _ in listed(spark, path))


def read_any_fasta(spark: SparkSession, path: str, trim: bool = False) -> DataFrame:
    """``read_fasta`` of files of any name. Block-compressed files are unpacked by many tasks; other compressed ones
    that are not named *.gz by one each."""
    from .indexed import read_blocked

    files = listed(spark, path)
    blocked = [(f, size) for f, kind, size in files if kind == "blocked"]
    odd = [f for f, kind, _ in files if kind == "gzip" and not f.endswith(".gz")]
    rest = [f for f, kind, _ in files if kind != "blocked" and f not in odd]
    out = [read_fasta(spark, rest, trim)] if rest else []
    if blocked:
        out.append(read_blocked(spark, blocked, trim))
    if odd:
        raw = spark.read.format("binaryFile").load(odd).select(F.col("path").alias("file"), "content")
        # A compressed file has no places to read from: offsets count in the unpacked text.
        out.append(parse_records(raw.mapInArrow(_unpacked, "file string, ord long, at long, body binary"), trim))
    return reduce(DataFrame.unionByName, out)


def _unpacked(batches):
    """Records of compressed files, as they come out of the decompressor."""
    import gzip
    import io

    import pyarrow as pa

    for b in batches:
        for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            held, at, start, n = [], 0, None, 0
            for line in io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))):
                if line.startswith(b">"):
                    if start is not None:
                        yield _record(file, n, start, held)
                        n += 1
                    held, start = [line[1:]], at + 1
                elif start is not None:
                    held.append(line)
                at += len(line)
            if start is not None:
                yield _record(file, n, start, held)


def _record(file: str, n: int, at: int, lines: list[bytes]):
    import pyarrow as pa

    body = b"".join(lines).removesuffix(b"\n")
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n], pa.int64()), pa.array([at], pa.int64()), pa.array([body], pa.binary())], names=["file", "ord", "at", "body"])


def read_fasta(spark: SparkSession, path: str | list[str], trim: bool = False) -> DataFrame:
    """(file, id, header, seq, fai, ord): one row for each record of plain or *.gz files, in any number of splits.

    The id is the header up to white space, trimmed. Text before the first header and blank lines are skipped; one
    carriage return at a line's end is dropped. ``fai`` holds byte offsets: records are as long as their text and
    the separator, so a record's place is the sum of what lies before it, in its split and in the splits before. A
    first scan sums the sizes of each split, a second counts on and parses in one pass; no sequence is shuffled.
    """
    raw = from_splits(spark.read.option("lineSep", "\n>").text(path))
    sized = raw.select(F.col("value").cast("binary").alias("value"), "file", "block", F.monotonically_increasing_id().alias("ord"))
    starts = split_starts(raw, F.octet_length("value").cast("long") + 2)

    def run(batches):
        import numpy as np

        running = Running()
        for b in batches:
            values = b.column(0).to_pylist()
            at = running.before(b.column(1), b.column(2), np.fromiter((len(v) + 2 for v in values), np.int64, len(values))) if values else []
            rows = []
            for value, file, block, n, k in zip(values, b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), at, strict=True):
                # The first record keeps its own mark, the later ones lost theirs to the separator.
                first = block == 0 and k == 0
                if not first or value.startswith(b">"):
                    rows.append((file, block, n, *parsed(value[1:] if first else value, int(k) + first, trim)))
            yield from _batches(rows, "file", "block", "ord")

    parts = sized.mapInArrow(run, f"file string, block long, ord long, {PARSED}")
    # A row for each split.
    placed = parts.join(F.broadcast(starts), ["file", "block"])
    fai = F.struct((F.col("fai.offset") + F.col("block_at")).alias("offset"), *(F.col(f"fai.{c}") for c in ("length", "line_bases", "line_width", "uniform")))
    return placed.select("file", "id", "header", "seq", fai.alias("fai"), "ord")


#: An id goes up to white space.
ID = re.compile(r"[^ \t\n\x0b\f\r]*")
FAI = "struct<offset:bigint,length:bigint,line_bases:bigint,line_width:bigint,uniform:boolean>"
PARSED = f"id string, header string, seq string, fai {FAI}"


def parsed(body: bytes, at: int, trim: bool = False) -> tuple[str, str, str, tuple]:
    """(id, header, seq, fai entry) of a record: the text after the header mark and the byte it starts at.

    ``trim``: lines lose white space at both ends, as reference sets are read; else one carriage return.
    """
    import numpy as np

    head, _, rest = body.partition(b"\n")
    header = head.removesuffix(b"\r").decode("utf-8", "replace")
    name = ID.match(header.strip(" "))[0]
    if trim or b"\r" in rest or not rest.isascii():
        raw = [x for x in rest.decode("utf-8", "replace").split("\n") if x not in ("", "\r")]
        kept = [x for x in (y.strip(" ") if trim else y.removesuffix("\r") for y in raw) if x]
        sizes, seq = np.array([len(x) for x in kept], np.int64), "".join(kept)
        width = len(raw[0].encode()) + 1 if raw else None
    else:
        # Plain lines: sizes from the line ends, and the sequence in one pass.
        ends = np.flatnonzero(np.frombuffer(rest, np.uint8) == 10)
        sizes = np.diff(np.concatenate(([-1], ends, [len(rest)]))) - 1
        sizes, seq = sizes[sizes > 0], rest.replace(b"\n", b"").decode()
        width = int(sizes[0]) + 1 if len(sizes) else None
    first = int(sizes[0]) if len(sizes) else None
    even = bool(len(sizes) == 0 or ((sizes[:-1] == first).all() and sizes[-1] <= first))
    return name, header, seq, (at + len(head) + 1, len(seq), first if even else None, width if even else None, even)


def _batches(rows: list[tuple], *keys: str):
    """Record batches of keys and parsed records."""
    import pyarrow as pa

    if rows:
        *columns, fai = zip(*rows, strict=True)
        kinds = [pa.string() if k == "file" else pa.int64() for k in keys] + [pa.string()] * 3
        entry = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("line_bases", pa.int64()), ("line_width", pa.int64()), ("uniform", pa.bool_())])
        names = ("offset", "length", "line_bases", "line_width", "uniform")
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([dict(zip(names, f, strict=True)) for f in fai], entry)], names=[*keys, "id", "header", "seq", "fai"])


def parse_records(rows: DataFrame, trim: bool = False) -> DataFrame:
    """Records from (file, ord, at, body): the text after the header mark and the byte it starts at."""

    def run(batches):
        for b in batches:
            columns = (c.to_pylist() for c in b.columns)
            yield from _batches([(file, n, *parsed(body, at, trim)) for file, n, at, body in zip(*columns, strict=True)], "file", "ord")

    out = rows.select("file", F.col("ord").cast("long"), F.col("at").cast("long"), F.col("body").cast("binary")).mapInArrow(run, f"file string, ord long, {PARSED}")
    return out.select("file", "id", "header", "seq", "fai", "ord")


def contig_ids(records: DataFrame) -> DataFrame:
    """Distinct ids only; the scan keeps no sequences."""
    return records.select("id").distinct()


def span(fai: Column | str = "fai") -> Column:
    f = F.col(fai) if isinstance(fai, str) else fai
    return byte_span(f["length"], f["line_bases"], f["line_width"], f["uniform"])


def extraction_plan(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(grp, id, pos, offset, bytes, skipped) of each wanted id; ids without a span are skipped, order is kept."""
    last = records.groupBy("id").agg(F.max_by(F.struct("fai", "seq", "header"), "ord").alias("r"))
    joined = groups.join(last, "id", "left").withColumn("bytes", span(F.col("r.fai")))
    return joined.select("grp", "id", "pos", F.col("r.fai.offset").alias("offset"), "bytes", F.col("bytes").isNull().alias("skipped"))


def contig_sequence(records: DataFrame, contig_id: str) -> DataFrame:
    """(id, header, seq) of one contig: no row if there is none, a null seq if its lines are uneven."""
    found = records.where(F.col("id") == contig_id)
    return found.select("id", "header", F.when(span("fai").isNotNull(), F.col("seq")).alias("seq"))


def bin_texts(members: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((bin_id, id, value), (bin_id, id)): records with their lines as they were, and the members left out.

    Records whose lines are uneven and ids that the assembly lacks are left out, as they have no span of bytes.
    """
    rows = members.join(records.select("id", "header", "seq", "fai"), "id", "left").withColumn("fits", span("fai").isNotNull())
    width, end = F.col("fai.line_bases").cast("int"), F.when(F.col("fai.line_width") - F.col("fai.line_bases") > 1, F.lit("\r\n")).otherwise(F.lit("\n"))
    starts = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width).cast("int"))
    lines = F.array_join(F.transform(starts, lambda k: F.substr("seq", k * width + 1, width)), "\n")
    text = F.concat(F.lit(">"), "header", F.lit("\n"), F.replace(lines, F.lit("\n"), end), F.when(end == "\r\n", F.lit("\r")).otherwise(F.lit("")))
    return rows.where("fits").select("bin_id", "id", text.alias("value")), rows.where("not fits").select("bin_id", "id")


def write_bins(members: DataFrame, records: DataFrame, path: str) -> DataFrame:
    """One folder of FASTA text for each bin_id; members are (bin_id, id). Returns the members left out."""
    texts, skipped = bin_texts(members, records)
    texts.select("bin_id", "value").write.partitionBy("bin_id").text(path)
    return skipped
