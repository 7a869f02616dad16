"""Reads by place: sequences of an indexed FASTA file, and splits of block-compressed files, each read by seeking."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fasta import PARSED, _batches, parsed, span

#: Rows of a row group of an index, which is what a reader looks at or leaves out.
INDEX_ROWS = 8_192
#: Compressed bytes of a task.
SPLIT_BYTES = 8 << 20
#: How a member of a block-compressed file begins, and its extra field.
MEMBER, FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


def opened(uri: str):
    """A file of any store that Arrow knows (local, HDFS, S3, GCS), to be read at any place."""
    from pyarrow.fs import FileSystem

    store, path = FileSystem.from_uri(uri)
    return store.open_input_file(path)


# An index on disk


def write_index(records: DataFrame, path: str, group_rows: int = INDEX_ROWS) -> None:
    """A table of (file, id, header, offset, bytes, ord), sorted by id: where each sequence lies. Sequences are not read
    beyond the scan; a null ``bytes`` says that the lines are uneven or empty."""
    rows = records.select("file", "id", "header", F.col("fai.offset").alias("offset"), span("fai").alias("bytes"), "ord")
    last = rows.groupBy("id").agg(F.max_by(F.struct("file", "header", "offset", "bytes", "ord"), F.struct("file", "ord")).alias("r")).select("id", "r.*")
    sorted_ = last.select("file", "id", "header", "offset", "bytes", "ord").repartitionByRange("id").sortWithinPartitions("id")
    sorted_.write.option("parquet.block.row.count.limit", str(group_rows)).parquet(path)


def raw_spans(entries: DataFrame) -> DataFrame:
    """``entries``, which have file, offset and bytes, with ``raw``: the bytes of each span, in its file's order.

    A task reads its spans by seeking, ascending; nothing between them is read. Entries without a span have no raw.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    names = entries.columns

    def run(batches):
        import pyarrow as pa

        at_file, handle = None, None
        for b in batches:
            raw = []
            for file, offset, size in zip(*(b.column(names.index(c)).to_pylist() for c in ("file", "offset", "bytes")), strict=True):
                if size is None:
                    raw.append(None)
                    continue
                if file != at_file:
                    if handle is not None:
                        handle.close()
                    at_file, handle = file, opened(file)
                raw.append(handle.read_at(size, offset))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*names, "raw"])
        if handle is not None:
            handle.close()

    return entries.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, f"{kinds}, raw binary")


def extracted(groups: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((grp, id, pos, value), (grp, id, pos)): FASTA text of the wanted ids as it stands in the files, and the ids left out.

    ``index`` is what ``write_index`` wrote. Only the wanted spans are read, each once however many groups want it: the
    groups of an id go with its span, so that no text is joined, shuffled or sent to all tasks.
    """
    found = groups.join(index, "id", "left")
    wants = groups.groupBy("id").agg(F.collect_list(F.struct("grp", "pos")).alias("wants"))
    wanted = index.where("bytes is not null").join(wants, "id")
    text = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("raw").cast("string"))
    whole = F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))
    texts = raw_spans(wanted).select("id", whole.alias("value"), F.explode("wants").alias("w"))
    skipped = found.where("bytes is null").select("grp", "id", "pos")
    return texts.select("w.grp", "id", "w.pos", "value"), skipped


class FastaSpans(DataSource):
    """Sequences of an indexed FASTA file. Options: ``index``, the folder that ``write_index`` wrote, and ``ids``, a JSON
    list of wanted ids (all, if it is missing). A partition is a row group of the index, and those that cannot hold a
    wanted id are left out; a task reads its wanted spans only. Rows: id, header, seq, and the bytes read for it."""

    @classmethod
    def name(cls) -> str:
        return "fasta_spans"

    def schema(self) -> str:
        return "id string, header string, seq string, bytes bigint"

    def reader(self, schema) -> SpanReader:
        return SpanReader(self.options["index"], json.loads(self.options["ids"]) if "ids" in self.options else None)


class SpanReader(DataSourceReader):
    def __init__(self, index: str, ids: list[str] | None):
        self.index, self.ids = index, ids

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileSystem

        store, path = FileSystem.from_uri(self.index)
        out = []
        for info in sorted(store.get_file_info(FileSelector(path)), key=lambda i: i.path):
            if info.base_name.endswith(".parquet"):
                out += [InputPartition((info.path, k)) for k in self._groups(store, info.path)]
        return out

    def _groups(self, store, path: str) -> list[int]:
        import pyarrow.parquet as pq

        with store.open_input_file(path) as f:
            meta = pq.ParquetFile(f).metadata
            column = meta.schema.to_arrow_schema().get_field_index("id")
            groups = [meta.row_group(k).column(column).statistics for k in range(meta.num_row_groups)]
        may = lambda s: self.ids is None or s is None or not s.has_min_max or any(s.min <= i <= s.max for i in self.ids)
        return [k for k, s in enumerate(groups) if may(s)]

    def read(self, partition: InputPartition):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        store, _ = FileSystem.from_uri(self.index)
        path, group = partition.value
        with store.open_input_file(path) as f:
            rows = pq.ParquetFile(f).read_row_group(group).to_pylist()
        wanted, at_file, handle = None if self.ids is None else set(self.ids), None, None
        for r in sorted((r for r in rows if wanted is None or r["id"] in wanted), key=lambda r: (r["file"], r["offset"])):
            if r["bytes"] is None:
                yield (r["id"], r["header"], None, 0)
                continue
            if r["file"] != at_file:
                at_file, handle = r["file"], opened(r["file"])
            raw = handle.read_at(r["bytes"], r["offset"])
            yield (r["id"], r["header"], raw.translate(None, b"\r\n").decode("utf-8", "replace"), len(raw))


def sequences(spark: SparkSession, index: str, ids: list[str] | None = None) -> DataFrame:
    """(id, header, seq, bytes) of the wanted ids; a null seq where the lines are uneven, no row where there is none."""
    spark.dataSource.register(FastaSpans)
    reader = spark.read.format("fasta_spans").option("index", index)
    return (reader if ids is None else reader.option("ids", json.dumps(ids))).load()


# Block-compressed files


def is_blocked(head: bytes) -> bool:
    """Whether a compressed file's first 18 bytes are those of a member that tells its size."""
    return len(head) >= 18 and head.startswith(MEMBER) and head[12:16] == FIELD


def _first_member(f, start: int, size: int) -> int:
    """The place of the first member at ``start`` or behind; ``size`` if there is none."""
    at = start
    while at < size:
        chunk = f.read_at(min(1 << 17, size - at), at)
        k = chunk.find(MEMBER)
        while k >= 0:
            head = f.read_at(18, at + k)
            if is_blocked(head):
                after = at + k + int.from_bytes(head[16:18], "little") + 1
                # By chance, data may look like a member; then no member stands where it would end.
                if after == size or (after < size and is_blocked(f.read_at(18, after))):
                    return at + k
            k = chunk.find(MEMBER, k + 1)
        at += max(1, len(chunk) - 3)
    return size


def _members(f, at: int, size: int):
    """(place, bytes) of the members from ``at`` on."""
    while at < size:
        n = int.from_bytes(f.read_at(2, at + 16), "little") + 1
        yield at, n
        at += n


def _unpacked_size(file: str, start: int, stop: int, size: int) -> int:
    """Bytes of text of the members that begin in a split; told by the members' ends, without unpacking."""
    with opened(file) as f:
        at, total = _first_member(f, start, size), 0
        if at < stop:
            for place, n in _members(f, at, size):
                if place >= stop:
                    break
                total += int.from_bytes(f.read_at(4, place + n - 4), "little")
        return total


def _split_records(file: str, start: int, stop: int, size: int):
    """(body, place of the body in the split's text) of the records that begin in a split: those whose mark is
    behind a line end in it, or at the file's beginning. The last one is read on into the next splits."""
    import re
    import zlib

    with opened(file) as f:
        at = _first_member(f, start, size)
        if at >= stop:
            return
        walk = _members(f, at, size)
        own, rest = [], None
        for place, n in walk:
            data = zlib.decompress(f.read_at(n, place), 31)
            if place >= stop:
                rest = data
                break
            own.append(data)
        # A line end is put before the file's first byte.
        lead = start == 0
        text = b"".join([b"\n"] * lead + own)
        limit = len(text)
        marks = [m.start() for m in re.finditer(b"\n>", text)]
        more = text[-1:] + (rest or b"")
        if limit and rest is not None and more.startswith(b"\n>"):
            marks.append(limit - 1)
        if not marks:
            return
        tail, end = [rest] if rest is not None else [], None
        if rest is not None:
            # The next mark whose line end is not ours ends the last record.
            seen, joined = 0, rest
            while (k := joined.find(b"\n>", seen)) < 0:
                step = next(walk, None)
                if step is None:
                    break
                seen = max(0, len(joined) - 1)
                joined += zlib.decompress(f.read_at(step[1], step[0]), 31)
            tail, end = [joined], k if k >= 0 else None
        text = b"".join([text, *tail])
        stops = [*marks[1:], limit + end if end is not None else len(text)]
        for mark, until in zip(marks, stops, strict=True):
            yield text[mark + 2 : until], mark + 2 - lead


def read_blocked(spark: SparkSession, files: list[tuple[str, int]], trim: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``fasta.read_fasta`` of block-compressed files, (file, size): any number of tasks unpack a file.

    A split holds the members that begin in it. Offsets count in the unpacked text; the sizes before a split come from a
    walk over the members' heads. ``ord`` is the record's place.
    """
    sizes = spark.createDataFrame(files, "file string, size long")
    splits = sizes.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("block"))
    count = sum(-(-size // split_bytes) for _, size in files)
    splits = splits.repartition(max(1, count)).select("file", "size", "block")

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([_unpacked_size(f, k, k + split_bytes, n) for f, n, k in rows], pa.int64())], names=["file", "block", "n"])

    def unpack(batches):
        for b in batches:
            for file, size, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                for body, at in _split_records(file, block, block + split_bytes, size):
                    rows.append((file, block, *parsed(body, at, trim)))
                    if len(rows) == 64:
                        yield from _batches(rows, "file", "block")
                        rows = []
                yield from _batches(rows, "file", "block")

    from pyspark.sql import Window as W

    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = splits.mapInArrow(measure, "file string, block long, n long").select("file", "block", F.coalesce(before, F.lit(0)).cast("long").alias("block_at"))
    parts = splits.mapInArrow(unpack, f"file string, block long, {PARSED}").join(F.broadcast(starts), ["file", "block"])
    fai = F.struct((F.col("fai.offset") + F.col("block_at")).alias("offset"), *(F.col(f"fai.{c}") for c in ("length", "line_bases", "line_width", "uniform")))
    return parts.select("file", "id", "header", "seq", fai.alias("fai")).withColumn("ord", F.col("fai.offset"))
