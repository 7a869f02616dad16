"""Ranked lexical search over hashed max-sketches of the documents.

A document's score for an item sums, over the item's terms, a weight by rarity times an impact that grows with the
term's occurrences and falls with the document's length. ``index`` folds each document into an array of cells: every
term is hashed to a few cells, and a cell keeps the largest of what its terms bring. What is kept is the number of
occurrences, which within a document orders the impacts; the impact follows from it once the mean length of all
documents is known. The least of a term's cells bounds its impact from above, so that the sums bound the scores.

``search`` looks the terms of a block of items up in the sketches of many documents at once. The documents with the
highest bounds are scored exactly from their texts; the k-th of these scores is a threshold, and all documents whose
bound reaches it are scored exactly. What stays below cannot be among the first k, so the result is exact.

Items come in blocks of bounded size, and all documents are searched for each block. A task sends the best k of each
item only, so that no item gathers in one task, however many documents tie.

Edge cases: null texts and texts without terms have no score. Very long texts get more cells, up to ``most_cells``;
beyond, bounds are looser and results the same. Rows with a null doc_id are left out and not counted. Rows that repeat
a doc_id are documents of their own. Items that repeat an item_id are one item with the terms of all its rows; items
without an item_id, a text or terms have no rows. Equal scores rank by doc_id. Extra columns are ignored. Empty tables
give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, maybe_broadcast, small_batches, stored
from .jaccard_join import WordHashes

#: Bytes of a text to its terms: A-Z lower-cased, all other ASCII but letters and digits are blanks.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
INDEX = "doc_id long, n long, sketch binary"
FOUND = "item int, doc_id long, score long"


@dataclass(frozen=True)
class Settings:
    cells: int = 8  # of a document for each of its distinct terms, at least
    hashes: int = 3  # cells of a term
    most_cells: int = 1 << 21
    block_bytes: int = 4 << 20  # of items that are searched together, about


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLDED).split()


def _cells(hashed, cells: int, k: int):
    """Cell numbers (k, terms) of 64-bit hashes; ``cells`` is a power of two of 21 bits at most."""
    import numpy as np

    return np.stack([(hashed >> np.uint64(21 * i)) & np.uint64(cells - 1) for i in range(k)]).astype(np.int64)


def sketch(hashed, s: Settings = Settings()):
    """The cells of a document by the 64-bit hashes of all its terms: the most occurrences of their terms, up to 255."""
    import numpy as np

    distinct, tf = np.unique(hashed, return_counts=True)
    cells = min(s.most_cells, max(64, 1 << (s.cells * len(distinct) - 1).bit_length()))
    out = np.zeros(cells, np.uint8)
    order = np.argsort(tf, kind="stable")  # the largest is written last
    out[_cells(distinct[order], cells, s.hashes).T.ravel()] = np.repeat(np.minimum(tf[order], 255), s.hashes)
    return out


def index(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """INDEX: each document's number of terms and sketch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for b in batches:
            n, cells = [], []
            for text in b.column(1).to_pylist():
                found = terms(text)
                n.append(len(found))
                cells.append(sketch(np.frombuffer(b"".join(map(hashes.__getitem__, found)), "<u8"), s).tobytes() if found else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cells, pa.binary())], names=["doc_id", "n", "sketch"])

    return _texts(docs).mapInArrow(run, INDEX)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def length_part(n, total: int, documents: int):
    """What a document of n terms adds to a term's occurrences in the impact's divisor, before its factor."""
    return 75 + 25 * n * documents // total


def impact(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def document_counts(docs: DataFrame, wanted: list[bytes]) -> dict[int, int]:
    """For each wanted term, by its place, the documents that hold it; only found ones are there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        place, counts = {t: i for i, t in enumerate(wanted)}, np.zeros(len(wanted), np.int64)
        for b in batches:
            for text in b.column(1).to_pylist():
                for t in place.keys() & set(terms(text)):
                    counts[place[t]] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "df"])

    rows = _texts(docs).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.collect()}  # a row for each term of a block of items at most


@dataclass
class Queries:
    """A block of items: their terms, and for each term the items that hold it with repeats times weight."""

    ids: list[int]
    wanted: list[bytes]
    of_item: list[list[tuple[int, int]]]  # (term, repeats times weight)
    total: int
    documents: int

    def postings(self):
        """Arrays (start of each term, item, value), by term."""
        import numpy as np

        rows = sorted((t, i, v) for i, found in enumerate(self.of_item) for t, v in found)
        t, i, v = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        return np.searchsorted(t, np.arange(len(self.wanted) + 1)), i, v.astype(np.float64)


def _bounds(q: Queries, s: Settings):
    """A function of index batches: yields (doc_ids, bounds (documents, items)) of groups of documents."""
    import numpy as np

    hashes = WordHashes()
    hashed = np.frombuffer(b"".join(map(hashes.__getitem__, q.wanted)), "<u8")
    start, items, values = q.postings()
    sizes, places = np.diff(start), {}
    levels = np.arange(256)

    def of(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                n = np.asarray(part.column(1))
                level = np.zeros((len(n), len(hashed)), np.uint8)
                for row, cells in enumerate(part.column(2)):
                    cells = np.frombuffer(cells.as_buffer(), np.uint8)
                    if len(cells):
                        if len(cells) not in places:
                            places[len(cells)] = _cells(hashed, len(cells), s.hashes)
                        level[row] = cells[places[len(cells)]].min(0)
                d, t = np.nonzero(level)
                table = impact(levels[None, :], length_part(n, q.total, q.documents)[:, None])
                table[:, 255] = 1_000_000  # so often or more: what no impact exceeds
                # Integers below 2^53 throughout, so that the sums of doubles are exact.
                worth = table[d, level[d, t]].astype(np.float64)
                many = sizes[t]
                post = np.arange(many.sum()) + np.repeat(start[t] - np.cumsum(many) + many, many)
                sums = np.bincount(np.repeat(d, many) * len(q.ids) + items[post], np.repeat(worth, many) * values[post], len(n) * len(q.ids))
                yield np.asarray(part.column(0)), sums.reshape(len(n), len(q.ids)).astype(np.int64)

    return of


class Best:
    """The k best (score, doc_id) of each item, scores above 0; equal scores by ascending doc_id."""

    def __init__(self, items: int, k: int):
        self.items, self.k, self.rows = items, k, []
        self.held = 0

    def add(self, item, doc_id, score) -> None:
        self.rows.append((item, doc_id, score))
        self.held += len(item)
        if self.held > 4 * self.k * self.items + 100_000:
            self.rows = [self.cut()]
            self.held = len(self.rows[0][0])

    def cut(self):
        import numpy as np

        item, doc_id, score = (np.concatenate([np.asarray(r[c], np.int64) for r in self.rows]) if self.rows else np.zeros(0, np.int64) for c in range(3))
        order = np.lexsort((doc_id, -score, item))
        item, doc_id, score = item[order], doc_id[order], score[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        keep = (nth < self.k) & (score > 0)
        return item[keep], doc_id[keep], score[keep]

    def batch(self):
        import numpy as np
        import pyarrow as pa

        item, doc_id, score = self.cut()
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc_id), pa.array(score)], names=["item", "doc_id", "score"])


def highest_bounds(indexed: DataFrame, q: Queries, k: int, s: Settings) -> DataFrame:
    """(item, doc_id, score): the k highest bounds of each item."""

    def run(batches):
        import numpy as np

        best, floor = Best(len(q.ids), k), np.zeros(len(q.ids), np.int64)
        for ids, bounds in _bounds(q, s)(batches):
            # Each group of documents can add its own k best at most.
            top = np.argpartition(bounds, max(0, len(ids) - k), axis=0)[-k:] if len(ids) > k else np.tile(np.arange(len(ids))[:, None], (1, len(q.ids)))
            item = np.broadcast_to(np.arange(len(q.ids)), top.shape)
            value = bounds[top, item]
            np.maximum(floor, value.min(0) if len(top) == k else 0, out=floor)
            good = (value > 0) & (value >= floor)
            best.add(item[good], ids[top[good]], value[good])
        yield best.batch()

    return first_rows(indexed.mapInArrow(run, FOUND), k)


def reaching(indexed: DataFrame, q: Queries, floors: list[int], s: Settings) -> DataFrame:
    """(item, doc_id): documents whose bound reaches the item's threshold."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        least = np.maximum(np.array(floors, np.int64), 1)
        for ids, bounds in _bounds(q, s)(batches):
            d, item = np.nonzero(bounds >= least)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids[d])], names=["item", "doc_id"])

    return indexed.mapInArrow(run, "item int, doc_id long")


def rescored(docs: DataFrame, candidates: DataFrame, q: Queries, k: int) -> DataFrame:
    """(item, doc_id, score): exact scores of the candidates, the k best of each item."""

    def run(batches):
        best = Best(len(q.ids), k)
        for b in batches:
            for doc_id, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = terms(text)
                tf, m = Counter(found), length_part(len(found), q.total, q.documents)
                scores = [sum(v * impact(tf[q.wanted[t]], m) for t, v in q.of_item[i] if q.wanted[t] in tf) for i in wanted]
                best.add(wanted, [doc_id] * len(wanted), scores)
        yield best.batch()

    by_doc = stored(candidates.groupBy("doc_id").agg(F.collect_set("item").alias("items")), "candidates")
    rows = by_doc.agg(F.count(F.lit(1)), F.sum(F.size("items"))).first()
    sent = maybe_broadcast(by_doc, 1, 64 * rows[0] + 8 * (rows[1] or 0))
    out = stored(first_rows(_texts(docs).join(sent, "doc_id").mapInArrow(run, FOUND), k), "scores")
    discard(by_doc)
    return out


def first_rows(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each item, of rows that tasks have cut already: by shares of the tasks first."""
    order = (F.desc("score"), F.asc("doc_id"))
    some = rows.withColumn("share", F.spark_partition_id() % 64)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("item", "share").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "doc_id", "score", "rank")


def _blocks(items: DataFrame, s: Settings):
    """Blocks of items as lists of (item_id, terms)."""
    rows = items.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id"))
    rows = rows.agg(F.array_join(F.sort_array(F.collect_list(F.col("text").cast("string"))), " ").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // s.block_bytes + 1
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id").collect()  # block_bytes, about
        if found := [(r.item_id, t) for r in block if (t := terms(r.text.encode()))]:
            yield found


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 20, s: Settings = Settings(), indexed: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item. ``indexed`` is a stored index of ``docs``."""
    out, own = [], None
    with small_batches(spark, 256):
        if indexed is None:
            indexed = own = stored(index(docs, s), "sketches", compression="zstd")
        total, documents = indexed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
        for block in _blocks(items, s) if total else ():
            wanted = sorted({t for _, found in block for t in found})
            place, df = {t: i for i, t in enumerate(wanted)}, document_counts(docs, wanted)
            weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(wanted))]
            of_item = [[(place[t], n * weight[place[t]]) for t, n in sorted(Counter(found).items())] for _, found in block]
            q = Queries([i for i, _ in block], wanted, of_item, total, documents)
            first = rescored(docs, highest_bounds(indexed, q, k, s), q, k)
            # One row for each item of the block.
            floors = {r.item: r.score for r in first.where(F.col("rank") == k).collect()}
            found = rescored(docs, reaching(indexed, q, [floors.get(i, 0) for i in range(len(block))], s), q, k)
            discard(first)
            ids = spark.createDataFrame(list(enumerate(q.ids)), "item int, item_id long")
            out.append(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if own is not None:
        discard(own)  # the scores are stored
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)
