"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask of ones and zeros is laid over the words of a text at every position; the words under its ones make a seed,
those under its zeros may differ. Seeds of the training texts are joined with the seeds of the benchmark items by
hash. A hit names an item and a diagonal (text position less item position). Each distinct diagonal is verified by
comparing the words of item and text along it: a document is contaminated where a run of ``window`` item words (the
whole item, if shorter) has at least ``min_match`` of them equal in place. Substituted words cost only themselves.

The masks are lossless for that rule: whichever words of a run of 8 to 16 differ, as long as three quarters agree,
one of the masks fits the words that agree, so no overlap the rule accepts is missed. The tests go through all
patterns. Other values of ``window``, ``min_match`` or ``min_words`` need masks found for them. An item of fewer than
``min_words`` words is too short to tolerate substitutions: its mask is all ones and as long as the item, and it
matches where all its words stand in a row.

Edge cases: a very long text is looked at whole, its words as rows. Of equal shares the larger counts once.
Null and empty texts and items match nothing. Rows with a null doc_id are reported clean. Rows that repeat a doc_id share one verdict. Repeated items count once by item_id.
Extra columns are ignored. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, ascii_lower, discard, indices, stored, words

#: Parts that the rows of one seed or one item are dealt to where their table is too large to broadcast.
SALTS = 32


@dataclass(frozen=True)
class Seeds:
    masks: tuple[str, ...] = ("11101", "100111", "1101001")
    window: int = 16
    min_match: float = 0.75
    min_words: int = 8


def text_words(text: str = "text") -> Column:
    return words(ascii_lower(F.col(text)))


def seed_hash(h: Column, at: Column, mask: str) -> Column:
    """The seed at position ``at`` of the word hashes ``h``, null where the mask runs past the end; the mask is part of it."""
    ones = [i for i, bit in enumerate(mask) if bit == "1"]
    return F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(mask), *[F.get(h, at + k) for k in ones]))


def _hashes(df: DataFrame, key: str) -> DataFrame:
    """(key, h, pos): the word hashes of a text, once for each of its positions. Each word is hashed once; positions are
    rows before seeds are made, so that seeds are compiled code."""
    rows = df.select(key, F.transform(text_words(), lambda x: F.xxhash64(x)).alias("h"))
    return rows.select(key, "h", F.posexplode("h").alias("pos", "word"))


def _seeded(at: DataFrame, key: str, masks: tuple[str, ...]) -> DataFrame:
    """(key, pos, seed) of the masks at each position."""
    seeds = F.array(*[seed_hash(F.col("h"), F.col("pos"), m) for m in masks])
    return at.select(key, "pos", F.explode(seeds).alias("seed")).where("seed is not null")


def item_seeds(benchmark: DataFrame, seeds: Seeds = Seeds()) -> tuple[DataFrame, tuple[str, ...]]:
    """(item_id, item_pos, seed), and the masks they are made with: one for each length of short items besides the given."""
    at = _hashes(benchmark, "item_id")
    n = F.size("h")
    short = at.where((n < seeds.min_words) & (F.col("pos") == 0))
    # Fewer than ``min_words`` rows.
    ones = tuple("1" * r[0] for r in short.select(n).distinct().collect())
    known = _seeded(at.where(n >= seeds.min_words), "item_id", seeds.masks)
    for m in ones:
        known = known.unionByName(_seeded(short.where(n == len(m)), "item_id", (m,)))
    return known.withColumnRenamed("pos", "item_pos").distinct(), seeds.masks + ones


def _met(many: DataFrame, few: DataFrame, key: str, bytes_: int, part: Column, send: int) -> DataFrame:
    """``many`` joined with ``few`` by ``key``. Where ``few`` is too large to broadcast, each of its rows is joined once for
    each part of ``many``, so that the rows of a frequent key are dealt over SALTS tasks."""
    if bytes_ <= send:
        return many.join(F.broadcast(few), key)
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(part), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("_salt", F.explode(indices(F.lit(SALTS)))), [key, "_salt"]).drop("_salt")


def hits(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), send: int = BROADCAST_LIMIT) -> DataFrame:
    """Distinct (doc_id, item_id, diagonal) of which some seed agrees, as a stored table."""
    known, masks = item_seeds(benchmark, seeds)
    known = stored(known, "seeds")
    places = _seeded(_hashes(docs.where("doc_id is not null"), "doc_id"), "doc_id", masks)
    found = _met(places, known, "seed", 64 * known.count(), F.struct("doc_id", "pos"), send)
    out = stored(found.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct(), "hits")
    discard(known)
    return out


def _best_window(w: Column, item: Column, diagonal: Column, seeds: Seeds) -> Column:
    """The largest share of equal words in a window of the item along the diagonal."""
    same = F.transform(item, lambda x, i: F.coalesce((F.get(w, i + diagonal) == x).cast("int"), F.lit(0)))
    span = F.least(F.size(item), F.lit(seeds.window))

    def best(m: Column) -> Column:
        sums = F.transform(indices(F.size(m) - span + 1), lambda q: F.aggregate(F.slice(m, q + 1, span), F.lit(0), lambda a, x: a + x))
        return F.array_max(sums) / span

    return F.transform(F.array(same), best)[0]


def overlaps(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), send: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, item_id, share): the verified overlaps of documents with benchmark items, as a stored table."""
    b = benchmark.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    found = hits(docs, b, seeds, send)
    bytes_ = b.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    items = b.select("item_id", text_words().alias("item"))
    per_doc = found.groupBy("doc_id", "item_id").agg(F.collect_set("diagonal").alias("diagonals"))
    # Items are short: they travel to the texts, not the texts to them.
    wanted = _met(per_doc, items, "item_id", 4 * bytes_, F.col("doc_id"), send)
    ids = found.select("doc_id").distinct()
    ids = F.broadcast(ids) if 16 * found.count() <= send else ids
    texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", text_words().alias("w"))
    share = F.array_max(F.transform("diagonals", lambda d: _best_window(F.col("w"), F.col("item"), d, seeds)))
    least = F.when(F.size("item") < seeds.min_words, F.lit(1.0)).otherwise(F.lit(seeds.min_match))
    scored = texts.join(wanted, "doc_id").select("doc_id", "item_id", share.alias("share"), least.alias("least"))
    out = stored(scored.where("share >= least").groupBy("doc_id", "item_id").agg(F.max("share").alias("share")), "overlaps")
    discard(found)
    return out


def verdicts(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), send: int = BROADCAST_LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items, best_share."""
    found = overlaps(docs, benchmark, seeds, send).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.max("share").alias("best_share"))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"))


def clean(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """The documents without a verified overlap, with all their columns."""
    return docs.join(overlaps(docs, benchmark, seeds).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
