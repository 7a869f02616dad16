"""Corpus preparation: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs
of the next. All but the last return the columns of ``documents``, with their names and types, whatever they are.

Edge cases: rows with a null doc_id, and null, empty and very long texts pass every filter unless their text is
rejected; packing leaves rows without a doc_id out. Line dedup returns a null text as empty. Repeated rows stay as
they are. Nulls in other columns are kept. An empty table gives an empty result in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from binloom.llm.common import discard, fleeting, stored, table
from binloom.llm.queries import word_tokenizer

#: The near-duplicate stage works on five-word shingles at a similarity of 0.8.
NEAR = jaccard_join.Settings(words=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.accepted(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in the last of them only; n_chars follows the text."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.representatives(spark, docs, NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces placed in sequences."""
    return packing.pack(spark, docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Trained trees and tokenizer merges have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        # A stage's own tables go once its result is written.
        with fleeting(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        discard(*read)
        read = [docs]
    return docs
