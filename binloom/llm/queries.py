"""Queries of the corpus operators over the driver's tables, and their DuckDB equivalents where SQL has any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, html_text, jaccard_join, language_crf, line_dedup, max_sketch, packing, quality_model, quality_rules, token_output, toxicity
from .common import table
from .labelled import fold
from .sql import ORACLE  # noqa: F401


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _scored(model, spark: SparkSession, sf_dir: str, folds: int, held: int) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fitted = model.fit(docs, labels, fold(F.col("doc_id"), folds) != held)
    scored = model.score(docs, fitted)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity, spark, sf_dir, 5, 0)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality_model, spark, sf_dir, 3, 1)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.kept(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), word_tokenizer())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(spark, table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = chat.transcripts(table(spark, sf_dir, "conversations"))
    model = chat.fit(raw.where(fold(F.col("conv_id"), 5) != 0))
    return chat.recover(raw.select("conv_id", "part", "text"), model)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(spark, table(spark, sf_dir, "documents"), word_tokenizer())


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    labelled = language_crf.predict(docs, language_crf.fit(docs, ~held_out))
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.scored(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_model": op2_quality_model,
    "op3_html_text": op3_html_text,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_chat_format": op9_chat_format,
    "op10_token_output": op10_token_output,
    "op11_language_id": op11_language_id,
    "op12_token_alignment": op12_token_alignment,
    "op13_ranked_search": op13_ranked_search,
}
