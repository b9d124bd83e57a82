"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, decontaminate, html_text, line_dedup, merkle, ngram_join, quality, section_tokens, segment_topk, suffix_tree_lm, toxicity, wavelet, whitening
from marginalia.llm.merkle_sql import MANIFEST
from marginalia.llm.ngram_sql import NGRAM_JOIN

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens.count_by_section(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_documents(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_table(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_topk.nearest(_table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_text, op2_section_tokens, op3_toxicity, op4_decontaminate, op5_bpe, op6_lm_score, op7_line_dedup, op8_quality, op9_wavelet, op10_ngram_join, op11_merkle, op12_exact_topk, op13_whitening)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_ngram_join": NGRAM_JOIN, "op11_merkle": MANIFEST, "op12_exact_topk": segment_topk.NEAREST}
