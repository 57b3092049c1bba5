"""The registered corpus queries: thin digests over the operators of this package."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, disclosure, exact, extract, langid, minhash, packing, periods, planes, quality, suffixes, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(table(spark, sf_dir, "documents")).drop("source")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_rows(table(spark, sf_dir, "documents"))


def op3_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_rows(table(spark, sf_dir, "documents"))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.plane_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_rows(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_rows(table(spark, sf_dir, "pages"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_rows(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where op11 plants a repetition in a text of n words: in a tenth of the documents, by their number's checksum alone."""
    checksum = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if checksum % 10 or not n:
        return None
    g = checksum // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_rows(table(spark, sf_dir, "documents"), planted)


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.personal_rows(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def corpus_queries() -> dict[str, Query]:
    found = (
        op1_quality_rules, op2_suffix_dedup, op3_pair_index_bpe, op4_exact_dedup, op5_token_planes, op6_dart_minhash, op7_warc, op8_html_extraction, op9_language_id, op10_best_fit_packing,
        op11_periodic_runs, op12_disclosure, op13_token_alignment,
    )
    return {f.__name__: f for f in found}
