"""The training-data queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, copies, decontaminate, imatch, langid, merkle, omh, quality, quotes, secrets, suffixes, warc
from .common import read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), BYTE_BPE)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.ordered(read(spark, sf_dir, "conversations"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"), PIECES)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


def op8_omh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_duplicates(read(spark, sf_dir, "documents"))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_pairs(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(read(spark, sf_dir, "documents"))


def op12_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(read(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(read(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_bpe, op3_secrets, op4_chat, op5_language, op6_warc, op7_suffixes, op8_omh, op9_imatch, op10_quality, op11_merkle, op12_copies, op13_alignment)
}
ORACLE_SQL: dict[str, str] = {"op3_secrets": secrets.scan_sql(), "op6_warc": warc.SQL, "op11_merkle": merkle.SQL, "op12_copies": copies.SQL}
