"""Queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import blocks, byte_bpe, jaccard, media, neighbours, packing, secret_scan, suffixes, toxicity, warc
from .oracles import ORACLE_SQL  # noqa: F401


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.word_encoder(public_tokenizers.path("word_bpe_49k.json")))


def op2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.drop_repeats(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(table(spark, sf_dir, "documents"))[0]


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_documents(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_blocks": op2_blocks,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard": op4_jaccard,
    "jaccard_links": jaccard_links,
    "op5_neighbours": op5_neighbours,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffixes": op7_suffixes,
    "op8_media": op8_media,
    "op9_secrets": op9_secrets,
    "op10_warc": op10_warc,
}
