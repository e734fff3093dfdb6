"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function) pairs. Each function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``documents``, whatever these are.

In every stage a null text counts as an empty one and stays null; other columns pass as
they are, also where they have names that the stages use themselves, but for ``n_chars``,
which follows a changed text; rows without an id are kept and never remove anything
from others; texts are handled whole, however long; repeated rows are treated alike; an
empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordflow.llm import jaccard, packing, secret_scan, suffixes, toxicity
from recordflow.llm.common import discard, materialise
from recordflow.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from ``labels``.

    Equal texts are judged alike, rows without an id included. Without labels of both kinds all rows stay.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that Jaccard links connect: the one with the smallest id.

    Rows of that id all stay, so do texts without words and rows without an id.
    """
    return jaccard.keep_first(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that documents with smaller ids have.

    A character that loses a byte goes as a whole. Rows without an id lose nothing.
    """
    return suffixes.cut_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.with_lengths(secret_scan.mask_column(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens.

    An empty text is the end token alone; ties of length are interchangeable.
    """
    return packing.pack(docs, packing.word_encoder(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("suffixes", drop_repeated_strings),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # SQL can't express the models of two stages; tests hold every stage, and run(), against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again, and goes when the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
