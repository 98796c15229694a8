"""From raw documents to packed sequences, one operator a stage.

Each stage works on all rows that its predecessor kept, written as Parquet and
read again.  All but the last return the columns of ``documents``.

Defined results, for every stage: a null text is empty; rows are told apart by
their place in the stage's input, so null and repeated numbers keep or drop no
other row (the two deduplications keep one row of a group: the longest, then the
smallest number, and the smallest number, null last); repeated rows are rows of
their own; columns of any name pass unchanged, but for the text and ``n_chars``
that mixing cuts; a document may leave mixing as several rows, one for each
copy or part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import exact_dedup_lsm, mixing_sainte_lague, near_jaccard, packing_bfd, quality_ftrl
from codequarry.llm.common import crc_of_id, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality_ftrl.fit(docs, table(spark, sf_dir, "labels"), crc_of_id(F.col("doc_id")) % 5 != 0)
    return quality_ftrl.keep_good(docs, weights)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup_lsm.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest number.

    Pipeline documents are near-duplicates if their sets of five-word shingles
    have a Jaccard similarity of at least 0.8.  Bit-sliced SimHash names candidates
    first, min-hash bands those beyond its radius.
    """
    return near_jaccard.keep_first(docs, words=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents taken in part, once or up to twice, one row each."""
    return mixing_sainte_lague.mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens."""
    import public_tokenizers

    return packing_bfd.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashing to 64 bits, trained weights and tokenizing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
