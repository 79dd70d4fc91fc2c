"""Training-data pipeline: quality, line dedup, near-dedup, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``; the last one the digests of the encoded texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm.common import staged, table
from tokenloom.llm.line_spread import dedup_lines
from tokenloom.llm.mixing import apply_mix
from tokenloom.llm.piece_bpe import digests
from tokenloom.llm.quality_knn import keep_good
from tokenloom.llm.queries import MIN_SITES, piece_model
from tokenloom.llm.simhash_bk import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.3 or more by nearest-neighbour voting."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Non-blank lines of any length on five or more sources stay in their first document only."""
    return dedup_lines(docs, min_sites=MIN_SITES, min_chars=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3-word shingles, 3 bits)."""
    return keep_one(docs, words=3, max_distance=3)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in turn at weights 5, 2, 1; a document comes as often as the mix takes it."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids and decoded text of every document, as digests."""
    return digests(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixture),
    ("sentencepiece", tokens)]

#: The classifier and the vocabulary can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
