"""Corpus preparation: nested records -> clean ``id, source, text`` documents.

B1 drop_empty_text, B2 canonical_documents, B3 reserved-token prefix,
B4 hash prefix, B9 prepare_corpus dispatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.text import col_

# Reserved special token per tokenizer name.
RESERVED_TOKENS = {
    "allenai/OLMo-2-1124-7B": "<|extra_id_0|>",
    "meta-llama/Meta-Llama-3-8B": "<|reserved_special_token_0|>",
}

# Pipeline names accepted by prepare_corpus.
CORPUS_MODES = ("pubmed_orig", "pubmed_reservedprefix", "pubmed_hashprefix")


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    """B1: keep rows whose (possibly nested) text is neither NULL nor ''. Whitespace-only stays.

    Both predicates reach the Parquet scan as pushed filters, nested paths included.
    """
    c = col_(text)
    return df.where(c.isNotNull() & (c != ""))


def canonical_documents(df: DataFrame, text: str = "text", source: str | None = None,
                        source_value: str | None = "pubmed") -> DataFrame:
    """B2: ``id, source, text``; id = md5 of the text (deterministic, unlike a salted hash)."""
    t = col_(text)
    src = F.col(source) if source else F.lit(source_value)
    return df.select(F.md5(t).alias("id"), src.cast("string").alias("source"), t.alias("text"))


def reserved_prefix(text, tokenizer_name: str, prefix_length: int = 1,
                    encode: Callable[[str], list[int]] | None = None):
    """``token * prefix_length + text``; unknown tokenizer names fail at plan time.

    With the tokenizer's ``encode`` the repeated token must encode as its own ids repeated, or the plan fails.
    """
    if tokenizer_name not in RESERVED_TOKENS:
        raise ValueError(f"Unknown tokenizer: {tokenizer_name}")
    if prefix_length < 0:
        raise ValueError("prefix_length must be >= 0")
    token = RESERVED_TOKENS[tokenizer_name]
    if encode is not None and list(encode(token * prefix_length)) != list(encode(token)) * prefix_length:
        raise ValueError(f"{token} repeated does not encode as its own ids")
    return F.concat(F.lit(token * prefix_length), col_(text))


def hash_prefix(text, prefix_length: int):
    """First ``prefix_length`` hex chars of md5(text) + text; more than 32 is an error."""
    if prefix_length > 32:
        raise ValueError("prefix_length should be <= 32 because md5 has 32 hex characters")
    t = col_(text)
    return F.concat(F.substring(F.md5(t), 1, prefix_length), t)


def prepare_corpus(df: DataFrame, mode: str, *, text: str = "text", source: str | None = None,
                   source_value: str | None = "pubmed", tokenizer_name: str | None = None,
                   prefix_length: int = 1, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """Filter empty texts, project ``id, source, text``, optionally prefix the text.

    The id is always the md5 of the unprefixed text.
    """
    if mode not in CORPUS_MODES:
        raise ValueError(f"Unknown dataset: {mode}")
    docs = canonical_documents(drop_empty_text(df, text), text, source, source_value)
    if mode == "pubmed_reservedprefix":
        docs = docs.withColumn("text", reserved_prefix("text", tokenizer_name or "", prefix_length, encode))
    elif mode == "pubmed_hashprefix":
        docs = docs.withColumn("text", hash_prefix("text", prefix_length))
    return docs
