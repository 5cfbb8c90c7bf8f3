"""The corpus pipeline: documents in, token ids out.

Stages run in order; each gets the table that the one before it returned. All but
the last return the columns of ``documents``:

1. ``language``: documents whose language cannot be told (no text, no letter) go;
2. ``near_duplicates``: one document of each group stays (word shingles of five,
   similarity 0.8 or more);
3. ``passages``: passages that repeat another document's are cut out of the text;
4. ``benchmark``: documents that hold a window of a benchmark item go;
5. ``encode``: byte-level BPE ids of what is left, ``(doc_id, n_tokens, ids)``.

Null and empty texts, repeated rows and ties are treated as the operators' own
docstrings say; an empty table gives an empty table; other columns are carried
through to stage 4.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import bpe, decontaminate, language, neardup, paragraphs
from netsift.llm.common import free_shuffles, held_out, stage, table


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language."""
    model = language.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    # the operator adds columns; the table's own columns of these names are set aside meanwhile
    aside = docs.select(*[F.col(f"`{c}`").alias(f"own_{c}") for c in docs.columns])
    found = language.identify(aside, model, text_col="own_text").where(F.col("lang_pred") != language.UND)
    return found.select(*[F.col(f"`own_{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return neardup.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words that another document holds too; the first one keeps them."""
    return paragraphs.remove_repeats(docs, min_words=51)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document."""
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language", detect_language),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_passages),
    ("benchmark", drop_benchmark),
    ("encode", encode),
]

# language models and BPE cannot be written in SQL; tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
