"""A corpus pipeline of five stages over `documents`.

Language identification, exact deduplication, near deduplication, surrogates for personal data, packing. Each stage reads what its
predecessor wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import exact_dedup, langid, ngram_join, packing, pii
from tideline.llm.scratch import Scratch, made, release, table_of

#: Documents in which no language has this share are rejected, as are those without letters.
MIN_LANGUAGE_SHARE = 0.4
NEAR_WORDS, NEAR_PERCENT = 5, 80
CAPACITY, END_ID = 2048, 0

_left: list[Scratch] = []


def _stage(run: Callable) -> Callable:
    """docs is written when a stage starts, so the tables that the stage before left behind go."""

    @functools.wraps(run)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_left)
        before = made()
        out = run(spark, docs, sf_dir)
        _left[:] = [s for s in made() if s not in before]
        return out

    return staged


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; the models learn from all labelled documents."""
    return langid.accept(docs, langid.train(docs.select("doc_id", "text", "lang")), MIN_LANGUAGE_SHARE)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


@_stage
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates in place of personal data."""
    return pii.replace_entities(docs, spark.conf.get(pii.KEY_CONF, "no secret"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, CAPACITY)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("pii", private), ("packing", pack)]

#: A stage here fits models and another runs a tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark, "pipeline")
    docs = table_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
