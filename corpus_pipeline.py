"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them to the documents one after another, each result written as Parquet in the
shared folder and read again as the next one's input.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import default_tokenizer_path, encode_column, tokenizer_spec
from tidemark.llm.common import ensure_checkpoint_dir, read_table
from tidemark.llm.language import keep_known
from tidemark.llm.lines import drop_repeated_lines
from tidemark.llm.mixing import mix
from tidemark.llm.neardup import drop_near_duplicates
from tidemark.workspace import ship


def _stage(call: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that can also be called on its own, in a session that nothing has prepared."""

    @functools.wraps(call)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return call(spark, docs, sf_dir)

    return run


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that makes up half of them, go."""
    return keep_known(docs)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents that lose all their lines."""
    kept = drop_repeated_lines(docs, drop_emptied=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training set in training order: a row for each time that the mix takes a document."""
    return mix(docs)


@_stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded text."""
    spec = tokenizer_spec(default_tokenizer_path())
    return encode_column(docs.select("doc_id", "source", "lang", "text"), spec, "text", ids_col=None, digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

#: Language inference, the similarity joins and BPE aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise AssertionError("no stages")
