"""The corpus pipeline: documents in, packed training sequences out, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common, langid, mixing, packing, secrets, simhash, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or not a letter in the text) go; a missing lang is filled with the prediction.

    Where no document is labelled there is nothing to predict: those with a letter stay as they are.
    """
    model = langid.train(docs, ~langid.held_out())
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found, score = common.fresh(docs, "lang_pred", "score")
    scored = langid.predict(docs, model, lang_name=found, score_name=score).where(F.col(found) != langid.UNDETERMINED)
    return scored.withColumn("lang", F.coalesce("lang", found)).drop(found, score)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, that with the smallest doc_id."""
    return simhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets in the text are replaced; n_chars follows the text."""
    forest = secrets.train(secrets.labelled_findings(spark))
    return secrets.redact(docs, forest).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that the sources meet their targets."""
    return mixing.Mix(docs).documents()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: SimHash, the forest and the tokenizer can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
