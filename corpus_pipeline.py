"""A corpus pipeline of five operators; each stage is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import exact, mixing, near, packing, toxicity
from cadenza.llm.queries import tokenizer_path
from cadenza.sources.staging import drop_staged, stage, staged_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents, without those that the model rejects."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the smallest id."""
    return exact.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    return near.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places; ``copy`` numbers the rows, so those that repeat are told apart."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near duplicates", drop_near), ("mixing", mix), ("packing", pack),
]

#: Toxicity scores and packing are not SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir`` after all stages (columns of :func:`packing.pack`).

    * null and empty texts pass toxicity as the bias decides, are copies of one another, and
      have no words for the mix to take
    * rows without ``doc_id`` are never dropped as duplicates; rows that repeat an id are judged
      each by its own text
    * an empty table gives an empty result; extra columns go through up to the mix
    * once a stage is written, the tables that it and the one before staged are deleted
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with staged_tables() as staged:
        for i, (name, stage_of) in enumerate(STAGES):
            docs = stage_of(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = stage(docs, name.replace(" ", "-"))
                drop_staged(spark, staged, keep=1)
    return docs
