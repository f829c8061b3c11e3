"""One query per operator over the tables of a folder, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import stage
from . import alignment, decontamination, exact, licences, mixing, near, packing, passages, quality, search, secrets, toxicity, urls


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return secrets.find_secrets(docs, owner=docs["source"], repository=docs["lang"])


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return licences.scan_licences(docs, directory=F.concat_ws("/", docs["source"], docs["lang"]))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_docs(spark, sf_dir))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(_docs(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), tokenizer_path()).drop("copy")


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(*exact.split_by_age(stage(exact.text_digests(_docs(spark, sf_dir)), "digests")))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.rule_table(spark))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.toxicity(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_docs(spark, sf_dir), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(_docs(spark, sf_dir), _benchmark(spark, sf_dir)).drop("items")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_docs(spark, sf_dir), _benchmark(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_licences, op3_near_duplicates, op4_passages, op5_mixing, op6_packing, op7_exact, op8_urls, op9_quality, op10_toxicity, op11_alignment, op12_decontamination, op13_search)}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return SQL
