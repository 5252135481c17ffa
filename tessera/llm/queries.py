"""The queries over the synthetic tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights of the mixture; what is not named weighs 1.
MIX_WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import replace

    return replace(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fm_dedup import drop_passages

    return drop_passages(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import decontaminate, fm_dedup, ngram_join, quality

    return {"op1_decontamination": decontaminate.SQL, "op2_quality_rules": quality.SQL, "op4_substring_dedup": fm_dedup.SQL, "op5_ngram_jaccard_join": ngram_join.SQL}
