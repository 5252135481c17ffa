"""From raw documents to balanced shards: quality, near copies, benchmark items, source mixture, shards.

Each stage reads what the one before it wrote. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Work
from tessera.llm.decontaminate import clean
from tessera.llm.mixing import mix
from tessera.llm.ngram_join import join
from tessera.llm.quality import judge
from tessera.llm.queries import MIX_WEIGHTS, table
from tessera.llm.sharding import assign_shards

#: Share of the remaining tokens that the mixture takes.
MIX_SHARE = 0.9
#: Near copies: words in a shingle, and the least similarity in percent.
NEAR = {"shingle": 5, "percent": 80}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    judged = judge(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return judged.filter("kept").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies."""
    kept = join(docs, **NEAR).filter(F.expr("doc_id <=> component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.expr("doc_id <=> kept_id"), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mixture, none more than once."""
    return mix(docs, weights=MIX_WEIGHTS, target_share=MIX_SHARE, max_epochs=1, keep=docs.columns).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return assign_shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharding),
]

#: Several stages can't be expressed in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
