"""From raw documents to training shards in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage
before kept. All but the last return the columns of documents; the last one
returns the place of every document of the mixture. A document that the mixture
takes twice is two rows from then on.

The two stages that SQL cannot express are the join (components) and the
packing, so there is no SQL form; tests hold the whole run against a
brute-force version.

Defined cases: a null or empty text fails the first stage's rules, so it goes
there; in a stage called on its own such a document is nobody's copy, holds no
passage, is no part of a mixture and takes eight bytes of a shard. Repeated rows
and equal texts are copies, of which the least doc_id stays (null last); after
the mixture a document may be two rows, which share a shard. Columns beyond those
of documents pass through all stages but the last, whatever their names. A null
source or language is a group of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertmill.llm import contamination, mixing, ngram_join, quality, sharding
from alertmill.llm.registry import prepare
from alertmill.session import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their language and source."""
    prepare(spark)
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id."""
    prepare(spark)
    return ngram_join.without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold the benchmark's passages."""
    prepare(spark)
    return contamination.without_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of the sources take them."""
    prepare(spark)
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document of the mixture."""
    prepare(spark)
    return sharding.sharded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("mixing", source_mixture),
    ("sharding", shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
