"""Queries of the corpus operators, and the SQL side of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fraudspark.llm.bpe import round_trip
from fraudspark.llm.common import documents
from fraudspark.llm.conversations import repaired_conversations
from fraudspark.llm.decontaminate import contamination
from fraudspark.llm.hosts import HOST_RULES_SQL, host_rules
from fraudspark.llm.jaccard import similar_documents, similar_sql
from fraudspark.llm.language import languages, train
from fraudspark.llm.licenses import license_report
from fraudspark.llm.mixing import mix
from fraudspark.llm.repeats import REPEATS_SQL, repeated_passages
from fraudspark.llm.secrets import secret_spans
from fraudspark.llm.sharding import byte_shards
from fraudspark.llm.tokens import token_counts
from fraudspark.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


ORACLES["op2_substring_dedup"] = REPEATS_SQL


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


@query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(documents(spark, sf_dir))


ORACLES["op4_host_rules"] = HOST_RULES_SQL


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return languages(docs, train(docs))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(documents(spark, sf_dir))


@query
def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(documents(spark, sf_dir))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


ORACLES["op8_jaccard_join"] = similar_sql()


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


@query
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package: the operators do not need it

    return corpus_pipeline.run(spark, sf_dir)
