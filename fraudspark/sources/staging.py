"""Cutting a plan by a written table in the shared folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder in the warehouse."""
    configured = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back: later steps neither repeat nor re-plan it, a lost
    executor costs a re-read only, and columns are still pruned. Shuffle files of the write go with
    it: else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
