"""Readers and writers of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudspark import schemas as S
from fraudspark.schemas import DAY_MS, HOUR_MS


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled transactions as Parquet with ``ts`` in epoch seconds (three decimals)."""
    fields = [
        f"{'ts double' if f.name == 'ts_ms' else f'{f.name} {f.dataType.simpleString()}'}"
        for f in S.TRANSACTION.fields
    ]
    raw = spark.read.schema(", ".join(fields)).parquet(path)
    ts = F.round(F.col("ts") * 1000).cast("long").alias("ts_ms")
    return raw.select(
        *[ts if f.name == "ts_ms" else F.col(f.name) for f in S.TRANSACTION.fields]
    )


def read_users(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(
        "user_id string, home_city string, home_lat double, home_lon double, "
        "account_created_ts double, spend_level double"
    ).parquet(path)
    return raw.select(
        "user_id", "home_city", "home_lat", "home_lon",
        F.round(F.col("account_created_ts") * 1000).cast("long").alias("account_created_ms"),
        "spend_level",
    )


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(
        "merchant_id string, category string, city string, country string, "
        "is_online boolean, created_ts double, category_risk double"
    ).parquet(path)
    return raw.select(
        "merchant_id", "category", "city", "country", "is_online",
        F.round(F.col("created_ts") * 1000).cast("long").alias("created_ms"),
        "category_risk",
    )


def reference_upsert(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row per key. ``max_by`` combines before the shuffle, so a key that is loaded
    again and again is no burden."""
    others = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(
        F.max_by(F.struct(*others), F.struct(version, *others)).alias("r")
    )
    return newest.select(key, "r.*")


def wire_projection(
    txns: DataFrame, offset: int = 0, limit: int = 0
) -> DataFrame:
    """What a gateway would send: labels stripped, a slice in time order. The slice is cut by
    distributed row numbers instead of one sorted task."""
    from fraudspark.operators.ranks import sequential_ids

    numbered = sequential_ids(txns.select(*S.WIRE_COLUMNS), ["ts_ms", "txn_id"], "seq")
    keep = F.col("seq") > offset
    if limit:
        keep = keep & (F.col("seq") <= offset + limit)
    return numbered.where(keep)


def with_day_hour(df: DataFrame) -> DataFrame:
    """Partition columns of the feature log and the decisions: UTC day number and hour."""
    return df.withColumns(
        {
            "day": F.floor(F.col("ts_ms") / DAY_MS).cast("int"),
            "hour": F.floor(F.pmod(F.col("ts_ms"), F.lit(DAY_MS)) / HOUR_MS).cast("int"),
        }
    )


def feature_log_rows(scored: DataFrame) -> DataFrame:
    return scored.select("txn_id", "ts_ms", "score", "model_version", *S.FEATURES)


def write_feature_log(rows: DataFrame, path: str, mode: str = "append") -> None:
    (
        with_day_hour(feature_log_rows(rows))
        .write.mode(mode)
        .partitionBy("day", "hour")
        .json(path)
    )


def hours_between(since_ms: int | Column, until_ms: int | Column) -> Column:
    """Filter on (day, hour): from the start of the hour of ``since`` through ``until``. It
    only touches partition columns, so whole hours are skipped without a read."""
    since = since_ms if isinstance(since_ms, Column) else F.lit(since_ms)
    until = until_ms if isinstance(until_ms, Column) else F.lit(until_ms)
    hour = F.col("day") * 24 + F.col("hour")
    return (hour >= F.floor(since / HOUR_MS)) & (hour <= F.floor(until / HOUR_MS))


def load_feature_log(
    spark: SparkSession, path: str, since_ms: int, until_ms: int
) -> DataFrame:
    first, last = since_ms // DAY_MS, until_ms // DAY_MS
    log = spark.read.schema(S.FEATURE_LOG_TABLE).json(path)
    return log.where(F.col("day").between(first, last)).where(
        hours_between(since_ms, until_ms)
    )


def drop_expired_days(df: DataFrame, now_ms: int, keep_days: int) -> DataFrame:
    """Whole days that are past retention, by the partition column alone."""
    return df.where(F.col("day") >= (now_ms // DAY_MS) - keep_days)


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("append").parquet(path)


def latest_cases(cases: DataFrame) -> DataFrame:
    """Cases are appended; a rerun of the same version gives the same case_id."""
    w = Window.partitionBy("case_id").orderBy(F.desc("created_ms"))
    return cases.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def write_case_set(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)


def read_case_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EVAL_CASE).json(path)
