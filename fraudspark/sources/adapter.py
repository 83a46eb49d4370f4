"""Maps the given event, customer and supplier tables to transactions, users and merchants.

The mapping is deterministic: three event users form one account, each six-hour slot is
squeezed twelve times so that velocity patterns occur, and the ``k`` value inside ``props``
chooses merchant, device, channel and label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.functions.scalar import category_name
from fraudspark.schemas import CATEGORY_RISK

SLOT_MS = 21_600_000
EPOCH_2024_MS = 1_704_067_200_000
DAY = 86_400_000

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)
CUSTOMER_SCHEMA = "c_custkey bigint, c_nationkey int"
SUPPLIER_SCHEMA = "s_suppkey bigint, s_nationkey int"


@dataclass(frozen=True)
class Tables:
    transactions: DataFrame
    users: DataFrame
    merchants: DataFrame


def transactions(events: DataFrame, customer: DataFrame) -> DataFrame:
    """Works on a batch or a streaming ``events`` frame; the session zone must be UTC. Events of
    an account that is no customer stay; their city is dealt by the account number."""
    k = F.get_json_object("props", "$.k").cast("int")
    raw_ms = F.expr("unix_micros(CAST(ts AS timestamp)) div 1000")
    base = events.select(
        "event_id",
        F.expr("user_id div 3").alias("acct"),
        "event_type",
        "value",
        raw_ms.alias("raw_ms"),
        k.alias("k"),
    )
    accounts = customer.select(
        F.col("c_custkey").alias("acct"), F.col("c_nationkey").alias("home_idx")
    )
    moved = F.col("k").isin(13, 14)
    x = (
        base.join(accounts, "acct", "left")
        .withColumn("home_idx", F.coalesce("home_idx", (F.col("acct") % 25).cast("int")))
        .withColumn(
            "ts_ms",
            F.expr(f"raw_ms - raw_ms % {SLOT_MS} + (raw_ms % {SLOT_MS}) div 12"),
        )
        .withColumn("mkey", (F.col("k") * 3 + F.col("event_id") % 7) % 40)
        .withColumn(
            "city_idx",
            F.when(moved, (F.col("home_idx") + 7) % 25).otherwise(F.col("home_idx")),
        )
    )
    burst = (F.col("event_type") == "error") & (F.col("value") > 150)
    acct = F.col("acct").cast("string")
    return x.select(
        F.concat(F.lit("T"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias(
            "txn_id"
        ),
        "ts_ms",
        F.concat(F.lit("U"), F.lpad(acct, 6, "0")).alias("user_id"),
        F.concat(F.lit("M"), F.lpad(F.col("mkey").cast("string"), 5, "0")).alias(
            "merchant_id"
        ),
        category_name(F.col("mkey") % 16).alias("merchant_category"),
        F.when(
            F.col("k") >= 97,
            F.concat(F.lit("DRING"), (F.col("event_id") % 5).cast("string")),
        )
        .when(F.col("k") % 10 == 9, F.concat(F.lit("D"), acct, F.lit("b")))
        .otherwise(F.concat(F.lit("D"), acct, F.lit("a")))
        .alias("device_id"),
        F.when(F.col("k") % 3 == 0, "UPI")
        .when(F.col("k") % 3 == 1, "CARD")
        .otherwise("NETBANKING")
        .alias("channel"),
        (F.col("value") * 6.0).alias("amount"),
        F.concat(F.lit("CITY_"), F.col("city_idx").cast("string")).alias("city"),
        (F.col("city_idx") + 8).cast("double").alias("lat"),
        (F.col("city_idx") + 68).cast("double").alias("lon"),
        F.when(F.col("k") == 14, "AE").otherwise("IN").alias("country"),
        (F.col("k") % 2 == 0).alias("is_online"),
        ((F.col("k") >= 97) | burst).alias("is_fraud"),
        F.when(F.col("k") == 97, "account_takeover")
        .when(F.col("k") == 98, "card_testing")
        .when(F.col("k") == 99, "low_and_slow")
        .when(burst, "velocity_burst")
        .otherwise("none")
        .alias("fraud_type"),
        F.col("event_type").alias("context"),
    )


def users(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    return customer.select(
        F.concat(F.lit("U"), F.lpad(key.cast("string"), 6, "0")).alias("user_id"),
        F.concat(F.lit("CITY_"), nation.cast("string")).alias("home_city"),
        (nation + 8).cast("double").alias("home_lat"),
        (nation + 68).cast("double").alias("home_lon"),
        (F.lit(EPOCH_2024_MS) - (key % 400 + 5) * F.lit(DAY)).alias(
            "account_created_ms"
        ),
        F.lit(1.0).alias("spend_level"),
    )


def merchants(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    risk = F.element_at(
        F.array(*[F.lit(r) for r in CATEGORY_RISK.values()]),
        (key % 16).cast("int") + 1,
    )
    return supplier.select(
        F.concat(F.lit("M"), F.lpad(key.cast("string"), 5, "0")).alias("merchant_id"),
        category_name(key % 16).alias("category"),
        F.concat(F.lit("CITY_"), F.col("s_nationkey").cast("string")).alias("city"),
        F.lit("IN").alias("country"),
        (key % 2 == 0).alias("is_online"),
        (F.lit(EPOCH_2024_MS) - (key % 900 + 30) * F.lit(DAY)).alias("created_ms"),
        risk.alias("category_risk"),
    )


def read(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def source_paths(sf_dir: str) -> list[str]:
    """All that ``load`` reads."""
    return [f"{sf_dir}/{name}.parquet" for name in ("customer", "events", "supplier")]


def load(spark: SparkSession, sf_dir: str) -> Tables:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    customer = read(spark, sf_dir, "customer", CUSTOMER_SCHEMA)
    events = read(spark, sf_dir, "events", EVENT_SCHEMA)
    supplier = read(spark, sf_dir, "supplier", SUPPLIER_SCHEMA)
    return Tables(transactions(events, customer), users(customer), merchants(supplier))
