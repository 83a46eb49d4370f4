"""Time split, seeded samples and balanced case sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.schemas import DAY_MS, FEATURES

BANK_SIZE = 4000


def window_bounds(
    df: DataFrame, burn_in_days: float, val_days: float, test_days: float
) -> DataFrame:
    """One row: train_start, val_start, test_start, end, from the exact time span.

    Starts are whole milliseconds, rounded up: comparing times with them gives the same rows,
    and a filter on long values reaches the Parquet scan.
    """
    day = float(DAY_MS)
    lo, end = F.col("lo"), F.col("end")
    return df.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("end")).select(
        F.ceil(lo + F.lit(burn_in_days * day)).alias("train_start"),
        F.ceil(end - F.lit((test_days + val_days) * day)).alias("val_start"),
        F.ceil(end - F.lit(test_days * day)).alias("test_start"),
        "end",
    )


def split_label(ts: Column, bounds: Column) -> Column:
    """``bounds`` is a struct column of window_bounds; burn-in rows get null."""
    return (
        F.when(ts >= bounds["test_start"], "test")
        .when((ts >= bounds["val_start"]), "val")
        .when((ts >= bounds["train_start"]), "train")
    )


def time_split(
    df: DataFrame, burn_in_days: float, val_days: float, test_days: float
) -> DataFrame:
    """Adds ``split``: train, val, test, or null before the end of the burn-in.

    Windows are half open; with short data a row can lie in val or test although it is in the
    burn-in too, as the windows are anchored at both ends.
    """
    bounds = window_bounds(df.select("ts_ms"), burn_in_days, val_days, test_days)
    b = bounds.select(F.struct("*")).scalar()
    return df.withColumn("split", split_label(F.col("ts_ms"), b))


def seeded_order(key: str, seed: int) -> Column:
    """A random but repeatable order, the same in every engine with md5."""
    return F.md5(F.concat(F.col(key), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in seeded order: a top-n, which keeps n rows per task before the merge."""
    return df.orderBy(seeded_order("txn_id", seed), "txn_id").limit(n)


def case_bank(
    pool: DataFrame, n_legit: int = BANK_SIZE, n_fraud: int = BANK_SIZE, seed: int = 0
) -> DataFrame:
    """At most ``n_fraud`` + ``n_legit`` resolved cases. Ids alone tell the last row of each sample;
    features are read for the rows up to it."""
    cols = ["txn_id", "ts_ms", "user_id", "is_fraud", "fraud_type", *FEATURES]
    place = F.struct(seeded_order("txn_id", seed).alias("order"), F.col("txn_id"))

    def last(label: str, n: int) -> Column:
        ids = sample_rows(pool.where(label).select("txn_id"), n, seed)
        return ids.agg(F.max(place)).scalar()

    edge = F.when(F.col("is_fraud"), last("is_fraud", n_fraud)).otherwise(
        last("NOT is_fraud", n_legit)
    )
    few = pool.where("is_fraud IS NOT NULL").select(*cols).where(place <= edge)
    # rows that repeat the last id may be too many
    w = Window.partitionBy("is_fraud").orderBy(seeded_order("txn_id", seed), "txn_id")
    most = F.when(F.col("is_fraud"), n_fraud).otherwise(n_legit)
    return few.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def union_pools(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stratified_round_robin(df: DataFrame, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows taken in turn from every stratum. No stratum can give more than n, and Spark
    applies that bound before the shuffle."""
    w = Window.partitionBy(stratum).orderBy(seeded_order("txn_id", seed), "txn_id")
    return (
        df.withColumn("turn", F.row_number().over(w))
        .where(F.col("turn") <= n)
        .orderBy("turn", stratum)
        .limit(n)
    )


def build_cases(flagged: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Half confirmed fraud over fraud types, half false positives over contexts."""
    half = n // 2
    fraud = stratified_round_robin(flagged.where("is_fraud"), "fraud_type", half, seed)
    legit = stratified_round_robin(
        flagged.where("NOT is_fraud"), "context", n - half, seed
    )
    stratum = F.when(F.col("is_fraud"), F.col("fraud_type")).otherwise(
        F.concat(F.lit("legit:"), F.col("context"))
    )
    cols = ["txn_id", "is_fraud", "fraud_type", "context", "score", "amount"]
    both = fraud.select(*cols).unionByName(legit.select(*cols))
    return both.withColumn("stratum", stratum)
