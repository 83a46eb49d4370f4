"""Scoring a run of verdicts against the truth, per case, per stratum and per backend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.operators.ranks import exact_quantiles
from fraudspark.schemas import BLOCK_CONFIDENCE

# Alerts per month used for the cost projection.
MONTHLY_ALERTS = 100 * 30

# The metrics of a comparison, in its order.
COMPARE_METRICS = [
    "coverage",
    "decided_accuracy",
    "fraud_recall",
    "fraud_precision",
    "false_blocks",
    "missed_fraud",
    "fraud_type_accuracy",
    "avg_tool_calls",
    "p50_latency_ms",
    "avg_tokens",
    "avg_cost_usd",
    "monthly_cost_usd_at_100_alerts_per_day",
]


def case_cost(tokens_in: Column, tokens_out: Column, price_in=1.0, price_out=5.0) -> Column:
    """USD for token counts at prices per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1_000_000.0)


def eval_case_rows(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``cases``: EVAL_CASE columns. ``results``: txn_id, verdict, confidence,
    predicted_type and run counters."""
    c = F.col
    decided = c("verdict") != "needs_review"
    blocks = (c("verdict") == "fraud") & (c("confidence") >= BLOCK_CONFIDENCE)
    return cases.join(results, "txn_id").withColumns(
        {
            "truth": F.when(c("is_fraud"), "fraud").otherwise("legit"),
            "decided": decided,
            "correct": F.when(decided, (c("verdict") == "fraud") == c("is_fraud")),
            "false_block": blocks & ~c("is_fraud"),
            "missed_fraud": (c("verdict") == "legit") & c("is_fraud"),
            "type_match": c("is_fraud")
            & (c("verdict") == "fraud")
            & (c("predicted_type") == c("fraud_type")),
        }
    )


def _share(cond: Column, among: Column | None = None) -> Column:
    value = cond.cast("double")
    return F.avg(F.when(among, value) if among is not None else value)


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def eval_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    c = F.col
    fraud, called = c("truth") == "fraud", c("verdict") == "fraud"
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        _share(c("decided")).alias("coverage"),
        _share(c("correct"), c("decided")).alias("decided_accuracy"),
        _share(called, fraud).alias("fraud_recall"),
        _share(fraud, called).alias("fraud_precision"),
        _count(c("false_block")).alias("false_blocks"),
        _count(c("missed_fraud")).alias("missed_fraud"),
        _share(c("type_match"), fraud & called).alias("fraud_type_accuracy"),
        _count(c("terminated_by") != "submit_verdict").alias("incomplete_runs"),
        F.avg("tool_calls").alias("avg_tool_calls"),
        F.avg("tokens").alias("avg_tokens"),
        F.avg("cost_usd").alias("avg_cost_usd"),
    )
    out = out.withColumn(
        "monthly_cost_usd_at_100_alerts_per_day", c("avg_cost_usd") * MONTHLY_ALERTS
    )
    latency = latency_percentiles(rows, by)
    if by:
        return out.join(latency, by)
    return out.withColumn("_k", F.lit(1)).join(latency.withColumn("_k", F.lit(1)), "_k").drop("_k")


def latency_percentiles(
    rows: DataFrame, by: list[str] | None = None, latency: str = "latency_ms"
) -> DataFrame:
    return exact_quantiles(
        rows, by or [], latency, {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}
    )


def eval_by_stratum(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), "stratum").agg(
        F.count("*").alias("n"),
        _share(F.col("decided")).alias("coverage"),
        _share(F.col("correct"), F.col("decided")).alias("decided_accuracy"),
    )


def eval_confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "verdict").agg(F.count("*").alias("n"))


def eval_compare(summary: DataFrame, backends: list[str]) -> DataFrame:
    """One row per metric, one column per backend."""
    long = summary.select(
        "backend",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")
                    )
                    for m in COMPARE_METRICS
                ]
            )
        ),
    )
    return long.groupBy("metric").pivot("backend", backends).agg(F.first("value"))


def stream_metrics(decisions: DataFrame, bucket_ms: int) -> DataFrame:
    """Scored and flagged counts and mean latency per model version and time bucket."""
    bucket = F.col("ts_ms") - F.col("ts_ms") % bucket_ms
    return decisions.groupBy("model_version", bucket.alias("bucket_ms")).agg(
        F.count("*").alias("scored"),
        F.sum(F.col("flagged").cast("long")).alias("flagged"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


def investigation_metrics(cases: DataFrame, by: list[str]) -> DataFrame:
    c = F.col
    alert = (c("verdict") == "fraud") & (c("confidence") >= BLOCK_CONFIDENCE)
    return cases.groupBy(*by).agg(
        F.count("*").alias("investigations"),
        _count(c("verdict") == "fraud").alias("verdict_fraud"),
        _count(c("verdict") == "legit").alias("verdict_legit"),
        _count(c("verdict") == "needs_review").alias("verdict_review"),
        _count(alert).alias("alerts"),
        F.sum("tokens").alias("tokens"),
        _count(c("terminated_by") != "submit_verdict").alias("incomplete"),
    )


def dataset_meta(txns: DataFrame) -> DataFrame:
    return txns.agg(
        F.count("*").alias("transactions"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("merchant_id").alias("merchants"),
        _count(F.col("is_fraud")).alias("fraud_transactions"),
        _share(F.col("is_fraud")).alias("fraud_rate"),
    )


def fraud_by_type(txns: DataFrame) -> DataFrame:
    return (
        txns.where("is_fraud").groupBy("fraud_type").agg(F.count("*").alias("n"))
    )
