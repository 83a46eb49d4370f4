"""Classifier metrics as Spark aggregates.

All functions take rows with a 0/1 ``label`` and a double ``score``, and an optional list of
group columns, so several models are measured in one job. Groups are models, not keys of the
data: some dozens at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.operators.ranks import running_sums
from fraudspark.sources.staging import stage

DEFAULT_THRESHOLD = 0.5
ULP = 2.220446049250313e-16
REPORTED_FPRS = {"0.500%": 0.005, "1.000%": 0.01, "2.000%": 0.02}


def score_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score, with running sums below it."""
    return running_sums(
        df,
        by or [],
        "score",
        {"pos": F.col("label"), "neg": F.lit(1) - F.col("label")},
        few_groups=True,
    )


def just_above(c: Column) -> Column:
    return F.when(c > 0, c * (1 + ULP)).otherwise(F.lit(4.9e-324))


def _threshold(fpr: Column | float) -> Column:
    """Aggregate over score_counts rows: the k-th largest negative score, k = floor(fpr * N)."""
    total = F.col("neg_total")
    k = F.floor(F.lit(fpr) * total)
    place = total - k
    here = (F.col("neg_below") <= place) & (place < F.col("neg_below") + F.col("neg"))
    top = F.max(F.when(F.col("neg") > 0, F.col("score")))
    return (
        F.when(F.max(total) == 0, F.lit(DEFAULT_THRESHOLD))
        .when(F.max(k) <= 0, just_above(top))
        .otherwise(F.max(F.when(here, F.col("score"))))
    )


def threshold_at_fpr(
    df: DataFrame, target_fpr: float, by: list[str] | None = None
) -> DataFrame:
    """Smallest threshold whose share of flagged negatives is about ``target_fpr``. Ties at the
    threshold are flagged, so coarse scores overshoot."""
    counts = score_counts(df, by)
    return counts.groupBy(*(by or [])).agg(_threshold(target_fpr).alias("threshold"))


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)).cast("double")


def _confusion(flagged: Column) -> dict[str, Column]:
    fraud = F.col("label") == 1

    def n(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))

    return {
        "tp": n(flagged & fraud),
        "fp": n(flagged & ~fraud),
        "fn": n(~flagged & fraud),
        "tn": n(~flagged & ~fraud),
    }


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns(
        {
            "recall": _ratio(tp, tp + fn),
            "precision": _ratio(tp, tp + fp),
            "fpr": _ratio(fp, fp + tn),
            "alerts": tp + fp,
        }
    )


def metrics_at_threshold(
    df: DataFrame, threshold: Column | float, by: list[str] | None = None
) -> DataFrame:
    """Confusion counts and rates; ``threshold`` may be a column of the rows."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    counts = _confusion(F.col("score") >= t)
    return with_rates(
        df.groupBy(*(by or [])).agg(
            F.max(t).alias("threshold"), *[c.alias(k) for k, c in counts.items()]
        )
    )


def _outcomes(counts: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Metrics per row of ``thresholds`` (group columns, ``threshold`` and others), summed over
    distinct scores. A group has a handful of thresholds."""
    key = by or ["_one"]
    left = counts if by else counts.withColumn("_one", F.lit(1))
    right = thresholds if by else thresholds.withColumn("_one", F.lit(1))
    names = [c for c in thresholds.columns if c not in by]
    hit = F.col("score") >= F.col("threshold")

    def n(c: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")

    return with_rates(
        left.join(F.broadcast(right), key)
        .groupBy(*by, *names)
        .agg(
            n("pos", hit).alias("tp"),
            n("neg", hit).alias("fp"),
            n("pos", ~hit).alias("fn"),
            n("neg", ~hit).alias("tn"),
        )
    )


def _recalls(counts: DataFrame, fprs: dict[str, float], by: list[str]) -> DataFrame:
    thresholds = counts.groupBy(*by).agg(
        *[_threshold(v).alias(f"_t{i}") for i, v in enumerate(fprs.values())]
    )
    targets = F.array(
        *[
            F.struct(
                F.lit(k).alias("target"),
                F.lit(v).alias("target_fpr"),
                F.col(f"_t{i}").alias("threshold"),
            )
            for i, (k, v) in enumerate(fprs.items())
        ]
    )
    return _outcomes(counts, thresholds.select(*by, F.inline(targets)), by)


def recall_at_fprs(
    df: DataFrame, fprs: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """One row per (by, fpr) with its threshold and metrics."""
    return _recalls(score_counts(df, by), fprs, by or [])


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tie-aware: the chance that a positive outranks a negative, ties count half. NaN when a
    class is missing."""
    return score_counts(df, by).groupBy(*(by or [])).agg(_roc_auc().alias("roc_auc"))


def _roc_auc() -> Column:
    pairs = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
    p, n = F.max("pos_total"), F.max("neg_total")
    return F.when((p > 0) & (n > 0), pairs / (p * n)).otherwise(F.lit(float("nan")))


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Step-wise, not trapezoidal: sum over scores of recall gained times precision there."""
    return (
        score_counts(df, by)
        .groupBy(*(by or []))
        .agg(_average_precision().alias("pr_auc"))
    )


def _average_precision() -> Column:
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    step = F.col("pos") / F.col("pos_total") * (tp / (tp + fp))
    p, n = F.max("pos_total"), F.max("neg_total")
    return F.when((p > 0) & (n > 0), F.sum(step)).otherwise(F.lit(float("nan")))


def model_summary(
    df: DataFrame, thresholds: DataFrame, days: Column | float, by: list[str]
) -> DataFrame:
    """Threshold-free metrics and the operating point, one row per group.

    ``thresholds`` has the group columns and ``threshold``, one row per group.
    """
    # Everything below reads the counts per distinct score, not the rows.
    counts = stage(score_counts(df, by), "score-counts")
    overall = counts.groupBy(*by).agg(
        _roc_auc().alias("roc_auc"),
        _average_precision().alias("pr_auc"),
        F.max(F.col("pos_total") + F.col("neg_total")).cast("long").alias("n"),
        F.max("pos_total").cast("long").alias("positives"),
    )
    overall = overall.withColumn("base_rate", F.col("positives") / F.col("n"))
    names = ["recall_at_0_5pct", "recall_at_1pct", "recall_at_2pct"]
    recalls = (
        _recalls(counts, REPORTED_FPRS, by)
        .groupBy(*by)
        .agg(
            *[
                F.max(F.when(F.col("target") == k, F.col("recall"))).alias(name)
                for k, name in zip(REPORTED_FPRS, names)
            ]
        )
    )
    per_day = days if isinstance(days, Column) else F.lit(float(days))
    return (
        overall.join(recalls, by)
        .join(_outcomes(counts, thresholds, by), by)
        .withColumn(
            "alerts_per_day", F.col("alerts") / F.greatest(per_day, F.lit(1e-9))
        )
    )


def per_type_recall(
    df: DataFrame, threshold: Column | float, kind: str = "fraud_type"
) -> DataFrame:
    """Count and recall of each fraud type among the frauds."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (
        df.where(F.col("label") == 1)
        .groupBy(kind)
        .agg(
            F.count("*").alias("n"),
            F.avg((F.col("score") >= t).cast("double")).alias("recall"),
        )
    )


def flag_rate_by_context(
    df: DataFrame, threshold: Column | float, baseline: str
) -> DataFrame:
    """False positive rate of each legitimate behaviour, and its ratio to ``baseline``."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rates = (
        df.where(F.col("label") == 0)
        .groupBy("context")
        .agg(
            F.count("*").alias("n"),
            F.avg((F.col("score") >= t).cast("double")).alias("flag_rate"),
        )
    )
    base = rates.where(F.col("context") == baseline).select(
        F.max("flag_rate").alias("r")
    )
    return rates.withColumn("ratio_to_baseline", F.col("flag_rate") / base.scalar())


def feature_stats(
    df: DataFrame, features: list[str], at_once: int | None = None
) -> DataFrame:
    """Mean and sample standard deviation per feature; a zero deviation becomes 1.

    One pass with two aggregates per feature, then the single row is turned into 45. The code of
    that many is too long to be compiled: with ``at_once`` that many features make a pass over their
    columns alone, for written rows.
    """
    step = at_once or len(features)
    out = [_stats_of(df, features[i : i + step]) for i in range(0, len(features), step)]
    return reduce(DataFrame.unionByName, out)


def _stats_of(df: DataFrame, features: list[str]) -> DataFrame:
    wide = df.agg(
        *[F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)],
        *[F.stddev_samp(f).alias(f"s_{i}") for i, f in enumerate(features)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"m_{i}").alias("mean"),
                F.when(F.col(f"s_{i}") > 0, F.col(f"s_{i}"))
                .otherwise(F.lit(1.0))
                .alias("std"),
            )
            for i, f in enumerate(features)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def latency_histogram(
    df: DataFrame, by: list[str], latency: str = "latency_ms"
) -> DataFrame:
    """Cumulative latency buckets in the usual ``le`` form, with sum and count."""
    edges = LATENCY_BUCKETS_MS
    wide = df.groupBy(*by).agg(
        *[
            F.sum((F.col(latency) <= e).cast("long")).alias(f"b{i}")
            for i, e in enumerate(edges)
        ],
        F.count("*").alias("n"),
        F.sum(latency).alias("latency_sum"),
    )
    rows = [
        F.struct(F.lit(str(e)).alias("le"), F.col(f"b{i}").alias("bucket_count"))
        for i, e in enumerate(edges)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("bucket_count")))
    return wide.select(
        *by, F.explode(F.array(*rows)).alias("r"), "latency_sum", "n"
    ).select(*by, "r.le", "r.bucket_count", "latency_sum", "n")


# Latency bucket edges of the scoring service, in milliseconds.
LATENCY_BUCKETS_MS = [1, 2, 5, 10, 20, 50, 100, 250, 500, 1000]
