"""Hourly drift job: the last hours of the feature log against the training reference.

Every hour of the log is counted once, into a histogram of the reference's bins. A run adds up
the histograms of its look-back and counts only hours that are new or whose files have changed,
so an hourly job reads one hour of rows, however long the look-back is.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.operators.drift import (
    SCORE,
    SHIFTED,
    binned,
    drift_summary,
    edges_of,
    psi_of_bins,
    unpivot,
)
from fraudspark.schemas import DAY_MS, FEATURES, HOUR_MS
from fraudspark.sources.commits import exists, put_if_absent
from fraudspark.sources.staging import stage
from fraudspark.sources.tables import hours_between, load_feature_log

# Beside the features in a histogram: all rows of the hour, and those at or over the threshold.
ROWS, FLAGGED = "__rows__", "__flagged__"
HISTOGRAM = "feature string, bin int, n long, hour_key string"
EVENT = (
    "model_version string, since_ms long, until_ms long, rows long, max_psi double, "
    "max_feature string, shifted_features array<string>"
)


def log_hours(spark: SparkSession, log_path: str, since_ms: int, until_ms: int) -> list[str]:
    """A key per hour of the look-back that has files: day, hour, and a hash of the names, sizes
    and times of its files. File contents are not read; at most one key an hour."""
    if not exists(spark, log_path):
        return []
    files = spark.read.format("binaryFile").load(log_path)
    if "hour" not in files.columns:
        return []
    # Whole digits: sums of hashes may leave a long.
    mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    found = (
        files.where(F.col("day").between(since_ms // DAY_MS, until_ms // DAY_MS))
        .where(hours_between(since_ms, until_ms))
        .groupBy("day", "hour")
        .agg(F.count("*").alias("files"), mark.alias("mark"))
    )
    return sorted(
        f"{r.day}-{r.hour:02d}-{r.files}-{hashlib.sha256(str(r.mark).encode()).hexdigest()[:16]}"
        for r in found.collect()
    )


def reference_key(edges: DataFrame, version: str, threshold: float) -> str:
    """Names the bins: histograms of other bins, versions or thresholds lie apart. One row of
    edges per feature."""
    rows = sorted((r.feature, list(r.edges)) for r in edges.collect())
    text = json.dumps([version, threshold, rows])
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def update_histograms(
    spark: SparkSession,
    log_path: str,
    hist_path: str,
    edges: DataFrame,
    flag_threshold: float,
    keys: list[str],
) -> list[str]:
    """Counts the hours of ``keys`` that have no histogram yet, all in one job, and returns
    them. A partition is swapped in whole, so a job that is lost or runs twice does no harm."""
    missing = [k for k in keys if not exists(spark, f"{hist_path}/hour_key={k}")]
    if not missing:
        return []
    # A day and an hour name at most one key of a run.
    listed = [k.split("-") for k in missing]
    wanted = F.create_map(
        *[F.lit(v) for k, p in zip(missing, listed) for v in (int(p[0]) * 24 + int(p[1]), k)]
    )
    first, last = listed[0], listed[-1]
    hours = [int(p[0]) * 24 + int(p[1]) for p in (first, last)]
    since, until = min(hours) * HOUR_MS, (max(hours) + 1) * HOUR_MS - 1
    log = load_feature_log(spark, log_path, since, until)
    hour = F.col("day") * 24 + F.col("hour")
    rows = (
        log.where(hour.isin([int(p[0]) * 24 + int(p[1]) for p in listed]))
        .withColumn("hour_key", wanted[hour])
        .withColumnRenamed("score", SCORE)
        .withColumns(
            {
                ROWS: F.lit(0.0),
                FLAGGED: F.when(F.col(SCORE) >= flag_threshold, 1.0).otherwise(0.0),
            }
        )
    )
    values = unpivot(rows, [*FEATURES, SCORE, ROWS, FLAGGED], ["hour_key"])
    counters = spark.createDataFrame(
        [(ROWS, []), (FLAGGED, [0.5])], "feature string, edges array<double>"
    )
    counted = binned(
        values.withColumn("n", F.lit(1)), edges.unionByName(counters), ["hour_key"]
    )
    (
        # Small: the bins of some hours.
        counted.select("feature", "bin", "n", "hour_key")
        .repartition("hour_key")
        .write.partitionBy("hour_key")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(hist_path)
    )
    return missing


def run(
    spark: SparkSession,
    log_path: str,
    reference: DataFrame,
    until_ms: int,
    lookback_hours: int = 24,
    threshold: float = SHIFTED,
    hist_path: str | None = None,
    version: str = "",
    flag_threshold: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """(report, psi). Histograms are kept under ``hist_path`` (by default beside the log).
    Hours without a row, or a log without a file, give ``insufficient_data``."""
    since_ms = until_ms - lookback_hours * HOUR_MS
    reference = stage(reference, "psi-reference")
    edges = edges_of(reference)
    name = reference_key(edges, version, flag_threshold)
    hist_path = f"{hist_path or log_path.rstrip('/') + '_histograms'}/{name}"
    keys = log_hours(spark, log_path, since_ms, until_ms)
    update_histograms(spark, log_path, hist_path, edges, flag_threshold, keys)
    if keys:
        read = spark.read.schema(HISTOGRAM).parquet(hist_path)
        hours = read.where(F.col("hour_key").isin(keys))
    else:
        hours = spark.createDataFrame([], HISTOGRAM)
    bins = hours.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    # A few hundred rows, read three times below.
    bins = stage(bins.coalesce(1), "drift-bins")
    psi = stage(psi_of_bins(reference, bins, [*FEATURES, SCORE]).coalesce(1), "psi")
    total = F.coalesce(F.sum(F.when(F.col("feature") == ROWS, F.col("n"))), F.lit(0))
    flagged = F.sum(F.when((F.col("feature") == FLAGGED) & (F.col("bin") == 1), F.col("n")))
    counts = bins.agg(
        total.cast("long").alias("rows"), F.coalesce(flagged, F.lit(0)).alias("flagged")
    )
    summary = drift_summary(psi, counts.select("rows"), threshold)
    rate = counts.select(
        (F.col("flagged") / F.greatest("rows", F.lit(1))).alias("flag_rate")
    )
    report = summary.withColumns(
        {
            "flag_rate": F.when(F.col("status") != "insufficient_data", rate.scalar()),
            "model_version": F.lit(version),
            "since_ms": F.lit(since_ms),
            "until_ms": F.lit(until_ms),
        }
    )
    return report, psi


def append_event(report: DataFrame, path: str) -> int:
    """Appends the event of a report when drift was detected, once per version and hour of the
    window's end, however often the job runs; returns the number of events written."""
    row = report.where("drift_detected").first()
    if row is None:
        return 0
    event = {f.split()[0]: row[f.split()[0]] for f in EVENT.split(", ")}
    name = f"{row.until_ms // HOUR_MS:010d}-{row.model_version or 'unnamed'}"
    written = put_if_absent(report.sparkSession, f"{path}/{name}.json", json.dumps(event))
    return int(written)


def events(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], EVENT)
    return spark.read.schema(EVENT).json(path)
