"""Exact ranks, running sums and quantiles over a whole table without one big sort task.

Values are counted first; the counted values are dealt into ranges of about equal number, by
splitters that Spark samples from them, so one far value or a dense spot does not fill a range.
Totals of whole ranges are summed up, and values are only sorted inside their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage

RANGE = "_range"


def ranged(counted: DataFrame, order: list[str]) -> DataFrame:
    """``counted`` with the number of its range. Every range of ``order`` lies in one partition
    of a sampled range shuffle; the numbers are written, so that all readers see the same ones."""
    dealt = counted.repartitionByRange(*order)
    return stage(dealt.withColumn(RANGE, F.spark_partition_id()), "value-ranges")


def running_sums(
    df: DataFrame,
    by: list[str],
    value: str,
    weights: dict[str, Column],
    few_groups: bool = False,
) -> DataFrame:
    """One row per (by, value) with the sum of each weight, its sum over strictly smaller
    values as ``<name>_below`` and over the group as ``<name>_total``. Null values are left out.

    ``few_groups`` states that there are at most some dozens of groups (features, models); a
    missing ``by`` is one group. The totals of ranges then have at most a row per group and one
    per partition, and are broadcast, so that counted values are not shuffled by a handful of
    keys.
    """
    keys = by or ["_all"]
    small = F.broadcast if few_groups or not by else (lambda table: table)
    src = df if by else df.withColumn("_all", F.lit(0))
    names = list(weights)
    counted = (
        src.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(w).alias(n) for n, w in weights.items()])
    )
    placed = ranged(counted, [*keys, value])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    base = (
        placed.groupBy(*keys, RANGE)
        .agg(*[F.sum(n).alias(f"_s_{n}") for n in names])
        .select(
            *keys,
            RANGE,
            *[
                F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}")
                for n in names
            ],
            *[F.sum(f"_s_{n}").over(group).alias(f"{n}_total") for n in names],
        )
    )
    inside = (
        Window.partitionBy(*keys, RANGE)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = placed.join(small(base), [*keys, RANGE]).withColumns(
        {
            f"{n}_below": F.col(f"_base_{n}")
            + F.coalesce(F.sum(n).over(inside), F.lit(0))
            for n in names
        }
    )
    return out.select(
        *by,
        value,
        *names,
        *[f"{n}_below" for n in names],
        *[f"{n}_total" for n in names],
    )


def value_at(rank: Column) -> Column:
    """Aggregate over running_sums rows with weight ``n``: the value at a 0-based rank."""
    here = (F.col("n_below") <= rank) & (rank < F.col("n_below") + F.col("n"))
    return F.max(F.when(here, F.col("value")))


def quantile_aggregates(probs: dict[str, float]) -> list[Column]:
    """Linear interpolation between the two neighbouring ranks, like ``percentile``."""
    out = []
    for name, p in probs.items():
        place = (F.col("n_total") - 1) * F.lit(float(p))
        low = F.floor(place)
        high = F.least(low + 1, F.col("n_total") - 1)
        a, b = value_at(low), value_at(high)
        share = F.max(place - low)
        out.append((a * (1 - share) + b * share).alias(name))
    return out


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probs``; nulls are left out."""
    rows = df.select(*by, F.col(value).cast("double").alias("value")).where(
        F.col("value").isNotNull()
    )
    sums = running_sums(rows, by, "value", {"n": F.lit(1)})
    return sums.groupBy(*by).agg(*quantile_aggregates(probs))


def sequential_ids(
    df: DataFrame, order: list[str], name: str, by: list[str] | None = None
) -> DataFrame:
    """1-based numbers by ``order`` whose first column is numeric: an offset per distinct value
    of it, and a row number inside the value."""
    by = by or []
    first = order[0]
    sums = running_sums(
        df.select(*by, F.col(first).alias("value")), by, "value", {"n": F.lit(1)}
    )
    offsets = sums.select(
        *by, F.col("value").alias(first), F.col("n_below").alias("_offset")
    )
    inside = Window.partitionBy(*by, first).orderBy(*(order[1:] or [first]))
    return (
        df.join(offsets, [*by, first])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside))
        .drop("_offset")
    )
