"""Splitting hot keys so that no window task has to hold one key's whole history.

A key with more than ``hot_rows`` rows is hot. Its rows are cut, in time order, into chunks
of ``chunk_rows`` rows, and windows run per (key, chunk) with what came before carried in
from per-chunk aggregates. Frames that look back a bounded number of rows get those rows as
a halo: copies of the last rows before the chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SkewPolicy:
    hot_rows: int = 50_000
    chunk_rows: int = 1_000_000
    # A list of at most this many keys is broadcast; a longer one is joined by shuffle.
    broadcast_keys: int = 500_000


DEFAULT = SkewPolicy()


@dataclass(frozen=True)
class Split:
    """The hot keys of a table: ``key_rows``, ``key_lo``, ``key_hi`` per key, or none."""

    key: str
    hot_keys: DataFrame | None

    def apply(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of ordinary keys, and rows of hot keys with the key's size and time span."""
        names = self.hot_keys.select(self.key)
        return (
            df.join(names, self.key, "left_anti"),
            df.join(self.hot_keys, self.key, "inner"),
        )


def key_sizes(df: DataFrame, key: str, more: list[Column] = ()) -> DataFrame:
    """Rows and time span per key; partial aggregation keeps this cheap under skew."""
    return df.groupBy(key).agg(
        F.count("*").alias("key_rows"),
        F.min("ts_ms").alias("key_lo"),
        F.max("ts_ms").alias("key_hi"),
        *more,
    )


def hot_split(sizes: DataFrame, key: str, found: int, policy: SkewPolicy) -> Split:
    """``found`` is the counted number of hot keys, at most rows / hot_rows."""
    if found == 0:
        return Split(key, None)
    keys = sizes.where(F.col("key_rows") > policy.hot_rows).select(
        key, "key_rows", "key_lo", "key_hi"
    )
    return Split(key, F.broadcast(keys) if found <= policy.broadcast_keys else keys)


def find_hot(df: DataFrame, key: str, policy: SkewPolicy = DEFAULT) -> Split:
    sizes = key_sizes(df, key)
    found = sizes.where(F.col("key_rows") > policy.hot_rows).count()
    return hot_split(sizes, key, found, policy)


def chunked(
    hot: DataFrame,
    key: str,
    halo: int,
    policy: SkewPolicy = DEFAULT,
    n_before: str = "n_before",
    row_no: str = "row_no",
) -> DataFrame:
    """Adds ``chunk``, ``is_halo``, ``n_before`` (rows of the key strictly earlier in time) and
    ``row_no`` (1-based place by time, then txn_id) to the rows of hot keys.

    Rows of one instant always share a chunk. The place in the key is found without a
    per-key sort: the time span is cut into slots, slot sizes are summed up, and rows are
    only sorted inside their slot.
    """
    t = policy.chunk_rows
    slots = F.greatest(F.lit(1), F.ceil(F.col("key_rows") / t) * 4)
    width = F.col("key_hi") - F.col("key_lo") + 1
    slotted = hot.withColumn(
        "slot", F.floor((F.col("ts_ms") - F.col("key_lo")) * slots / width)
    )
    before = Window.partitionBy(key).orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = (
        slotted.groupBy(key, "slot")
        .agg(F.count("*").alias("slot_rows"))
        .select(
            key,
            "slot",
            F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("slot_base"),
        )
    )
    in_time = Window.partitionBy(key, "slot").orderBy("ts_ms")
    in_order = Window.partitionBy(key, "slot").orderBy("ts_ms", "txn_id")
    placed = (
        slotted.join(sizes, [key, "slot"])
        .withColumn(n_before, F.col("slot_base") + F.rank().over(in_time) - 1)
        .withColumn(row_no, F.col("slot_base") + F.row_number().over(in_order))
    )
    home = F.floor(F.col(n_before) / t)
    last = F.greatest(home, F.ceil((F.col(row_no) + halo) / t) - 1)
    copies = F.sequence(home, last) if halo else F.array(home)
    return (
        placed.withColumn("home_chunk", home)
        .withColumn("chunk", F.explode(copies))
        .withColumn("is_halo", F.col("chunk") > F.col("home_chunk"))
        .drop("slot", "slot_base", "home_chunk")
    )


def earlier_chunks(key: str, *more: str):
    """Window over per-chunk aggregates: everything before the current chunk."""
    return (
        Window.partitionBy(key, *more)
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
