"""State before each event, as window columns.

``user_history`` adds what the account looked like before the event, ``device_history``
what the device looked like. Both take the short way (one shuffle on the key) for ordinary
keys and the chunked way for hot ones; the columns are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.functions.scalar import flag
from fraudspark.operators.skew import (
    DEFAULT,
    SkewPolicy,
    Split,
    chunked,
    earlier_chunks,
)
from fraudspark.schemas import DAY_MS, HOUR_MS, RECENT_CAP, SMALL_AMOUNT
from fraudspark.sources.staging import stage

ORDER = ["ts_ms", "txn_id"]

USER_STATE = [
    "row_no",
    "n_before",
    "mean_prior",
    "std_prior",
    "count_1h",
    "count_24h",
    "sum_24h",
    "small_1h",
    "prev_ms",
    "prev_lat",
    "prev_lon",
    "prev_city",
    "first_ms",
    "user_device_first_ms",
    "user_devices",
    "user_merchant_first_ms",
    "user_merchants",
]
DEVICE_STATE = [
    "device_row_no",
    "device_n_before",
    "device_first_ms",
    "device_first_before_ms",
    "device_user_first_ms",
    "device_users",
    "device_users_before",
]


def _prior(*keys: str):
    return (
        Window.partitionBy(*keys)
        .orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _so_far(*keys: str):
    return (
        Window.partitionBy(*keys)
        .orderBy(*ORDER)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _small() -> Column:
    return (F.col("amount") < SMALL_AMOUNT).cast("double")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _last_event(keys: list[str]) -> dict[str, Column]:
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    return {
        "prev_ms": F.lag("ts_ms").over(w),
        "prev_lat": F.lag("lat").over(w),
        "prev_lon": F.lag("lon").over(w),
        "prev_city": F.lag("city").over(w),
    }


def _running_totals(keys: list[str]) -> dict[str, Column]:
    return {
        "run_amount": _zero(F.sum("amount").over(_prior(*keys))),
        "run_small": _zero(F.sum(_small()).over(_prior(*keys))),
    }


def _capped(df: DataFrame, keys: list[str]) -> DataFrame:
    """The recent list holds RECENT_CAP rows at most: counts stop there, and sums over a full
    list are differences of running sums."""
    cap = F.lit(float(RECENT_CAP))
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    return (
        df.withColumns(
            {
                "old_amount": _zero(F.lag("run_amount", RECENT_CAP).over(w)),
                "old_small": _zero(F.lag("run_small", RECENT_CAP).over(w)),
            }
        )
        .withColumns(
            {
                "sum_24h": F.when(
                    F.col("count_24h") > cap, F.col("run_amount") - F.col("old_amount")
                ).otherwise(F.col("sum_24h")),
                "small_1h": F.when(
                    F.col("count_1h") > cap, F.col("run_small") - F.col("old_small")
                ).otherwise(F.col("small_1h")),
                "count_1h": F.least(F.col("count_1h"), cap),
                "count_24h": F.least(F.col("count_24h"), cap),
            }
        )
        .drop("run_amount", "run_small", "old_amount", "old_small")
    )


def _velocity_frames(df: DataFrame, keys: list[str]) -> DataFrame:
    """RANGE frames end at the event's own instant; its own row and the peers that come
    later in order are taken off again."""
    instant = Window.partitionBy(*keys).orderBy("ts_ms")
    peers = (
        Window.partitionBy(*keys, "ts_ms")
        .orderBy("txn_id")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    hour = instant.rangeBetween(-HOUR_MS + 1, 0)
    day = instant.rangeBetween(-DAY_MS + 1, 0)
    one = F.lit(1.0)

    def window_less_own(value: Column, frame) -> Column:
        return F.sum(value).over(frame) - F.sum(value).over(peers)

    return df.withColumns(
        {
            "count_1h": window_less_own(one, hour),
            "small_1h": window_less_own(_small(), hour),
            "count_24h": window_less_own(one, day),
            "sum_24h": window_less_own(F.col("amount"), day),
        }
    )


def _velocity_events(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same counts for dense keys at constant cost per row: every event also leaves the
    1 h and the 24 h window at a known instant, so a running sum over arrivals and leavings
    gives the content of both windows."""
    arrive = F.struct(
        F.col("ts_ms").alias("at"),
        F.lit(1).alias("arrives"),
        F.lit(1.0).alias("d1"),
        _small().alias("dsmall"),
        F.lit(1.0).alias("d24"),
        F.col("amount").alias("damount"),
    )
    leave_1h = F.struct(
        (F.col("ts_ms") + HOUR_MS).alias("at"),
        F.lit(0).alias("arrives"),
        F.lit(-1.0).alias("d1"),
        (-_small()).alias("dsmall"),
        F.lit(0.0).alias("d24"),
        F.lit(0.0).alias("damount"),
    )
    leave_24h = F.struct(
        (F.col("ts_ms") + DAY_MS).alias("at"),
        F.lit(0).alias("arrives"),
        F.lit(0.0).alias("d1"),
        F.lit(0.0).alias("dsmall"),
        F.lit(-1.0).alias("d24"),
        (-F.col("amount")).alias("damount"),
    )
    w = (
        Window.partitionBy(*keys)
        .orderBy("ev.at", "ev.arrives", "txn_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.withColumn("ev", F.explode(F.array(arrive, leave_1h, leave_24h)))
        .withColumns(
            {
                "count_1h": _zero(F.sum("ev.d1").over(w)),
                "small_1h": _zero(F.sum("ev.dsmall").over(w)),
                "count_24h": _zero(F.sum("ev.d24").over(w)),
                "sum_24h": _zero(F.sum("ev.damount").over(w)),
            }
        )
        .where(F.col("ev.arrives") == 1)
        .drop("ev")
    )


def _firsts(df: DataFrame, keys: list[str], members: list[tuple]) -> DataFrame:
    """First earlier time of (key, member), for each (member, first, distinct)."""
    for member, first, _ in members:
        df = df.withColumn(first, F.min("ts_ms").over(_prior(*keys, member)))
    return df


def _distincts(keys: list[str], members: list[tuple]) -> dict[str, Column]:
    """Number of members so far, this one included. Spark has no distinct window aggregate; a
    running sum of firsts is one."""
    return {
        distinct: F.sum(flag(F.col(first).isNull())).over(_so_far(*keys))
        for _, first, distinct in members
    }


def _first_seen_carried(
    df: DataFrame, placed: DataFrame, key: str, member: str, first: str, distinct: str
) -> DataFrame:
    """``placed`` holds the same rows as ``df``, staged, so that the carried part does not
    repeat the windows behind ``df``."""
    pairs = (
        placed.groupBy(key, member, "chunk")
        .agg(F.min("ts_ms").alias("chunk_first"))
        .withColumn("carry_first", F.min("chunk_first").over(earlier_chunks(key, member)))
    )
    totals = (
        pairs.groupBy(key, "chunk")
        .agg(F.sum(F.col("carry_first").isNull().cast("double")).alias("fresh"))
        .withColumn("carry_distinct", _zero(F.sum("fresh").over(earlier_chunks(key))))
        .select(key, "chunk", "carry_distinct")
    )
    new = flag(F.col(first).isNull())
    return (
        df.join(
            pairs.select(key, "chunk", member, "carry_first"), [key, "chunk", member]
        )
        .join(totals, [key, "chunk"])
        .withColumn(
            first,
            F.coalesce(
                F.col("carry_first"),
                F.min("ts_ms").over(_prior(key, "chunk", member)),
            ),
        )
        .withColumn(
            distinct, F.col("carry_distinct") + F.sum(new).over(_so_far(key, "chunk"))
        )
        .drop("carry_first", "carry_distinct")
    )


USER_MEMBERS = [
    ("device_id", "user_device_first_ms", "user_devices"),
    ("merchant_id", "user_merchant_first_ms", "user_merchants"),
]
DEVICE_MEMBERS = [("user_id", "device_user_first_ms", "device_users")]


def _user_cold(df: DataFrame) -> DataFrame:
    key = ["user_id"]
    w = Window.partitionBy(*key).orderBy(*ORDER)
    instant = Window.partitionBy(*key).orderBy("ts_ms")
    # One shuffle by the key serves every window. Windows by (user, member) come first: all
    # others then share one sort.
    out = _firsts(df.repartition("user_id"), key, USER_MEMBERS).withColumns(
        {
            "row_no": F.row_number().over(w).cast("long"),
            "mean_prior": F.avg("amount").over(_prior(*key)),
            "std_prior": F.stddev_samp("amount").over(_prior(*key)),
            "first_ms": F.min("ts_ms").over(_prior(*key)),
            **_distincts(key, USER_MEMBERS),
            **_last_event(key),
            **_running_totals(key),
            "n_before": (F.rank().over(instant) - 1).cast("long"),
        }
    )
    return _capped(_velocity_frames(out, key), key)


def _user_hot(hot: DataFrame, policy: SkewPolicy) -> DataFrame:
    key = ["user_id", "chunk"]
    parts = stage(chunked(hot, "user_id", RECENT_CAP, policy), "hot-users")
    rows = parts.where(~F.col("is_halo"))
    own = F.when(~F.col("is_halo"), F.col("amount"))

    before = earlier_chunks("user_id")
    n, s = F.col("cn"), F.col("cmean") * F.col("cn")
    carry = (
        rows.groupBy(*key)
        .agg(
            F.count("*").alias("cn"),
            F.avg("amount").alias("cmean"),
            F.var_pop("amount").alias("cvar"),
        )
        .withColumn("n0", _zero(F.sum("cn").over(before)))
        .withColumn("mean0", _zero(F.sum(s).over(before)) / F.greatest("n0", F.lit(1)))
        .withColumn(
            "m20",
            _zero(F.sum(n * F.col("cvar") + s * F.col("cmean")).over(before))
            - F.col("n0") * F.col("mean0") * F.col("mean0"),
        )
        .select(*key, "n0", "mean0", "m20")
    )
    own_prior = _prior(*key)
    out = (
        parts.join(carry, key, "left")
        .withColumns(
            {
                "n1": F.count(own).over(own_prior).cast("double"),
                "mean1": _zero(F.avg(own).over(own_prior)),
                "var1": _zero(F.var_pop(own).over(own_prior)),
                **_last_event(key),
                **_running_totals(key),
            }
        )
        .withColumn("m21", F.col("var1") * F.col("n1"))
    )
    out = _velocity_events(out, key)
    n = F.col("n0") + F.col("n1")
    shift = F.col("mean1") - F.col("mean0")
    out = (
        _capped(out, key)
        .where(~F.col("is_halo"))
        .withColumn("m2", F.col("m20") + F.col("m21") + shift * shift * F.col("n0") * F.col("n1") / n)
        .withColumn(
            "mean_prior",
            F.when(
                n > 0,
                (F.col("n0") * F.col("mean0") + F.col("n1") * F.col("mean1")) / n,
            ),
        )
        .withColumn(
            "std_prior",
            F.when(n > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (n - 1))),
        )
        .withColumn(
            "first_ms", F.when(F.col("row_no") > 1, F.col("key_lo"))
        )
        .drop("n0", "n1", "mean0", "mean1", "m20", "m21", "m2", "var1", "is_halo")
    )
    out = _first_seen_carried(
        out, rows, "user_id", "device_id", "user_device_first_ms", "user_devices"
    )
    return _first_seen_carried(
        out, rows, "user_id", "merchant_id", "user_merchant_first_ms", "user_merchants"
    )


def user_history(df: DataFrame, split: Split, policy: SkewPolicy = DEFAULT) -> DataFrame:
    """Adds USER_STATE: the account before the event, ordered by (ts_ms, txn_id)."""
    cols = [*df.columns, *USER_STATE]
    if split.hot_keys is None:
        return _user_cold(df).select(*cols)
    cold, hot = split.apply(df)
    return (
        _user_cold(cold)
        .select(*cols)
        .unionByName(_user_hot(hot, policy).select(*cols))
    )


def _device_cold(df: DataFrame) -> DataFrame:
    key = ["device_id"]
    w = Window.partitionBy(*key).orderBy(*ORDER)
    instant = Window.partitionBy(*key).orderBy("ts_ms")
    out = _firsts(df.repartition("device_id"), key, DEVICE_MEMBERS).withColumns(
        {
            "device_row_no": F.row_number().over(w).cast("long"),
            "device_first_ms": F.min("ts_ms").over(_prior(*key)),
            **_distincts(key, DEVICE_MEMBERS),
            "device_n_before": (F.rank().over(instant) - 1).cast("long"),
        }
    )
    return _strictly_before(out, key)


def _strictly_before(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct users and first use strictly earlier in time than the event."""
    new = flag(F.col("device_user_first_ms").isNull())
    users_incl = F.col("device_users")
    # The first row of an instant sees exactly the strictly earlier rows before it.
    peers = Window.partitionBy(*keys, "ts_ms").orderBy("txn_id")
    return df.withColumn(
        "device_users_before", F.first(users_incl - new).over(peers)
    ).withColumn(
        "device_first_before_ms",
        F.when(F.col("device_first_ms") < F.col("ts_ms"), F.col("device_first_ms")),
    )


def _device_hot(hot: DataFrame, policy: SkewPolicy) -> DataFrame:
    parts = stage(
        chunked(
            hot, "device_id", 0, policy, n_before="device_n_before", row_no="device_row_no"
        ),
        "hot-devices",
    )
    out = parts.withColumn(
        "device_first_ms", F.when(F.col("device_row_no") > 1, F.col("key_lo"))
    )
    out = _first_seen_carried(
        out, parts, "device_id", "user_id", "device_user_first_ms", "device_users"
    )
    return _strictly_before(out, ["device_id", "chunk"])


def device_history(
    df: DataFrame, split: Split, policy: SkewPolicy = DEFAULT
) -> DataFrame:
    """Adds DEVICE_STATE: the device before the event, over all accounts."""
    cols = [*df.columns, *DEVICE_STATE]
    if split.hot_keys is None:
        return _device_cold(df).select(*cols)
    cold, hot = split.apply(df)
    return (
        _device_cold(cold)
        .select(*cols)
        .unionByName(_device_hot(hot, policy).select(*cols))
    )
