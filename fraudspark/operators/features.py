"""The 45 features of an event, from its state columns and two dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.scalar import (
    age_days,
    category_onehots,
    clamp,
    flag,
    gap_seconds,
    haversine_km,
    hour_local,
    speed_kmh,
    weekday_local,
)
from fraudspark.operators.caps import SETS, apply_set_caps, survey
from fraudspark.operators.skew import DEFAULT, SkewPolicy
from fraudspark.operators.windows import device_history, user_history
from fraudspark.schemas import (
    DEFAULT_CATEGORY_RISK,
    FEATURES,
    LABEL_COLUMNS,
)
from fraudspark.sources.staging import stage

PROFILE = ["home_city", "account_created_ms"]
MERCHANT_FACTS = ["merchant_created_ms", "category_risk"]


def with_reference(
    txns: DataFrame,
    users: DataFrame,
    merchants: DataFrame,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Left joins on account and merchant; unknown ones keep nulls.

    Both dimension keys are unique, so a hot key only makes a long probe side, which adaptive
    execution splits.
    """
    profile = users.select("user_id", *PROFILE)
    facts = merchants.select(
        "merchant_id", F.col("created_ms").alias("merchant_created_ms"), "category_risk"
    )
    return txns.join(facts, "merchant_id", "left").join(profile, "user_id", "left")


def amount_z(amount: Column, n: Column, mean: Column, std: Column) -> Column:
    z = F.when((n >= 3) & (std > 0), (amount - mean) / std).otherwise(F.lit(0.0))
    return clamp(z, -10.0, 50.0)


def amount_ratio(amount: Column, mean: Column) -> Column:
    return F.least(
        F.lit(100.0), F.when(mean > 0, amount / mean).otherwise(F.lit(1.0))
    )


def feature_columns() -> list[Column]:
    """FEATURES in order, over a row with transaction, state and reference columns."""
    c = F.col
    ts, amount = c("ts_ms"), c("amount")
    prior = c("row_no") - 1
    gap = gap_seconds(ts, c("prev_ms"))
    distance = F.coalesce(
        haversine_km(c("prev_lat"), c("prev_lon"), c("lat"), c("lon")), F.lit(0.0)
    )
    hour = hour_local(ts)
    home = F.coalesce(c("home_city"), c("prev_city"), c("city"))
    opened = F.coalesce(c("account_created_ms"), c("first_ms"))
    columns = {
        "amount": amount,
        "amount_log": F.log1p(amount),
        "amount_z": amount_z(amount, prior, c("mean_prior"), c("std_prior")),
        "amount_ratio_mean": amount_ratio(amount, c("mean_prior")),
        "txn_count_1h": c("count_1h"),
        "txn_count_24h": c("count_24h"),
        "amount_sum_24h": c("sum_24h"),
        "small_txn_count_1h": c("small_1h"),
        "seconds_since_last": gap,
        "is_new_device": flag(c("user_device_first_ms").isNull()),
        "device_user_age_days": age_days(ts, c("user_device_first_ms")),
        "is_new_merchant": flag(c("user_merchant_first_ms").isNull()),
        "user_device_count": c("user_devices"),
        "device_user_count": c("device_users"),
        "device_age_days": age_days(ts, c("device_first_ms")),
        "distance_from_last_km": distance,
        "speed_kmh": speed_kmh(distance, gap),
        "hour_local": hour,
        "is_night": flag(hour < 5.5),
        "is_weekend": flag(weekday_local(ts) >= 5),
        "is_online": flag(c("is_online")),
        "is_international": flag(c("country") != "IN"),
        "is_home_city": flag(c("city") == home),
        "account_age_days": age_days(ts, opened),
        "txn_count_total": prior.cast("double"),
        "category_risk": F.coalesce(
            c("category_risk"), F.lit(DEFAULT_CATEGORY_RISK)
        ),
        "merchant_age_days": age_days(ts, c("merchant_created_ms")),
        "channel_card": flag(c("channel") == "CARD"),
        "channel_netbanking": flag(c("channel") == "NETBANKING"),
    }
    numeric = [v.alias(k) for k, v in columns.items()]
    return numeric + category_onehots(c("merchant_category"))


def state_frame(
    txns: DataFrame, policy: SkewPolicy = DEFAULT, set_caps: bool = True
) -> DataFrame:
    """Transactions with USER_STATE and DEVICE_STATE.

    ``set_caps`` replays the accounts and devices whose device, merchant or user sets
    overflow, so that evicted members count as new again.
    """
    sets = SETS if set_caps else []
    devices = survey(txns, "device_id", policy, sets)
    accounts = survey(txns, "user_id", policy, sets)
    state = device_history(txns, devices.split, policy)
    if accounts.split.hot_keys is not None:
        # Both branches of the split read it; without this they would both compute it.
        state = stage(state, "device-state")
    state = user_history(state, accounts.split, policy)
    return apply_set_caps(state, txns, {**accounts.overflow, **devices.overflow})


def feature_frame(
    txns: DataFrame,
    users: DataFrame,
    merchants: DataFrame,
    policy: SkewPolicy = DEFAULT,
    set_caps: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per transaction: txn_id, ts_ms, user_id, FEATURES, the labels when present, and
    the columns named in ``keep``."""
    rows = with_reference(state_frame(txns, policy, set_caps), users, merchants, policy)
    labels = [c for c in LABEL_COLUMNS if c in txns.columns]
    names = ["txn_id", "ts_ms", "user_id"]
    extra = [c for c in (keep or []) if c not in names + labels + FEATURES]
    return rows.select(*names, *feature_columns(), *labels, *extra)
