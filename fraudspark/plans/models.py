"""Two small stored models: the champion and the challenger the fixed-coefficient jobs use."""

from __future__ import annotations

from fraudspark.operators.scoring import LinearModel

MEANS = {
    "amount_z": 0.03,
    "amount_ratio_mean": 1.05,
    "txn_count_1h": 0.8,
    "small_txn_count_1h": 0.2,
    "is_new_device": 0.03,
    "is_new_merchant": 0.2,
    "user_device_count": 4.0,
    "device_user_count": 1.6,
    "device_age_days": 14.7,
    "speed_kmh": 117.0,
    "is_international": 0.01,
    "is_home_city": 0.98,
    "category_risk": 0.11,
}

CHAMPION = LinearModel(
    version="lin-v1",
    intercept=-3.4,
    weights={
        "amount_z": 0.45,
        "amount_ratio_mean": 0.12,
        "txn_count_1h": 0.3,
        "small_txn_count_1h": 0.5,
        "is_new_device": 1.4,
        "is_new_merchant": 0.2,
        "user_device_count": 0.05,
        "device_user_count": 0.35,
        "device_age_days": -0.02,
        "speed_kmh": 0.0006,
        "is_international": 1.1,
        "is_home_city": -0.3,
        "category_risk": 1.5,
    },
    means=MEANS,
    threshold=0.3,
)

CHALLENGER = LinearModel(
    version="lin-v2",
    intercept=-3.9,
    weights={
        "amount_z": 0.7,
        "txn_count_1h": 0.25,
        "small_txn_count_1h": 0.4,
        "is_new_device": 1.0,
        "device_user_count": 0.8,
        "speed_kmh": 0.0003,
        "is_international": 0.6,
        "category_risk": 1.0,
    },
    means=MEANS,
    threshold=0.4,
)
