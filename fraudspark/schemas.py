"""Table schemas and the fixed values that every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: they must equal the published ones for results to agree. ---

CHANNELS = ["UPI", "CARD", "NETBANKING"]

FRAUD_TYPES = [
    "none",
    "account_takeover",
    "card_testing",
    "velocity_burst",
    "geo_jump",
    "merchant_collusion",
    "low_and_slow",
]

VERDICTS = ["fraud", "legit", "needs_review"]

ACTIONS = [
    "block_card_and_contact_customer",
    "step_up_authentication",
    "monitor",
    "approve",
]

ACTION_LABELS = {
    "block_card_and_contact_customer": "Block instrument and contact customer",
    "step_up_authentication": "Step-up authentication on next attempt",
    "monitor": "Monitor account",
    "approve": "Approve / release hold",
}

# category -> static risk prior, in category order
CATEGORY_RISK = {
    "grocery": 0.02,
    "food_delivery": 0.03,
    "fuel": 0.02,
    "utilities": 0.02,
    "mobile_recharge": 0.03,
    "pharmacy": 0.02,
    "apparel": 0.05,
    "ecommerce": 0.08,
    "entertainment": 0.04,
    "electronics": 0.18,
    "travel": 0.12,
    "gaming": 0.22,
    "gift_cards": 0.35,
    "jewellery": 0.25,
    "forex": 0.30,
    "crypto": 0.40,
}
CATEGORIES = list(CATEGORY_RISK)
DEFAULT_CATEGORY_RISK = 0.1

NUMERIC_FEATURES = [
    "amount",
    "amount_log",
    "amount_z",
    "amount_ratio_mean",
    "txn_count_1h",
    "txn_count_24h",
    "amount_sum_24h",
    "small_txn_count_1h",
    "seconds_since_last",
    "is_new_device",
    "device_user_age_days",
    "is_new_merchant",
    "user_device_count",
    "device_user_count",
    "device_age_days",
    "distance_from_last_km",
    "speed_kmh",
    "hour_local",
    "is_night",
    "is_weekend",
    "is_online",
    "is_international",
    "is_home_city",
    "account_age_days",
    "txn_count_total",
    "category_risk",
    "merchant_age_days",
    "channel_card",
    "channel_netbanking",
]
FEATURES = NUMERIC_FEATURES + [f"cat_{c}" for c in CATEGORIES]

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
IST_OFFSET_MS = 19_800_000
MAX_GAP_SECONDS = 30 * 86_400.0
SMALL_AMOUNT = 100.0

RECENT_CAP = 500
KNOWN_DEVICES_CAP = 50
KNOWN_MERCHANTS_CAP = 300
DEVICE_USERS_CAP = 200

DECISION_TTL_DAYS = 30
BLOCK_CONFIDENCE = 0.8

# --- End of fixed values. ---

WIRE = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("merchant_category", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("city", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("is_online", T.BooleanType()),
    ]
)
WIRE_COLUMNS = WIRE.fieldNames()

LABELS = T.StructType(
    [
        T.StructField("is_fraud", T.BooleanType()),
        T.StructField("fraud_type", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)
LABEL_COLUMNS = LABELS.fieldNames()
TRANSACTION = T.StructType(WIRE.fields + LABELS.fields)

# The record as a gateway sends it: epoch seconds, no labels.
PAYLOAD = T.StructType(
    [
        T.StructField("ts", T.DoubleType()) if f.name == "ts_ms" else f
        for f in WIRE.fields
    ]
)

USER = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("home_city", T.StringType()),
        T.StructField("home_lat", T.DoubleType()),
        T.StructField("home_lon", T.DoubleType()),
        T.StructField("account_created_ms", T.LongType()),
        T.StructField("spend_level", T.DoubleType()),
    ]
)

MERCHANT = T.StructType(
    [
        T.StructField("merchant_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("is_online", T.BooleanType()),
        T.StructField("created_ms", T.LongType()),
        T.StructField("category_risk", T.DoubleType()),
    ]
)

FEATURE_FIELDS = [T.StructField(f, T.DoubleType()) for f in FEATURES]
FEATURE_LOG = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        *FEATURE_FIELDS,
    ]
)
FEATURE_LOG_TABLE = T.StructType(
    [
        *FEATURE_LOG.fields,
        T.StructField("day", T.IntegerType()),
        T.StructField("hour", T.IntegerType()),
    ]
)

EVAL_CASE = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("is_fraud", T.BooleanType()),
        T.StructField("fraud_type", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("stratum", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("amount", T.DoubleType()),
    ]
)

PUBLIC_FIELDS = [
    "txn_id",
    "ts_ms",
    "user_id",
    "merchant_id",
    "merchant_category",
    "device_id",
    "channel",
    "amount",
    "city",
    "country",
    "is_online",
]
