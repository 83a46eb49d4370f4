"""As-of look-ups for flagged events, for all of them at once.

Every look-up is strictly before the event. Facts that come from labels are also cut at
``cutoff_ms``; an event before the cutoff is given what was known at its own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.functions.scalar import days_between, half_up
from fraudspark.functions.text import ist_string, minutes_before
from fraudspark.operators.asof import Timeline, bound, earliest, medians
from fraudspark.operators.neighbours import exact_neighbours
from fraudspark.schemas import FEATURES, HOUR_MS, PUBLIC_FIELDS
from fraudspark.sources.staging import stage

HISTORY_HOURS = 336
HISTORY_LIMIT = 60
NEIGHBOURS = 7


def public_fields(df: DataFrame) -> DataFrame:
    """The fields evidence may show; doubles rounded to four decimals."""
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    return df.select(
        *[
            half_up(F.col(c), 4).alias(c) if c in doubles else F.col(c)
            for c in PUBLIC_FIELDS
        ]
    )


def user_history(
    anchors: DataFrame, rows: DataFrame, hours: float = 72, limit: int = 25
) -> DataFrame:
    """Each anchor with the newest ``limit`` earlier rows of its account within ``hours``.

    Rows are numbered per account (``row_no``) and an anchor knows how many rows are strictly
    earlier (``n_before``), so its history is the run of numbers just below. Numbers are
    grouped in blocks of ``limit``: an anchor meets two blocks of its account at most, however
    long the account's history is.

    ``anchors``: txn_id, user_id, device_id, merchant_id, ts_ms, n_before. ``rows``: PUBLIC_FIELDS, row_no, and
    model_score (null where the row was not scored).
    """
    if not 1 <= hours <= 1440:
        raise ValueError("hours must be between 1 and 1440")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    first = F.greatest(F.col("n_before") - limit, F.lit(0))
    a = (
        anchors.where(F.col("n_before") > 0)
        .select(
            F.col("txn_id").alias("case_txn_id"),
            "user_id",
            F.col("ts_ms").alias("anchor_ms"),
            F.col("device_id").alias("anchor_device_id"),
            F.col("merchant_id").alias("anchor_merchant_id"),
            first.alias("first_no"),
            F.col("n_before").alias("last_no"),
        )
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.floor(F.col("first_no") / limit),
                    F.floor((F.col("last_no") - 1) / limit),
                )
            ),
        )
    )
    r = rows.withColumn("block", F.floor((F.col("row_no") - 1) / limit))
    return (
        a.join(r, ["user_id", "block"])
        .where(
            (F.col("row_no") > F.col("first_no"))
            & (F.col("row_no") <= F.col("last_no"))
            & (F.col("ts_ms") >= F.col("anchor_ms") - int(hours * HOUR_MS))
        )
        .withColumn("when", ist_string(F.col("ts_ms")))
        .withColumn(
            "minutes_before", minutes_before(F.col("anchor_ms"), F.col("ts_ms"))
        )
        .withColumn("amount", half_up(F.col("amount"), 4))
        .drop("block", "first_no", "last_no")
    )


def history_summary(
    anchors: DataFrame, history: DataFrame, hours: float, more: list[Column] = ()
) -> DataFrame:
    """One row per anchor, anchors without history included. A group holds ``limit`` rows at
    most. The median is the upper one."""
    amounts = F.array_sort(F.collect_list("amount"))
    per_case = history.groupBy("case_txn_id").agg(
        F.count("*").alias("history_count"),
        amounts.alias("amounts"),
        F.max("amount").alias("max_amount"),
        F.count_distinct("device_id").alias("distinct_devices"),
        F.array_sort(F.collect_set("city")).alias("distinct_cities"),
        F.array_sort(F.collect_set("merchant_category")).alias("categories"),
        *more,
    )
    n = F.col("history_count")
    empty = F.array().cast("array<string>")
    extra = [
        c for c in per_case.columns
        if c not in ("case_txn_id", "history_count", "amounts", "max_amount",
                     "distinct_devices", "distinct_cities", "categories")
    ]
    return (
        anchors.select(F.col("txn_id").alias("case_txn_id"))
        .join(per_case, "case_txn_id", "left")
        .select(
            F.col("case_txn_id").alias("txn_id"),
            F.lit(float(hours)).alias("window_hours"),
            F.coalesce(n, F.lit(0)).alias("history_count"),
            half_up(
                F.element_at("amounts", (F.floor(n / 2) + 1).cast("int")), 2
            ).alias("median_amount"),
            half_up(F.col("max_amount"), 2).alias("max_amount"),
            F.coalesce("distinct_devices", F.lit(0)).alias("distinct_devices"),
            F.coalesce("distinct_cities", empty).alias("distinct_cities"),
            F.coalesce("categories", empty).alias("categories"),
            *extra,
        )
    )


def merchant_facts(anchors: DataFrame, txns: DataFrame, cutoff_ms: Column) -> DataFrame:
    """Per merchant and time of an anchor (cut at ``cutoff_ms``), over the merchant's rows strictly
    before: count, distinct users, confirmed fraud rate, median amount.

    A merchant without any row before the cutoff has nulls, one whose rows all come later than the
    anchor has counts of 0. Anchors at or after the cutoff share one point per merchant.
    """
    resolved = txns.where(F.col("ts_ms") < cutoff_ms).withColumnRenamed("merchant_id", "key")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    events = resolved.select(
        "key",
        F.col("ts_ms").alias("at"),
        one.alias("resolved_txns"),
        F.col("is_fraud").cast("long").alias("frauds"),
        none.alias("distinct_users"),
        F.col("amount").isNotNull().cast("long").alias("priced"),
        F.col("amount").cast("double").alias("value"),
    ).unionByName(
        earliest(resolved, ["key", "user_id"], "ts_ms").select(
            "key", F.col("ts_ms").alias("at"), F.col("user_id").isNotNull().cast("long").alias("distinct_users")
        ),
        allowMissingColumns=True,
    )
    points = anchors.select(
        F.col("merchant_id").alias("key"), bound(F.col("ts_ms"), cutoff_ms).alias("at")
    )
    line = Timeline(points, events, ["resolved_txns", "frauds", "distinct_users", "priced"])
    totals = stage(line.totals(), "merchant-totals")
    median = medians(line.values("priced"), totals.select(F.col("key").alias("node"), F.col("priced").alias("n")))
    known = F.col("resolved_txns_all") > 0
    return (
        totals.join(median.withColumnsRenamed({"node": "key", "n": "priced"}), ["key", "priced"], "left")
        .where(known)
        .select(
            F.col("key").alias("merchant_id"),
            F.col("at").alias("known_ms"),
            "resolved_txns",
            "distinct_users",
            half_up(F.try_divide(F.col("frauds").cast("double"), F.col("resolved_txns")), 4).alias(
                "confirmed_fraud_rate"
            ),
            half_up(F.col("median"), 4).alias("merchant_median_amount"),
        )
    )


def merchant_asof(
    anchors: DataFrame, merchants: DataFrame, facts: DataFrame, cutoff_ms: Column
) -> DataFrame:
    """Merchant of each anchor as of the event; unknown merchants give nulls."""
    profile = merchants.select(
        "merchant_id",
        F.col("category").alias("merchant_profile_category"),
        F.col("city").alias("merchant_city"),
        F.col("country").alias("merchant_country"),
        F.col("is_online").alias("merchant_is_online"),
        F.col("created_ms"),
        F.col("category_risk").alias("category_risk_prior"),
    )
    known = anchors.select(
        "txn_id", "merchant_id", "ts_ms", bound(F.col("ts_ms"), cutoff_ms).alias("known_ms")
    ).join(profile, "merchant_id", "left")
    listed = F.when(F.col("merchant_profile_category").isNotNull(), F.col("merchant_id"))
    return (
        known.withColumn("listed_id", listed)
        .join(facts.withColumnRenamed("merchant_id", "listed_id"), ["listed_id", "known_ms"], "left")
        .withColumn(
            "merchant_age_days",
            half_up(days_between(F.col("ts_ms"), F.col("created_ms")), 1),
        )
        .drop("created_ms", "ts_ms", "listed_id", "known_ms")
    )


def confirmed_device_fraud(
    anchors: DataFrame, txns: DataFrame, cutoff_ms: Column
) -> DataFrame:
    """Per device and time of an anchor (cut at ``cutoff_ms``), confirmed frauds strictly before."""
    events = txns.where((F.col("ts_ms") < cutoff_ms) & F.col("is_fraud")).select(
        F.col("device_id").alias("key"),
        F.col("ts_ms").alias("at"),
        F.lit(1).cast("long").alias("confirmed_fraud_txns"),
    )
    points = anchors.select(
        F.col("device_id").alias("key"), bound(F.col("ts_ms"), cutoff_ms).alias("at")
    )
    totals = Timeline(points, events, ["confirmed_fraud_txns"]).totals()
    return totals.select(
        F.col("key").alias("device_id"), F.col("at").alias("known_ms"), "confirmed_fraud_txns"
    )


def device_asof(
    anchors: DataFrame, confirmed: DataFrame, cutoff_ms: Column
) -> DataFrame:
    """Device of each anchor as of the event. Counts come from DEVICE_STATE of the anchor."""
    return (
        anchors.select(
            "txn_id",
            "device_id",
            "ts_ms",
            F.col("device_n_before").alias("device_txn_count"),
            F.col("device_users_before").cast("long").alias("device_distinct_users"),
            "device_first_before_ms",
            bound(F.col("ts_ms"), cutoff_ms).alias("known_ms"),
        )
        .join(confirmed, ["device_id", "known_ms"], "left")
        .select(
            "txn_id",
            "device_id",
            ist_string(F.col("device_first_before_ms")).alias("first_seen"),
            F.coalesce(
                half_up(
                    days_between(F.col("ts_ms"), F.col("device_first_before_ms")), 2
                ),
                F.lit(0.0),
            ).alias("device_age_days"),
            "device_txn_count",
            "device_distinct_users",
            F.coalesce("confirmed_fraud_txns", F.lit(0)).alias("confirmed_fraud_txns"),
        )
    )


def user_profile(anchors: DataFrame, users: DataFrame) -> DataFrame:
    return (
        anchors.select("txn_id", "user_id", "ts_ms")
        .join(users.select("user_id", "home_city", "account_created_ms"), "user_id", "left")
        .select(
            "txn_id",
            "user_id",
            "home_city",
            half_up(
                days_between(F.col("ts_ms"), F.col("account_created_ms")), 1
            ).alias("account_age_days"),
        )
    )


def transaction_card(txns: DataFrame, decisions: DataFrame) -> DataFrame:
    """The event with the model's view of it; events without a decision keep nulls."""
    model = decisions.select(
        "txn_id",
        half_up(F.col("score"), 4).alias("score"),
        half_up(F.col("threshold"), 4).alias("threshold"),
        "model_version",
        F.transform(
            "reasons",
            lambda r: F.struct(
                r["feature"].alias("feature"),
                half_up(r["value"], 3).alias("value"),
                r["direction"].alias("effect"),
            ),
        ).alias("top_reasons"),
    )
    return (
        public_fields(txns)
        .withColumn("when", ist_string(F.col("ts_ms")))
        .join(model, "txn_id", "left")
    )


def standard_vectors(rows: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """``id`` and ``vec``: standardised features as a vector of length 1 (a hair less, so that a
    row at the mean has one)."""
    z = F.array(*[(F.col(f).cast("double") - F.lit(stats[f][0])) / F.lit(stats[f][1]) for f in FEATURES])
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, e: s + e * e)) + 1e-9
    return rows.select(F.col("txn_id").alias("id"), z.alias("z")).select(
        "id", F.transform("z", lambda e: e / norm).alias("vec")
    )


def similar_cases(
    anchors: DataFrame,
    bank: DataFrame,
    stats: dict[str, tuple[float, float]],
    k: int = 5,
) -> DataFrame:
    """The k nearest resolved cases by cosine similarity of standardised features, over a bank of
    any size: both sides are dealt as blocks and only k rows per anchor and block leave a task.
    Similarities are compared at nine decimals, equal ones by txn_id."""
    if not 1 <= k <= 20:
        raise ValueError("k must be between 1 and 20")
    # read twice, as vectors and for the cases shown
    bank = stage(bank.select("txn_id", "is_fraud", "fraud_type", *FEATURES), "case-bank")
    found = exact_neighbours(standard_vectors(anchors, stats), standard_vectors(bank, stats), k)
    shown = bank.select(
        F.col("txn_id").alias("case_txn_id"),
        "is_fraud",
        "fraud_type",
        "amount",
        "txn_count_1h",
        (F.col("is_new_device") > 0).alias("is_new_device"),
        "speed_kmh",
    )
    return (
        found.select(
            F.col("id").alias("txn_id"), F.col("place").cast("long").alias("place"),
            F.col("neighbour").alias("case_txn_id"), "similarity",
        )
        .join(shown, "case_txn_id")
        .withColumn("outcome", F.when(F.col("is_fraud"), "fraud").otherwise("legit"))
        .withColumns({c: half_up(F.col(c), 4) for c in ("similarity", "amount", "speed_kmh")})
    )


def fraud_share(similar: DataFrame) -> DataFrame:
    return similar.groupBy("txn_id").agg(
        half_up(F.avg(F.col("is_fraud").cast("double")), 2).alias("fraud_share"),
        F.count("*").alias("neighbours"),
    )
