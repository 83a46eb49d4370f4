"""Rule and linear scores, decision rows, reason codes, promotion of models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.functions.scalar import flag, half_up, sum_columns
from fraudspark.schemas import DAY_MS, DECISION_TTL_DAYS

SCORE_DIGITS = 6
REASON = "struct<feature:string,value:double,contribution:double,direction:string>"


def rules() -> list[Column]:
    """Eight hand-written rules over feature columns."""
    c = F.col
    return [
        c("amount_z") > 3,
        c("txn_count_1h") >= 4,
        (c("is_new_device") == 1) & (c("amount_ratio_mean") > 2),
        c("speed_kmh") > 500,
        c("small_txn_count_1h") >= 3,
        (c("is_night") == 1) & (c("category_risk") >= 0.18),
        c("is_international") == 1,
        c("device_user_count") >= 3,
    ]


def rule_score() -> Column:
    return sum_columns([flag(r) for r in rules()])


@dataclass(frozen=True)
class LinearModel:
    """A stored logistic model on raw features. ``means`` is the training background that
    contributions are measured against; a feature a row lacks counts as 0."""

    version: str
    intercept: float
    weights: dict[str, float]
    means: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def logit(self, columns: list[str] | None = None) -> Column:
        terms = [
            F.coalesce(F.col(f), F.lit(0.0)) * w
            for f, w in self.weights.items()
            if columns is None or f in columns
        ]
        return sum_columns([F.lit(self.intercept), *terms])

    def score(self, columns: list[str] | None = None) -> Column:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit(columns)))
        return half_up(p, SCORE_DIGITS)

    def contributions(self) -> Column:
        """One struct per feature: weight times distance from the training mean."""
        return F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.coalesce(F.col(f), F.lit(0.0)).alias("value"),
                    (
                        (F.coalesce(F.col(f), F.lit(0.0)) - self.means.get(f, 0.0)) * w
                    ).alias("contribution"),
                )
                for f, w in self.weights.items()
            ]
        )


def top_reasons(contributions: Column, k: int = 3) -> Column:
    """The k largest contributions by absolute value; equal ones in feature order."""
    keyed = F.transform(
        contributions,
        lambda r: F.struct(
            (-F.abs(r["contribution"])).alias("rank"),
            r["feature"].alias("feature"),
            r["value"].alias("value"),
            r["contribution"].alias("contribution"),
        ),
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, k),
        lambda r: F.struct(
            r["feature"].alias("feature"),
            r["value"].alias("value"),
            r["contribution"].alias("contribution"),
            F.when(r["contribution"] > 0, "raises").otherwise("lowers").alias("direction"),
        ),
    )


def batch_score(
    features: DataFrame, model: LinearModel, explain: bool = True, keep: list[str] = ()
) -> DataFrame:
    """Decision rows. Reasons are only worked out for flagged rows."""
    scored = features.withColumn("score", model.score(features.columns))
    flagged = F.col("score") >= model.threshold
    none = F.array().cast(f"array<{REASON}>")
    reasons = (
        F.when(flagged, top_reasons(model.contributions())).otherwise(none)
        if explain
        else none
    )
    return scored.select(
        "txn_id",
        "ts_ms",
        "user_id",
        "score",
        flagged.alias("flagged"),
        F.lit(model.threshold).alias("threshold"),
        F.lit(model.version).alias("model_version"),
        reasons.alias("reasons"),
        *keep,
    )


def reason_codes(decisions: DataFrame) -> DataFrame:
    """(txn_id, place, feature, value, contribution, direction) of flagged decisions."""
    return (
        decisions.where("flagged")
        .select("txn_id", F.posexplode("reasons").alias("place", "r"))
        .select("txn_id", (F.col("place") + 1).alias("place"), "r.*")
    )


def rank_importance(features: DataFrame, model: LinearModel) -> DataFrame:
    """Features by mean absolute contribution, largest first."""
    return (
        features.select(F.inline(model.contributions()))
        .groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )


def flag_filter(decisions: DataFrame, threshold: float | None = None) -> DataFrame:
    """Flagged means score >= threshold, the threshold included."""
    t = F.col("threshold") if threshold is None else F.lit(threshold)
    return decisions.where(F.col("score") >= t)


def flagged_queue(decisions: DataFrame) -> DataFrame:
    """One message per flagged event, in time order within its account."""
    first = decisions.where("flagged").dropDuplicates(["txn_id"])
    return first.select("txn_id", "user_id", "ts_ms", "score", "model_version")


def retention_filter(rows: DataFrame, now_ms: Column) -> DataFrame:
    """Rows whose expiry, 30 days after the event, is still to come."""
    expires = F.col("ts_ms") + DECISION_TTL_DAYS * DAY_MS
    return rows.withColumn("expires_ms", expires).where(F.col("expires_ms") > now_ms)


# --- model promotion ---


def challenger_decision(
    champion: DataFrame, challenger: DataFrame, min_improvement: float = 0.01
) -> DataFrame:
    """Both frames: one row per ``pair`` with recall_at_1pct and pr_auc. A pair without a
    champion promotes the challenger."""
    a = champion.select(
        "pair",
        F.col("recall_at_1pct").alias("old_recall"),
        F.col("pr_auc").alias("old_pr_auc"),
    )
    joined = challenger.join(a, "pair", "left")
    gain = F.col("recall_at_1pct") - F.col("old_recall")
    low_gain = gain < min_improvement
    worse = F.col("pr_auc") < F.col("old_pr_auc") - 0.005
    first = F.col("old_recall").isNull()

    def n(c: Column) -> Column:
        return F.format_string("%.3f", c)

    signed = F.format_string("%+.3f", gain)
    reason = (
        F.when(first, F.lit("no champion yet"))
        .when(
            low_gain,
            F.concat(
                F.lit("recall@1%FPR gain "),
                signed,
                F.lit(f" below required {min_improvement:+.3f}"),
            ),
        )
        .when(
            worse,
            F.concat(
                F.lit("PR-AUC regressed "),
                n(F.col("pr_auc")),
                F.lit(" < "),
                n(F.col("old_pr_auc")),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("recall@1%FPR "),
                n(F.col("old_recall")),
                F.lit(" -> "),
                n(F.col("recall_at_1pct")),
                F.lit(" (+"),
                n(gain),
                F.lit("), PR-AUC "),
                n(F.col("pr_auc")),
            )
        )
    )
    promote = first | (~low_gain & ~worse)
    return joined.select("pair", F.coalesce(promote, F.lit(False)).alias("promote"), reason.alias("reason"))


def promotion_history(promotions: DataFrame, keep: int = 50) -> DataFrame:
    """The newest ``keep`` promotions with the version each one replaced. The limit is applied
    before the window, so the window sees ``keep`` + 1 rows at most."""
    newest = promotions.orderBy(F.desc("promoted_ms"), F.desc("version")).limit(keep + 1)
    w = Window.partitionBy(F.lit(1)).orderBy("promoted_ms", "version")
    back = Window.partitionBy(F.lit(1)).orderBy(F.desc("promoted_ms"), F.desc("version"))
    return (
        newest.withColumn("previous", F.lag("version").over(w))
        .withColumn("age_rank", F.row_number().over(back))
        .where(F.col("age_rank") <= keep)
    )


def champion_asof(events: DataFrame, promotions: DataFrame) -> DataFrame:
    """Which version was champion at each event: the last promotion at or before it.

    ``promotions`` is a promotion history, 50 rows at most. Each reign is listed under the
    days it touches, so the as-of look-up is an equi-join on the day.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("promoted_ms", "version")
    span = events.agg(F.max("ts_ms").alias("last_ms"))
    reigns = (
        promotions.select("version", "promoted_ms")
        .withColumn("until_ms", F.lead("promoted_ms").over(w))
        .withColumn("last_ms", span.scalar())
        .withColumn(
            "end_ms", F.least(F.coalesce("until_ms", F.col("last_ms") + 1), F.col("last_ms") + 1)
        )
        .where(F.col("promoted_ms") < F.col("end_ms"))
        .withColumn(
            "day",
            F.explode(
                F.sequence(
                    F.floor(F.col("promoted_ms") / DAY_MS),
                    F.floor((F.col("end_ms") - 1) / DAY_MS),
                )
            ),
        )
        .select("version", "promoted_ms", "end_ms", "day")
    )
    left = events.withColumn("day", F.floor(F.col("ts_ms") / DAY_MS))
    hit = (
        (left["day"] == reigns["day"])
        & (left["ts_ms"] >= reigns["promoted_ms"])
        & (left["ts_ms"] < reigns["end_ms"])
    )
    return (
        left.join(F.broadcast(reigns), hit, "left")
        .drop(reigns["day"], left["day"])
        .drop("end_ms")
    )


def label_feedback(
    feature_log: DataFrame, labels: DataFrame, cutoff_ms: Column
) -> DataFrame:
    """Logged features with the labels that had arrived before the cutoff. ``labels`` has
    txn_id, arrived_ms and the label columns."""
    known = labels.where(F.col("arrived_ms") < cutoff_ms)
    return feature_log.join(known, "txn_id", "inner")
