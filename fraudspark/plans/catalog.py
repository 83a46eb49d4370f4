"""Every batch query under its name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark import schemas as S
from fraudspark.functions import scalar as X
from fraudspark.functions.text import ist_string, minutes_before
from fraudspark.operators import decide as D
from fraudspark.operators import drift as P
from fraudspark.operators import evals as E
from fraudspark.operators import lookups as L
from fraudspark.operators import metrics as M
from fraudspark.operators import neighbours as NB
from fraudspark.operators import sampling as SA
from fraudspark.operators import scoring as SC
from fraudspark.operators import validate as V
from fraudspark.operators.features import feature_frame, with_reference
from fraudspark.operators.ranks import exact_quantiles, sequential_ids
from fraudspark.plans import investigation as I
from fraudspark.plans import oracle as O
from fraudspark.plans.models import CHALLENGER, CHAMPION
from fraudspark.sources import adapter, tables as TB
from fraudspark.sources.cache import DerivedTables
from fraudspark.sources.staging import new_path, stage

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def on_grid(df: DataFrame) -> DataFrame:
    """Puts doubles on the comparison grid of the SQL side and widens integers. NaN, and numbers
    whose digits on the grid a long cannot hold, stay as they are."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind == "double":
            v = F.floor(c(f.name) * 10.0**O.DIGITS + O.SHIFT) / F.lit(10.0**O.DIGITS)
            off = F.isnan(f.name) | (F.abs(f.name) >= 2.0**62 / 10.0**O.DIGITS)
            out.append(F.when(off, c(f.name)).otherwise(v).alias(f.name))
        elif kind in ("integer", "short", "byte"):
            out.append(c(f.name).cast("long").alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)


@dataclass
class Ctx:
    """One query's view of the tables."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        self.t = adapter.load(self.spark, self.sf_dir)

    @property
    def txns(self) -> DataFrame:
        return self.t.transactions

    def features(self, keep: list[str] | None = None) -> DataFrame:
        return feature_frame(self.txns, self.t.users, self.t.merchants, keep=keep)

    def scored(self, keep: list[str] | None = None) -> DataFrame:
        f = self.features(["context", *(keep or [])])
        return f.withColumns(
            {
                "score": CHAMPION.score(f.columns),
                "score2": CHALLENGER.score(f.columns),
                "rule_score": SC.rule_score(),
                "latency_ms": latency(),
            }
        )

    def work(self) -> I.CaseWork:
        return I.prepare(self.t, CHAMPION)

    def live_start(self) -> Column:
        """Start of the test window, as a scalar subquery."""
        b = SA.window_bounds(self.txns.select("ts_ms"), 7, 7, 7)
        return b.select("test_start").scalar()


def number() -> Column:
    return F.substring("txn_id", 2, 9).cast("long")


def latency() -> Column:
    """A service latency derived from the event, as the tables hold none."""
    return ((number() * 37) % 1200) / F.lit(10.0)


def query(name: str, sql: str | None = None, doubles: list[str] = ()):
    def register(fn: Callable[[Ctx], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: on_grid(fn(Ctx(spark, sf_dir)))
        if sql:
            ORACLES[name] = O.sql(sql, list(doubles))
        return fn

    return register


WIRE = ", ".join(S.WIRE_COLUMNS)
ALL = ", ".join([*S.WIRE_COLUMNS, *S.LABEL_COLUMNS])
XYZ = ["amount", "lat", "lon"]
KEYS = ["txn_id", "ts_ms", "user_id"]


# --- sources, sinks, validation ---


@query("src_transactions", f"SELECT {ALL} FROM txn", XYZ)
def _(x: Ctx):
    return x.txns


@query(
    "src_reference",
    """SELECT 'user' AS kind, user_id AS id, home_city AS city, account_created_ms AS created_ms,
       NULL::double AS category_risk FROM users
       UNION ALL SELECT 'merchant', merchant_id, city, created_ms, category_risk FROM merchants""",
    ["category_risk"],
)
def _(x: Ctx):
    u = x.t.users.select(
        F.lit("user").alias("kind"), c("user_id").alias("id"), c("home_city").alias("city"),
        c("account_created_ms").alias("created_ms"),
        F.lit(None).cast("double").alias("category_risk"),
    )
    m = x.t.merchants.select(
        F.lit("merchant").alias("kind"), c("merchant_id").alias("id"), "city", "created_ms",
        "category_risk",
    )
    return u.unionByName(m)


def payloads(txns: DataFrame) -> DataFrame:
    """Transactions as base64 JSON records, one a line, the way they come off a stream."""
    fields = [
        (c("ts_ms") / 1000.0).alias("ts") if n == "ts_ms" else c(n) for n in S.WIRE_COLUMNS
    ]
    coded = F.base64(F.to_json(F.struct(*fields)).cast("binary"))
    return txns.select(F.regexp_replace(coded, r"\s", "").alias("data"))


@query(
    "feature_log_scan",
    f"""SELECT txn_id, ts_ms, score, model_version, amount, amount_z, speed_kmh
       FROM decisions, bounds
       WHERE ts_ms // 3600000 >= (last_ms - {S.DAY_MS}) // 3600000""",
    ["score", "amount", "amount_z", "speed_kmh"],
)
def _(x: Ctx):
    w = x.work()
    path = new_path(x.spark, "feature-log")
    rows = w.live.withColumn("score", CHAMPION.score()).withColumn(
        "model_version", F.lit(CHAMPION.version)
    )
    TB.write_feature_log(rows, path)
    end = int(w.window.end)
    log = TB.load_feature_log(x.spark, path, end - S.DAY_MS, end)
    return log.select(
        "txn_id", "ts_ms", "score", "model_version", "amount", "amount_z", "speed_kmh"
    )


SOME = ["amount_z", "txn_count_1h", "device_user_count", "speed_kmh", "account_age_days"]


@query("feature_cache", f"SELECT txn_id, {', '.join(SOME)} FROM feats", SOME)
def _(x: Ctx):
    """Kept features: made once per state of the input files, and reused by every later call in
    any session that shares the folder."""
    kept = DerivedTables(x.spark, "features")
    sources = adapter.source_paths(x.sf_dir)
    work = I.prepare(x.t, CHAMPION, kept=kept, sources=sources)
    kept.sweep()
    return work.rows.select("txn_id", *SOME)


@query(
    "sink_flagged",
    "SELECT txn_id, user_id, ts_ms, score, model_version FROM anchors",
    ["score"],
)
def _(x: Ctx):
    f = x.features()
    live = f.where(c("ts_ms") >= x.live_start())
    return SC.flagged_queue(SC.batch_score(live, CHAMPION, explain=False))


RESULT_SQL = "txn_id, verdict, confidence, fraud_type, recommended_action"


def joined(column: str) -> Column:
    return F.concat_ws(" | ", column)


@query(
    "sink_cases",
    """SELECT case_id, txn_id, verdict, confidence, fraud_type, recommended_action, key_evidence,
       analyst_summary FROM told""",
    ["confidence"],
)
def _(x: Ctx):
    path = new_path(x.spark, "cases")
    rows = I.cases(x.work()).select(
        "case_id", "txn_id", "verdict", "confidence", "fraud_type", "recommended_action",
        joined("key_evidence").alias("key_evidence"), "analyst_summary", "report_md",
        c("ts_ms").alias("created_ms"),
    )
    TB.write_cases(rows, path)
    return TB.latest_cases(x.spark.read.parquet(path)).drop("report_md", "created_ms")


@query(
    "sink_alerts",
    f"SELECT {RESULT_SQL} FROM typed WHERE verdict = 'fraud' AND confidence >= 0.8",
    ["confidence"],
)
def _(x: Ctx):
    cases = I.cases(x.work())
    return D.alerts(cases).select(
        "txn_id", "verdict", "confidence", "fraud_type", "recommended_action"
    )


@query(
    "retention_filter",
    f"""SELECT txn_id, ts_ms, ts_ms + {30 * S.DAY_MS} AS expires_ms FROM txn,
       (SELECT max(ts_ms) + {10 * S.DAY_MS} AS now_ms FROM txn) n
       WHERE ts_ms + {30 * S.DAY_MS} > now_ms""",
)
def _(x: Ctx):
    now = x.txns.agg(F.max("ts_ms") + 10 * S.DAY_MS).scalar()
    return SC.retention_filter(x.txns.select("txn_id", "ts_ms"), now)


@query(
    "wire_projection",
    f"""SELECT {WIRE}, seq FROM (SELECT *, row_number() OVER (ORDER BY ts_ms, txn_id) AS seq
       FROM txn) WHERE seq > 200 AND seq <= 700""",
    XYZ,
)
def _(x: Ctx):
    return TB.wire_projection(x.txns, offset=200, limit=500)


@query(
    "reference_upsert",
    """SELECT merchant_id, merchant_category, city, ts_ms, txn_id FROM (SELECT *, row_number()
       OVER (PARTITION BY merchant_id ORDER BY ts_ms DESC, merchant_category DESC, city DESC,
       txn_id DESC) AS rn FROM txn) WHERE rn = 1""",
)
def _(x: Ctx):
    loads = x.txns.select("merchant_id", "merchant_category", "city", "ts_ms", "txn_id")
    return TB.reference_upsert(loads, "merchant_id", "ts_ms")


CASE_SQL = "SELECT txn_id, is_fraud, fraud_type, context, stratum, score, amount FROM cases"


def flagged_truth(w: I.CaseWork) -> DataFrame:
    return w.decisions(["is_fraud", "fraud_type", "context", "amount"]).where("flagged")


@query("case_set_io", CASE_SQL, ["score", "amount"])
def _(x: Ctx):
    path = new_path(x.spark, "case-set")
    TB.write_case_set(SA.build_cases(flagged_truth(x.work()), 100), path)
    return TB.read_case_set(x.spark, path)


@query(
    "validate_quarantine",
    f"""SELECT txn_id, amount, channel, array_to_string(list_filter([
         CASE WHEN NOT amount > 0 THEN 'amount not positive' END,
         CASE WHEN NOT list_contains({O.name_list(S.CHANNELS)}, channel) THEN 'unknown channel' END],
         lambda v: v IS NOT NULL), ';') AS violations
       FROM (SELECT txn_id, amount - 1e1 AS amount, channel FROM txn)""",
    ["amount"],
)
def _(x: Ctx):
    # Ten less than the amount, so that small events break the rule.
    rows = x.txns.withColumn("amount", c("amount") - 10.0)
    good, bad = V.good_and_bad(rows)
    all_rows = good.withColumn("violations", F.array().cast("array<string>")).unionByName(bad)
    return all_rows.select(
        "txn_id", "amount", "channel", F.concat_ws(";", "violations").alias("violations")
    )


@query(
    "time_split",
    """SELECT txn_id, ts_ms, CASE WHEN ts_ms >= test_start THEN 'test'
       WHEN ts_ms >= val_start THEN 'val' WHEN ts_ms >= train_start THEN 'train' END AS split
       FROM txn, bounds""",
)
def _(x: Ctx):
    return SA.time_split(x.txns.select("txn_id", "ts_ms"), 7, 7, 7)


@query(
    "flag_filter",
    f"SELECT txn_id, user_id, score FROM scored WHERE score >= {CHAMPION.threshold}",
    ["score"],
)
def _(x: Ctx):
    d = SC.batch_score(x.features(), CHAMPION, explain=False)
    return SC.flag_filter(d).select("txn_id", "user_id", "score")


@query(
    "label_cutoff",
    """SELECT merchant_id, count(*) AS resolved, sum(is_fraud::int)::bigint AS confirmed
       FROM txn, bounds WHERE ts_ms < test_start GROUP BY merchant_id""",
)
def _(x: Ctx):
    return (
        x.txns.where(c("ts_ms") < x.live_start())
        .groupBy("merchant_id")
        .agg(
            F.count("*").alias("resolved"),
            F.sum(c("is_fraud").cast("long")).alias("confirmed"),
        )
    )


@query(
    "public_fields",
    f"""SELECT txn_id, ts_ms, user_id, merchant_id, merchant_category, device_id, channel,
       {O.hu('amount', 4)} AS amount, city, country, is_online FROM txn""",
    ["amount"],
)
def _(x: Ctx):
    return L.public_fields(x.txns)


@query(
    "result_validation",
    """SELECT txn_id, array_to_string(list_filter([
       CASE WHEN verdict = 'needs_review' THEN 'verdict' END,
       CASE WHEN points * 0.2 > 1 OR points < 0 THEN 'confidence' END,
       CASE WHEN len(texts) > 5 OR len(texts) < 1 THEN 'key_evidence' END],
       lambda v: v IS NOT NULL), ';') AS violations FROM told""",
)
def _(x: Ctx):
    # Verdicts bent in three known ways: a renamed verdict, a confidence from the points, and
    # evidence padded by three entries.
    d = D.decide(I.dossier(x.work()))
    texts = F.transform("evidence", lambda e: e["text"])
    pad = F.when(F.size(texts) > 0, F.concat(texts, F.array(*[F.lit("x")] * 3)))
    bent = d.withColumns(
        {
            "verdict": F.when(c("verdict") == "needs_review", "unsure").otherwise(c("verdict")),
            "confidence": c("points") * 0.2,
            "key_evidence": F.coalesce(pad, F.array().cast("array<string>")),
        }
    )
    return bent.select(
        "txn_id", F.concat_ws(";", V.result_violations()).alias("violations")
    )


# --- scalar features ---


@query(
    "f_amount",
    "SELECT txn_id, amount, ln(1e0 + amount) AS amount_log FROM txn",
    ["amount", "amount_log"],
)
def _(x: Ctx):
    return x.txns.select("txn_id", "amount", F.log1p("amount").alias("amount_log"))


@query(
    "f_haversine",
    """SELECT txn_id, 2 * 6371e0 * asin(sqrt(least(1e0,
         pow(sin(radians(t.lat - u.home_lat) / 2), 2) + cos(radians(u.home_lat))
         * cos(radians(t.lat)) * pow(sin(radians(t.lon - u.home_lon) / 2), 2)))) AS km_from_home
       FROM txn t JOIN users u ON u.user_id = t.user_id""",
    ["km_from_home"],
)
def _(x: Ctx):
    u = x.t.users.select("user_id", "home_lat", "home_lon")
    km = X.haversine_km(c("home_lat"), c("home_lon"), c("lat"), c("lon"))
    return x.txns.join(u, "user_id").select("txn_id", km.alias("km_from_home"))


@query(
    "f_local_time",
    f"""SELECT txn_id, ((ts_ms + 19800000) % {S.DAY_MS}) / 3600000e0 AS hour_local,
       CASE WHEN ((ts_ms + 19800000) % {S.DAY_MS}) / 3600000e0 < 5.5 THEN 1e0 ELSE 0e0 END
         AS is_night,
       CASE WHEN ((ts_ms + 19800000) // {S.DAY_MS} + 3) % 7 >= 5 THEN 1e0 ELSE 0e0 END
         AS is_weekend FROM txn""",
    ["hour_local", "is_night", "is_weekend"],
)
def _(x: Ctx):
    hour = X.hour_local(c("ts_ms"))
    return x.txns.select(
        "txn_id", hour.alias("hour_local"), X.flag(hour < 5.5).alias("is_night"),
        X.flag(X.weekday_local(c("ts_ms")) >= 5).alias("is_weekend"),
    )


def feature_query(name: str, cols: list[str]) -> None:
    @query(name, f"SELECT txn_id, {', '.join(cols)} FROM feats", cols)
    def _(x: Ctx):
        return x.features().select("txn_id", *cols)


feature_query("f_flags", ["is_online", "is_international", "is_home_city"])


@query(
    "f_onehot",
    "SELECT txn_id, "
    + ", ".join(f"{O.FEATURE_SQL[f]} AS {f}" for f in S.FEATURES[-18:])
    + " FROM txn",
    S.FEATURES[-18:],
)
def _(x: Ctx):
    return x.txns.select(
        "txn_id",
        X.flag(c("channel") == "CARD").alias("channel_card"),
        X.flag(c("channel") == "NETBANKING").alias("channel_netbanking"),
        *X.category_onehots(c("merchant_category")),
    )


feature_query("f_ages", ["account_age_days", "merchant_age_days"])


@query(
    "f_category_risk",
    """SELECT txn_id, coalesce(m.category_risk, 0.1::double) AS category_risk
       FROM txn t LEFT JOIN merchants m ON m.merchant_id = t.merchant_id""",
    ["category_risk"],
)
def _(x: Ctx):
    m = x.t.merchants.select("merchant_id", "category_risk")
    risk = F.coalesce(c("category_risk"), F.lit(S.DEFAULT_CATEGORY_RISK))
    return x.txns.join(m, "merchant_id", "left").select(
        "txn_id", risk.alias("category_risk")
    )


@query(
    "iso_and_relative",
    f"""SELECT txn_id, {O.ist('ts_ms')} AS "when",
       {O.hu('(last_ms - ts_ms) / 60000e0', 1)} AS minutes_before FROM txn, bounds""",
    ["minutes_before"],
)
def _(x: Ctx):
    anchor = x.txns.agg(F.max("ts_ms")).scalar()
    return x.txns.select(
        "txn_id", ist_string(c("ts_ms")).alias("when"),
        minutes_before(anchor, c("ts_ms")).alias("minutes_before"),
    )


# --- window features ---

feature_query("w_txn_count", ["txn_count_total"])


@query(
    "w_amount_mean_std",
    "SELECT txn_id, mean_prior, std_prior FROM s1",
    ["mean_prior", "std_prior"],
)
def _(x: Ctx):
    return x.features(["mean_prior", "std_prior"]).select("txn_id", "mean_prior", "std_prior")


feature_query("w_amount_z", ["amount_z"])
feature_query("w_amount_ratio", ["amount_ratio_mean"])
feature_query(
    "w_velocity_1h_24h",
    ["txn_count_1h", "txn_count_24h", "amount_sum_24h", "small_txn_count_1h"],
)
feature_query("w_gap", ["seconds_since_last"])
feature_query("w_distance_speed", ["distance_from_last_km", "speed_kmh"])
feature_query("w_device_novelty", ["is_new_device", "device_user_age_days"])
feature_query("w_new_merchant", ["is_new_merchant"])
feature_query("w_user_device_count", ["user_device_count"])
feature_query("w_device_user_count", ["device_user_count"])
feature_query("w_device_age", ["device_age_days"])


@query(
    "feature_frame",
    "SELECT txn_id, ts_ms, user_id, " + ", ".join(S.FEATURES) + ", is_fraud, fraud_type, context"
    " FROM feats",
    S.FEATURES,
)
def _(x: Ctx):
    return x.features()


@query(
    "episode_gaps",
    """SELECT user_id, count(*) AS gaps, quantile_cont(gap, 0.5) AS median_gap_s FROM
       (SELECT user_id, (ts_ms - lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms, txn_id))
         / 1000e0 AS gap FROM txn) WHERE gap IS NOT NULL GROUP BY user_id""",
    ["median_gap_s"],
)
def _(x: Ctx):
    gaps = (
        x.features(["prev_ms"])
        .where(c("prev_ms").isNotNull())
        .select("user_id", ((c("ts_ms") - c("prev_ms")) / 1000.0).alias("gap"))
    )
    counts = gaps.groupBy("user_id").agg(F.count("*").alias("gaps"))
    median = exact_quantiles(gaps, ["user_id"], "gap", {"median_gap_s": 0.5})
    return counts.join(median, "user_id")


# --- joins and look-ups ---


@query(
    "j_profile_merchant",
    """SELECT t.txn_id, u.home_city, u.account_created_ms, m.created_ms AS merchant_created_ms,
       m.category_risk FROM txn t LEFT JOIN users u ON u.user_id = t.user_id
       LEFT JOIN merchants m ON m.merchant_id = t.merchant_id""",
    ["category_risk"],
)
def _(x: Ctx):
    return with_reference(x.txns, x.t.users, x.t.merchants).select(
        "txn_id", "home_city", "account_created_ms", "merchant_created_ms", "category_risk"
    )


@query(
    "j_user_history",
    """SELECT case_txn_id, txn_id, merchant_id, device_id, amount, city, country, is_online,
       model_score, "when", minutes_before FROM hist""",
    ["amount", "model_score", "minutes_before"],
)
def _(x: Ctx):
    w = x.work()
    return I.history(w, w.anchors()).select(
        "case_txn_id", "txn_id", "merchant_id", "device_id", "amount", "city", "country",
        "is_online", "model_score", "when", "minutes_before",
    )


@query(
    "j_history_summary",
    """SELECT a.txn_id, 336e0 AS window_hours, coalesce(h.history_count, 0) AS history_count,
       h.median_amount, h.max_amount, coalesce(h.distinct_devices, 0) AS distinct_devices,
       coalesce(array_to_string(h.distinct_cities, ','), '') AS distinct_cities,
       coalesce(array_to_string(h.categories, ','), '') AS categories
       FROM anchors a LEFT JOIN hsum h ON h.case_txn_id = a.txn_id""",
    ["window_hours", "median_amount", "max_amount"],
)
def _(x: Ctx):
    w = x.work()
    a = w.anchors()
    return L.history_summary(a, I.history(w, a), L.HISTORY_HOURS).withColumns(
        {n: F.concat_ws(",", n) for n in ("distinct_cities", "categories")}
    )


@query(
    "j_merchant_asof",
    "SELECT * FROM masof",
    ["category_risk_prior", "confirmed_fraud_rate", "merchant_median_amount",
     "merchant_age_days"],
)
def _(x: Ctx):
    w = x.work()
    return I.merchants_asof(w, stage(w.past_anchors(), "anchors"))


@query("j_device_asof", "SELECT * FROM dasof", ["device_age_days"])
def _(x: Ctx):
    w = x.work()
    return I.devices_asof(w, stage(w.past_anchors(), "anchors"))


@query(
    "j_decision_truth",
    "SELECT d.txn_id, d.score, d.flagged, t.is_fraud, t.fraud_type, t.context FROM decisions d"
    " JOIN txn t ON t.txn_id = d.txn_id",
    ["score"],
)
def _(x: Ctx):
    truth = x.txns.select("txn_id", "is_fraud", "fraud_type", "context")
    live = x.features().where(c("ts_ms") >= x.live_start())
    d = SC.batch_score(live, CHAMPION, explain=False)
    return d.select("txn_id", "score", "flagged").join(truth, "txn_id")


@query(
    "j_similar_cases",
    f"""SELECT txn_id, place, case_txn_id, {O.hu('similarity', 4)} AS similarity,
       CASE WHEN is_fraud THEN 'fraud' ELSE 'legit' END AS outcome, fraud_type,
       {O.hu('amount', 4)} AS amount, txn_count_1h, is_new_device > 0 AS is_new_device,
       {O.hu('speed_kmh', 4)} AS speed_kmh FROM near""",
    ["similarity", "amount", "txn_count_1h", "speed_kmh"],
)
def _(x: Ctx):
    w = x.work()
    return I.similar(w, w.anchors()).drop("is_fraud")


NEIGHBOURS_OF_VECTORS = 10


def vectors(x: Ctx) -> tuple[DataFrame, DataFrame]:
    """The vectors asked for, whose id is divisible by 50, and all vectors."""
    rows = x.spark.read.parquet(f"{x.sf_dir}/embeddings.parquet").where("vec_id IS NOT NULL")
    bank = NB.unit_vectors(rows.dropDuplicates(["vec_id"]), "vec_id", "embedding")
    return bank.where("id % 50 = 0"), bank


@query(
    "similar_vectors",
    f"""SELECT vec_id, neighbour, place, round_even(similarity, 9) AS similarity FROM
       (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour)
          AS place FROM
         (SELECT q.vec_id, b.vec_id AS neighbour, round_even(
             list_dot_product(q.embedding::double[], b.embedding::double[])
             / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))
                * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 9)
             AS similarity
          FROM embeddings q JOIN embeddings b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id))
       WHERE place <= {NEIGHBOURS_OF_VECTORS}""",
    ["similarity"],
)
def _(x: Ctx):
    found = NB.exact_neighbours(*vectors(x), NEIGHBOURS_OF_VECTORS, skip_self=True)
    return found.withColumnRenamed("id", "vec_id")


@query("similar_vectors_indexed")
def _(x: Ctx):
    asked, bank = vectors(x)
    index = NB.build_index(bank)
    probes = NB.probes_for(index, NEIGHBOURS_OF_VECTORS)
    found = NB.indexed_neighbours(index, asked, NEIGHBOURS_OF_VECTORS, probes, skip_self=True)
    return found.withColumnRenamed("id", "vec_id")


@query(
    "j_transaction_card",
    f"""SELECT t.txn_id, {O.hu('t.amount', 4)} AS amount, {O.ist('t.ts_ms')} AS "when",
       {O.hu('d.score', 4)} AS score, {O.hu('d.threshold', 4)} AS threshold, d.model_version,
       coalesce(r.top_reasons, '') AS top_reasons FROM txn t
       LEFT JOIN decisions d ON d.txn_id = t.txn_id
       LEFT JOIN (SELECT txn_id, string_agg(feature || ' ' || direction, ',' ORDER BY place)
         AS top_reasons FROM reasons GROUP BY txn_id) r ON r.txn_id = t.txn_id""",
    ["amount", "score", "threshold"],
)
def _(x: Ctx):
    card = L.transaction_card(x.txns, x.work().decisions())
    names = F.transform(
        "top_reasons", lambda r: F.concat_ws(" ", r["feature"], r["effect"])
    )
    return card.select(
        "txn_id", "amount", "when", "score", "threshold", "model_version",
        F.concat_ws(",", names).alias("top_reasons"),
    )


@query(
    "j_user_profile",
    f"""SELECT txn_id, user_id, home_city,
       {O.hu(f'(ts_ms - account_created_ms) / {S.DAY_MS}e0', 1)} AS account_age_days FROM anchors""",
    ["account_age_days"],
)
def _(x: Ctx):
    w = x.work()
    return L.user_profile(w.anchors(), x.t.users)


@query(
    "case_dossier",
    """SELECT txn_id, amount, "when", score, home_city, account_age_days, history_count,
       median_amount, distinct_devices, n1 AS last_hour_count, small AS last_hour_small,
       device_txn_count, dev_users AS device_distinct_users, dev_age AS device_age_days,
       confirmed AS confirmed_fraud_txns, mcat AS merchant_profile_category, resolved_txns,
       rate AS confirmed_fraud_rate, share AS fraud_share, speed AS speed_reason FROM dossier""",
    ["amount", "score", "account_age_days", "median_amount", "device_age_days",
     "confirmed_fraud_rate", "fraud_share", "speed_reason"],
)
def _(x: Ctx):
    d = I.dossier(x.work())
    zero = {n: F.coalesce(n, F.lit(0)) for n in ("last_hour_count", "last_hour_small")}
    return d.withColumns(
        {**zero, "speed_reason": F.coalesce("speed_reason", F.lit(0.0))}
    ).select(
        "txn_id", "amount", "when", "score", "home_city", "account_age_days", "history_count",
        "median_amount", "distinct_devices", "last_hour_count", "last_hour_small",
        "device_txn_count", "device_distinct_users", "device_age_days", "confirmed_fraud_txns",
        "merchant_profile_category", "resolved_txns", "confirmed_fraud_rate", "fraud_share",
        "speed_reason",
    )


# --- metrics ---


def three_models(x: Ctx) -> DataFrame:
    """(model, label, score, ...) over the whole time span, one row per event and model."""
    s = x.scored()
    models = F.array(
        F.struct(F.lit("rules").alias("model"), c("rule_score").alias("score")),
        F.struct(F.lit(CHAMPION.version).alias("model"), c("score").alias("score")),
        F.struct(F.lit(CHALLENGER.version).alias("model"), c("score2").alias("score")),
    )
    rows = s.select("ts_ms", "is_fraud", "fraud_type", "context", F.inline(models))
    bounds = SA.window_bounds(x.txns.select("ts_ms"), 7, 7, 7)
    split = rows.withColumn("label", c("is_fraud").cast("int")).withColumn(
        "split", SA.split_label(c("ts_ms"), bounds.select(F.struct("*")).scalar())
    )
    # Thresholds and metrics read it separately; features behind it are computed once.
    return stage(split, "model-scores")


def part(models: DataFrame, split: str) -> DataFrame:
    return models.where(c("split") == split)


@query("threshold_at_fpr", "SELECT * FROM thr", ["threshold"])
def _(x: Ctx):
    return M.threshold_at_fpr(part(three_models(x), "val"), 0.01, ["model"])


POINT = ["threshold", "recall", "precision", "fpr"]


@query("metrics_at_threshold", "SELECT * FROM point", POINT)
def _(x: Ctx):
    m = three_models(x)
    thr = M.threshold_at_fpr(part(m, "val"), 0.01, ["model"])
    test = part(m, "test").join(F.broadcast(thr), "model")
    return M.metrics_at_threshold(test, c("threshold"), ["model"])


@query("recall_at_fpr", "SELECT * FROM recalls", [*POINT, "target_fpr"])
def _(x: Ctx):
    return M.recall_at_fprs(part(three_models(x), "test"), M.REPORTED_FPRS, ["model"])


@query("roc_auc", "SELECT model, roc_auc FROM aucs", ["roc_auc"])
def _(x: Ctx):
    return M.roc_auc(part(three_models(x), "test"), ["model"])


@query("average_precision", "SELECT model, pr_auc FROM aucs", ["pr_auc"])
def _(x: Ctx):
    return M.average_precision(part(three_models(x), "test"), ["model"])


RECALL3 = ["recall_at_0_5pct", "recall_at_1pct", "recall_at_2pct"]
SUMMARY_SQL = f"""SELECT a.model, a.roc_auc, a.pr_auc, a.n, a.positives,
   a.positives / a.n::double AS base_rate,
   {', '.join(f"max(r.recall) FILTER (WHERE r.target = '{t}') AS {n}"
              for n, t in zip(RECALL3, M.REPORTED_FPRS))},
   any_value(p.threshold) AS threshold, any_value(p.tp) AS tp, any_value(p.fp) AS fp,
   any_value(p.fn) AS fn, any_value(p.tn) AS tn, any_value(p.recall) AS recall,
   any_value(p.precision) AS precision, any_value(p.fpr) AS fpr, any_value(p.alerts) AS alerts,
   any_value(p.alerts) / 7e0 AS alerts_per_day
   FROM aucs a JOIN recalls r ON r.model = a.model JOIN point p ON p.model = a.model
   GROUP BY a.model, a.roc_auc, a.pr_auc, a.n, a.positives"""


def summaries(m: DataFrame) -> DataFrame:
    thr = M.threshold_at_fpr(part(m, "val"), 0.01, ["model"])
    return M.model_summary(part(m, "test"), thr, 7.0, ["model"])


@query(
    "model_summary",
    SUMMARY_SQL,
    ["roc_auc", "pr_auc", "base_rate", *RECALL3, *POINT, "alerts_per_day"],
)
def _(x: Ctx):
    return summaries(three_models(x))


@query(
    "per_type_recall",
    f"""SELECT fraud_type, count(*) AS n, avg((score >= {CHAMPION.threshold})::int::double)
       AS recall FROM decisions WHERE is_fraud GROUP BY fraud_type""",
    ["recall"],
)
def _(x: Ctx):
    m = part(three_models(x), "test").where(c("model") == CHAMPION.version)
    return M.per_type_recall(m, CHAMPION.threshold)


@query(
    "flag_rate_by_context",
    f"""WITH r AS (SELECT context, count(*) AS n, avg((score >= {CHAMPION.threshold})::int::double)
         AS flag_rate FROM decisions WHERE NOT is_fraud GROUP BY context)
       SELECT *, flag_rate / (SELECT flag_rate FROM r WHERE context = 'view')
         AS ratio_to_baseline FROM r""",
    ["flag_rate", "ratio_to_baseline"],
)
def _(x: Ctx):
    m = part(three_models(x), "test").where(c("model") == CHAMPION.version)
    return M.flag_rate_by_context(m, CHAMPION.threshold, "view")


@query(
    "feature_stats",
    """SELECT feature, avg(value) AS mean, CASE WHEN stddev_samp(value) > 0
       THEN stddev_samp(value) ELSE 1e0 END AS std FROM long_train
       WHERE feature <> '__score__' GROUP BY feature""",
    ["mean", "std"],
)
def _(x: Ctx):
    w = I.window_of(x.txns, 7, 7, 7)
    train = x.features().where((c("ts_ms") >= w.train_start) & (c("ts_ms") < w.val_start))
    return M.feature_stats(train, S.FEATURES)


@query(
    "latency_histogram",
    "WITH e AS (SELECT unnest(["
    + ", ".join(f"{{'le': '{b}', 'v': {b}::double}}" for b in M.LATENCY_BUCKETS_MS)
    + """, {'le': '+Inf', 'v': 1e18}]) AS b), t AS (SELECT model_version,
       sum(latency_ms) AS latency_sum, count(*) AS n FROM decisions GROUP BY model_version)
       SELECT d.model_version, b.le AS le, count(*) FILTER (WHERE latency_ms <= b.v)
       AS bucket_count, any_value(t.latency_sum) AS latency_sum, any_value(t.n) AS n
       FROM decisions d JOIN t ON t.model_version = d.model_version, e
       GROUP BY d.model_version, b.le""",
    ["latency_sum"],
)
def _(x: Ctx):
    d = SC.batch_score(
        x.features().where(c("ts_ms") >= x.live_start()), CHAMPION, explain=False
    )
    return M.latency_histogram(d.withColumn("latency_ms", latency()), ["model_version"])


@query(
    "stream_metrics",
    f"""SELECT model_version, ts_ms - ts_ms % {S.DAY_MS} AS bucket_ms, count(*) AS scored,
       count(*) FILTER (WHERE flagged) AS flagged, avg(latency_ms) AS avg_latency_ms,
       max(latency_ms) AS max_latency_ms FROM decisions GROUP BY 1, 2""",
    ["avg_latency_ms", "max_latency_ms"],
)
def _(x: Ctx):
    d = SC.batch_score(
        x.features().where(c("ts_ms") >= x.live_start()), CHAMPION, explain=False
    )
    return E.stream_metrics(d.withColumn("latency_ms", latency()), S.DAY_MS)


@query(
    "dataset_meta",
    """SELECT t.*, f.fraud_type, f.n FROM (SELECT count(*) AS transactions,
       count(DISTINCT user_id) AS users, count(DISTINCT merchant_id) AS merchants,
       count(*) FILTER (WHERE is_fraud) AS fraud_transactions,
       avg(is_fraud::int::double) AS fraud_rate FROM txn) t,
       (SELECT fraud_type, count(*) AS n FROM txn WHERE is_fraud GROUP BY fraud_type) f""",
    ["fraud_rate"],
)
def _(x: Ctx):
    total = E.dataset_meta(x.txns).withColumn("_k", F.lit(1))
    kinds = E.fraud_by_type(x.txns).withColumn("_k", F.lit(1))
    return kinds.join(F.broadcast(total), "_k").drop("_k")


# --- drift ---


def reference_and_live(x: Ctx) -> tuple[DataFrame, DataFrame]:
    """Bins of the training window and of validation scores; the test window as live rows."""
    w = x.work()
    scored = F.col("ts_ms") >= w.window.val_start
    rows = w.rows.withColumn(P.SCORE, F.when(scored, CHAMPION.score()))
    f = P.build_reference(
        rows.where(
            (c("ts_ms") >= w.window.train_start) & (c("ts_ms") < w.window.val_start)
        ),
        S.FEATURES,
    )
    s = P.build_reference(
        rows.where(
            (c("ts_ms") >= w.window.val_start) & (c("ts_ms") < w.window.test_start)
        ),
        [P.SCORE],
    )
    return f.unionByName(s), rows.where(c("ts_ms") >= w.window.test_start)


WITH_SCORE = [*S.FEATURES, P.SCORE]


@query(
    "psi_reference",
    "SELECT feature, bin, lo, hi, prob FROM ref",
    ["lo", "hi", "prob"],
)
def _(x: Ctx):
    return reference_and_live(x)[0]


@query("psi_feature", "SELECT feature, psi FROM psi WHERE feature = 'amount'", ["psi"])
def _(x: Ctx):
    ref, live = reference_and_live(x)
    return P.psi_report(ref, live, ["amount"])


@query("psi_report", "SELECT feature, psi FROM psi", ["psi"])
def _(x: Ctx):
    ref, live = reference_and_live(x)
    return P.psi_report(ref, live, WITH_SCORE)


@query("psi_class", "SELECT feature, psi, status FROM psic", ["psi"])
def _(x: Ctx):
    ref, live = reference_and_live(x)
    return P.psi_report(ref, live, WITH_SCORE).withColumn("status", P.psi_class(c("psi")))


@query(
    "drift_report",
    """SELECT r.rows, max_psi, max_feature, shifted_features,
       CASE WHEN max_psi < 0.1 THEN 'stable' WHEN max_psi < 0.2 THEN 'watch' ELSE 'shifted' END
         AS status, max_psi >= 0.2 AS drift_detected
       FROM (SELECT count(*) AS rows FROM decisions) r,
       (SELECT max(psi) AS max_psi, arg_max(feature, {'p': floor(psi * 1e9), 'o':
            -list_position(""" + O.name_list(P.ORDER) + """, feature)}) AS max_feature,
          coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (WHERE psi >= 0.2), '')
            AS shifted_features FROM psi) w""",
    ["max_psi"],
)
def _(x: Ctx):
    ref, live = reference_and_live(x)
    report = P.drift_report(P.psi_report(ref, live, WITH_SCORE), live)
    return report.withColumn("shifted_features", F.concat_ws(",", "shifted_features"))


@query(
    "live_flag_rate",
    "SELECT avg(flagged::int::double) AS flag_rate FROM decisions",
    ["flag_rate"],
)
def _(x: Ctx):
    f = x.features()
    live = f.where(c("ts_ms") >= x.live_start()).withColumn("score", CHAMPION.score())
    return P.live_flag_rate(live, CHAMPION.threshold)


# --- sort, top-k, samples ---


@query(
    "order_and_id",
    "SELECT txn_id, ts_ms, row_number() OVER (ORDER BY ts_ms, txn_id) AS seq FROM txn",
)
def _(x: Ctx):
    return sequential_ids(x.txns.select("txn_id", "ts_ms"), ["ts_ms", "txn_id"], "seq")


REASON_SQL = "SELECT txn_id, place, feature, value, contribution, direction FROM reasons"


@query("topk_reasons", REASON_SQL, ["value", "contribution"])
def _(x: Ctx):
    live = x.features().where(c("ts_ms") >= x.live_start())
    scored = live.withColumn("score", CHAMPION.score())
    top = SC.top_reasons(CHAMPION.contributions(), 3)
    return (
        scored.where(c("score") >= CHAMPION.threshold)
        .select("txn_id", F.posexplode(top).alias("place", "r"))
        .select("txn_id", (c("place") + 1).alias("place"), "r.*")
    )


@query(
    "rank_importance",
    f"""SELECT r.feature AS feature, avg(abs(r.contribution)) AS mean_abs_contribution FROM
       (SELECT unnest({O.contribution_list(CHAMPION)}) AS r FROM test) GROUP BY r.feature""",
    ["mean_abs_contribution"],
)
def _(x: Ctx):
    return SC.rank_importance(x.features().where(c("ts_ms") >= x.live_start()), CHAMPION)


@query("stratified_round_robin", CASE_SQL, ["score", "amount"])
def _(x: Ctx):
    return SA.build_cases(flagged_truth(x.work()), 100)


@query(
    "case_bank",
    "SELECT txn_id, ts_ms, user_id, is_fraud, fraud_type, amount, amount_z, speed_kmh FROM bank",
    ["amount", "amount_z", "speed_kmh"],
)
def _(x: Ctx):
    return x.work().bank().select(
        "txn_id", "ts_ms", "user_id", "is_fraud", "fraud_type", "amount", "amount_z", "speed_kmh"
    )


@query(
    "sample_rows",
    "SELECT txn_id, amount FROM (SELECT txn_id, amount, row_number() OVER"
    " (ORDER BY md5(concat(txn_id, ':0')), txn_id) AS rn FROM txn) WHERE rn <= 500",
    ["amount"],
)
def _(x: Ctx):
    return SA.sample_rows(x.txns, 500).select("txn_id", "amount")


@query(
    "union_pools",
    "SELECT txn_id, amount, is_fraud, 'train' AS pool FROM train UNION ALL"
    " SELECT txn_id, amount, is_fraud, 'val' FROM val",
    ["amount"],
)
def _(x: Ctx):
    s = SA.time_split(x.txns, 7, 7, 7)
    pools = [
        s.where(c("split") == p).select("txn_id", "amount", "is_fraud", F.lit(p).alias("pool"))
        for p in ("train", "val")
    ]
    return SA.union_pools(pools)


def promotions(x: Ctx) -> DataFrame:
    """A promotion every third day with events: one row per day at most."""
    day = F.floor(c("ts_ms") / S.DAY_MS)
    return (
        x.txns.select(day.alias("day")).distinct().where(c("day") % 3 == 0).select(
            F.concat(F.lit("v"), F.lpad(c("day").cast("string"), 6, "0")).alias("version"),
            (c("day") * S.DAY_MS + 6 * S.HOUR_MS).alias("promoted_ms"),
        )
    )


@query(
    "promotion_history",
    """SELECT version, promoted_ms, lag(version) OVER (ORDER BY promoted_ms, version) AS previous,
       row_number() OVER (ORDER BY promoted_ms DESC, version DESC) AS age_rank FROM promos
       QUALIFY age_rank <= 50""",
)
def _(x: Ctx):
    return SC.promotion_history(promotions(x))


# --- scores and models ---


@query("rule_score", "SELECT txn_id, rule_score FROM ruled", ["rule_score"])
def _(x: Ctx):
    return x.features().select("txn_id", SC.rule_score().alias("rule_score"))


@query("linear_score", "SELECT txn_id, score, score2 FROM scored", ["score", "score2"])
def _(x: Ctx):
    return x.scored().select("txn_id", "score", "score2")


@query(
    "batch_score",
    "SELECT txn_id, ts_ms, user_id, score, flagged, threshold, model_version FROM decisions",
    ["score", "threshold"],
)
def _(x: Ctx):
    live = x.features().where(c("ts_ms") >= x.live_start())
    return SC.batch_score(live, CHAMPION, explain=False).drop("reasons")


@query("reason_codes", REASON_SQL, ["value", "contribution"])
def _(x: Ctx):
    live = x.features().where(c("ts_ms") >= x.live_start())
    return SC.reason_codes(SC.batch_score(live, CHAMPION))


@query(
    "challenger_decision",
    """WITH m AS (SELECT a.model, a.pr_auc, r.recall FROM aucs a JOIN recalls r
         ON r.model = a.model AND r.target = '1.000%'),
       pairs AS (SELECT o.model || '>' || n.model AS pair, o.recall AS r0, n.recall AS r1,
         o.pr_auc AS p0, n.pr_auc AS p1 FROM m o JOIN m n ON n.model <> o.model
         UNION ALL SELECT '>' || model, NULL, recall, NULL, pr_auc FROM m)
       SELECT pair, r0 IS NULL OR (r1 - r0 >= 0.01 AND p1 >= p0 - 0.005) AS promote,
       CASE WHEN r0 IS NULL THEN 'no champion yet'
         WHEN r1 - r0 < 0.01 THEN printf('recall@1%%FPR gain %+.3f below required +0.010', r1 - r0)
         WHEN p1 < p0 - 0.005 THEN printf('PR-AUC regressed %.3f < %.3f', p1, p0)
         ELSE printf('recall@1%%FPR %.3f -> %.3f (+%.3f), PR-AUC %.3f', r0, r1, r1 - r0, p1) END
         AS reason FROM pairs""",
)
def _(x: Ctx):
    m = summaries(three_models(x)).select("model", "recall_at_1pct", "pr_auc")
    old = m.select(c("model").alias("old"), "recall_at_1pct", "pr_auc")
    new = m.select(c("model").alias("new"), "recall_at_1pct", "pr_auc")
    names = ["rules", CHAMPION.version, CHALLENGER.version]
    pairs = F.array(
        *[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new"))
          for o in ["", *names] for n in names if o != n]
    )
    listed = x.spark.range(1).select(F.inline(pairs)).withColumn(
        "pair", F.concat_ws(">", "old", "new")
    )
    champion = listed.join(old, "old").select("pair", "recall_at_1pct", "pr_auc")
    challenger = listed.join(new, "new").select("pair", "recall_at_1pct", "pr_auc")
    return SC.challenger_decision(champion, challenger)


@query(
    "champion_asof",
    """SELECT t.txn_id, t.ts_ms, coalesce(p.version, 'none') AS version,
       coalesce(p.promoted_ms, -1) AS promoted_ms FROM txn t
       ASOF LEFT JOIN promos p ON t.ts_ms >= p.promoted_ms""",
)
def _(x: Ctx):
    found = SC.champion_asof(x.txns.select("txn_id", "ts_ms"), promotions(x))
    return found.na.fill({"version": "none", "promoted_ms": -1})


@query(
    "label_feedback",
    f"""SELECT txn_id, score, is_fraud, fraud_type FROM decisions, bounds
       WHERE ts_ms + (num % 14) * {S.DAY_MS} < last_ms""",
    ["score"],
)
def _(x: Ctx):
    live = x.features().where(c("ts_ms") >= x.live_start())
    log = live.select("txn_id", CHAMPION.score().alias("score"))
    feed = x.txns.select(
        "txn_id", "is_fraud", "fraud_type",
        (c("ts_ms") + (number() % 14) * S.DAY_MS).alias("arrived_ms"),
    )
    cutoff = x.txns.agg(F.max("ts_ms")).scalar()
    return SC.label_feedback(log, feed, cutoff).select(
        "txn_id", "score", "is_fraud", "fraud_type"
    )


# --- decisions on the dossier ---


@query(
    "evidence_points",
    "SELECT txn_id, points, len(texts) AS items FROM pointed",
    ["points"],
)
def _(x: Ctx):
    d = I.dossier(x.work()).withColumn("evidence", D.evidence_items())
    return d.select(
        "txn_id", D.total_points(c("evidence")).alias("points"),
        F.size("evidence").alias("items"),
    )


@query("verdict", "SELECT txn_id, verdict, confidence FROM verdicts", ["confidence"])
def _(x: Ctx):
    return D.decide(I.dossier(x.work())).select("txn_id", "verdict", "confidence")


@query("pattern_guess", "SELECT txn_id, verdict, fraud_type FROM typed")
def _(x: Ctx):
    return D.decide(I.dossier(x.work())).select("txn_id", "verdict", "fraud_type")


@query("recommended_action", "SELECT txn_id, recommended_action FROM typed")
def _(x: Ctx):
    return D.decide(I.dossier(x.work())).select("txn_id", "recommended_action")


@query("evidence_text", "SELECT txn_id, key_evidence, analyst_summary FROM told")
def _(x: Ctx):
    return D.decide(I.dossier(x.work())).select(
        "txn_id", joined("key_evidence").alias("key_evidence"), "analyst_summary"
    )


LABELS_SQL = "CASE recommended_action " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in S.ACTION_LABELS.items()
) + " END"


@query(
    "case_report",
    f"""SELECT case_id, '# Investigation ' || case_id || ' - transaction ' || txn_id || chr(10)
       || chr(10) || '**Verdict:** ' || upper(verdict) || '  ·  **Confidence:** '
       || {O.pct('confidence')} || '  ·  **Pattern:** ' || fraud_type || '  ·  **Action:** '
       || {LABELS_SQL} || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
       || analyst_summary || chr(10) || chr(10) || '## Key evidence' || chr(10) || chr(10)
       || '- ' || replace(key_evidence, ' | ', chr(10) || '- ') || chr(10) AS report_md
       FROM told""",
)
def _(x: Ctx):
    return I.cases(x.work()).select("case_id", "report_md")


@query(
    "fail_safe_result",
    """SELECT a.txn_id, coalesce(t.verdict, 'needs_review') AS verdict,
       coalesce(t.confidence, 0e0) AS confidence, coalesce(t.fraud_type, 'none') AS fraud_type,
       coalesce(t.recommended_action, 'step_up_authentication') AS recommended_action,
       CASE WHEN t.txn_id IS NULL THEN 'incomplete' ELSE 'submit_verdict' END AS terminated_by
       FROM anchors a LEFT JOIN (SELECT * FROM typed WHERE history_count >= 50) t
       ON t.txn_id = a.txn_id""",
    ["confidence"],
)
def _(x: Ctx):
    # Investigations that found a short history count as cut short.
    w = x.work()
    done = D.decide(I.dossier(w)).where(c("history_count") >= 50)
    return D.fail_safe(w.anchors().select("txn_id"), done).select(
        "txn_id", "verdict", "confidence", "fraud_type", "recommended_action", "terminated_by"
    )


# --- evaluation of verdicts ---


def token_counts() -> tuple[Column, Column]:
    return (number() * 13) % 5000, (number() * 7) % 900


def eval_rows(x: Ctx) -> DataFrame:
    """Both backends on the balanced case set. Run counters are derived from the event."""
    w = x.work()
    d = D.decide(I.dossier(w))
    high, low = c("score") >= 0.6, c("score") < 0.35
    backends = F.array(
        F.struct(
            F.lit("points").alias("backend"), c("verdict").alias("verdict"),
            c("confidence").alias("confidence"), c("fraud_type").alias("predicted_type"),
        ),
        F.struct(
            F.lit("score_only").alias("backend"),
            F.when(high, "fraud").when(low, "legit").otherwise("needs_review").alias("verdict"),
            F.when(high, 0.9).when(low, 0.7).otherwise(0.5).alias("confidence"),
            F.when(high, "account_takeover").otherwise("none").alias("predicted_type"),
        ),
    )
    tin, tout = token_counts()
    runs = d.select("txn_id", F.inline(backends)).withColumns(
        {
            "tool_calls": F.lit(7),
            "latency_ms": latency(),
            "tokens": tin + tout,
            "cost_usd": E.case_cost(tin, tout),
            "terminated_by": F.when(number() % 17 == 0, "max_steps").otherwise(
                "submit_verdict"
            ),
        }
    )
    return E.eval_case_rows(SA.build_cases(flagged_truth(w), 100), runs)


EROW = [
    "txn_id", "backend", "stratum", "truth", "verdict", "confidence", "decided", "correct",
    "false_block", "missed_fraud", "type_match", "tool_calls", "latency_ms", "tokens", "cost_usd",
    "terminated_by",
]


@query(
    "eval_case_rows",
    "SELECT * REPLACE (tool_calls::bigint AS tool_calls, coalesce(correct::varchar, 'undecided')"
    " AS correct) FROM erows",
    ["confidence", "latency_ms", "cost_usd"],
)
def _(x: Ctx):
    rows = eval_rows(x).select(*EROW)
    return rows.withColumn(
        "correct", F.coalesce(c("correct").cast("string"), F.lit("undecided"))
    )


ESUM = [
    "coverage", "decided_accuracy", "fraud_recall", "fraud_precision", "fraud_type_accuracy",
    "avg_tool_calls", "avg_tokens", "avg_cost_usd", "monthly_cost_usd_at_100_alerts_per_day",
    "p50_latency_ms", "p95_latency_ms",
]


@query("eval_summary", "SELECT * FROM esum", ESUM)
def _(x: Ctx):
    return E.eval_summary(eval_rows(x), ["backend"])


@query(
    "eval_by_stratum",
    """SELECT backend, stratum, count(*) AS n, avg(decided::int) AS coverage,
       avg(correct::int) FILTER (WHERE decided) AS decided_accuracy FROM erows GROUP BY 1, 2""",
    ["coverage", "decided_accuracy"],
)
def _(x: Ctx):
    return E.eval_by_stratum(eval_rows(x), ["backend"])


@query(
    "eval_confusion",
    "SELECT truth, verdict, count(*) AS n FROM erows WHERE backend = 'points' GROUP BY 1, 2",
)
def _(x: Ctx):
    return E.eval_confusion(eval_rows(x).where(c("backend") == "points"))


@query(
    "eval_compare",
    "SELECT metric, max(v) FILTER (WHERE backend = 'points') AS points,"
    " max(v) FILTER (WHERE backend = 'score_only') AS score_only FROM (SELECT backend,"
    " r.metric AS metric, r.v AS v FROM (SELECT backend, unnest(["
    + ", ".join(f"{{'metric': '{m}', 'v': {m}::double}}" for m in E.COMPARE_METRICS)
    + "]) AS r FROM esum)) GROUP BY metric",
    ["points", "score_only"],
)
def _(x: Ctx):
    return E.eval_compare(
        E.eval_summary(eval_rows(x), ["backend"]), ["points", "score_only"]
    )


@query(
    "latency_percentiles",
    "SELECT quantile_cont(latency_ms, 0.5) AS p50_latency_ms, quantile_cont(latency_ms, 0.95)"
    " AS p95_latency_ms FROM scored",
    ["p50_latency_ms", "p95_latency_ms"],
)
def _(x: Ctx):
    return E.latency_percentiles(x.txns.select(latency().alias("latency_ms")))


@query(
    "case_cost",
    """SELECT num % 10 AS bucket, count(*) AS n,
       avg(((num * 13) % 5000 * 1e0 + (num * 7) % 900 * 5e0) / 1000000e0) AS avg_cost_usd
       FROM txn GROUP BY 1""",
    ["avg_cost_usd"],
)
def _(x: Ctx):
    return x.txns.groupBy((number() % 10).alias("bucket")).agg(
        F.count("*").alias("n"), F.avg(E.case_cost(*token_counts())).alias("avg_cost_usd")
    )
