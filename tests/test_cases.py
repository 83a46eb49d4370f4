"""Look-ups, verdicts, case sets and evaluation."""

import numpy as np
import pytest
from conftest import DAY, T0
from pyspark.sql import functions as F

from fraudspark.functions.text import fixed, grouped, ist_string, percent
from fraudspark.operators import decide as D
from fraudspark.operators import evals as E
from fraudspark.operators import lookups as L
from fraudspark.operators import sampling as SA
from fraudspark.operators import scoring as SC
from fraudspark.operators import validate as V
from fraudspark.plans import investigation as I
from fraudspark.plans.models import CHAMPION
from fraudspark.schemas import FEATURES
from fraudspark.sources import adapter


@pytest.fixture(scope="module")
def work(spark, sf_dir):
    return I.prepare(adapter.load(spark, sf_dir), CHAMPION)


@pytest.fixture(scope="module")
def all_rows(work):
    return work.rows.toPandas().sort_values(["ts_ms", "txn_id"], ignore_index=True)


@pytest.fixture(scope="module")
def anchors(work):
    return work.anchors().toPandas()


@pytest.mark.parametrize("hours,limit", [(336, 60), (72, 25), (1, 3)])
def test_history_looks_back_only(work, all_rows, anchors, hours, limit):
    got = L.user_history(work.anchors(), work.history_rows(), hours, limit).toPandas()
    for a in anchors.itertuples():
        past = all_rows[
            (all_rows.user_id == a.user_id)
            & (all_rows.ts_ms < a.ts_ms)
            & (all_rows.ts_ms >= a.ts_ms - hours * 3_600_000)
        ].tail(limit)
        mine = got[got.case_txn_id == a.txn_id].sort_values(["ts_ms", "txn_id"])
        assert mine.txn_id.tolist() == past.txn_id.tolist()
        scored = past.ts_ms >= work.window.test_start
        assert mine.model_score.notna().tolist() == scored.tolist()


def test_look_up_limits(work):
    for bad in ((0.5, 10), (1441, 10), (72, 0), (72, 101)):
        with pytest.raises(ValueError):
            L.user_history(work.anchors(), work.history_rows(), *bad)
    with pytest.raises(ValueError):
        I.similar(work, work.anchors(), 21)


def test_history_summary_upper_median(work, anchors):
    h = I.history(work, work.anchors())
    got = L.history_summary(work.anchors(), h, 336).toPandas().set_index("txn_id")
    assert len(got) == len(anchors)
    rows = h.toPandas()
    for case, g in rows.groupby("case_txn_id"):
        amounts = sorted(g.amount)
        assert got.at[case, "median_amount"] == pytest.approx(
            amounts[len(amounts) // 2], abs=0.006
        )
        assert list(got.at[case, "categories"]) == sorted(set(g.merchant_category))


def test_device_and_merchant_as_of(work, all_rows):
    cut = work.window.test_start
    dev = I.devices_asof(work, work.past_anchors()).toPandas().set_index("txn_id")
    mer = I.merchants_asof(work, work.past_anchors()).toPandas().set_index("txn_id")
    anchors = work.past_anchors().toPandas()
    assert (anchors.ts_ms < cut).any() and (anchors.ts_ms >= cut).any()
    for a in anchors.itertuples():
        g = all_rows[(all_rows.device_id == a.device_id) & (all_rows.ts_ms < a.ts_ms)]
        d = dev.loc[a.txn_id]
        assert d.device_txn_count == len(g) and d.device_distinct_users == g.user_id.nunique()
        assert d.confirmed_fraud_txns == g[g.ts_ms < min(cut, a.ts_ms)].is_fraud.sum()
        m = mer.loc[a.txn_id]
        r = all_rows[(all_rows.merchant_id == a.merchant_id) & (all_rows.ts_ms < min(cut, a.ts_ms))]
        if m.category_risk_prior == m.category_risk_prior and len(r):
            assert m.resolved_txns == len(r)
            assert m.merchant_median_amount == pytest.approx(r.amount.median(), abs=1e-4)


def test_similar_cases(work, all_rows, anchors):
    stats = work.stats()
    bank = work.bank().toPandas()
    mu = np.array([stats[f][0] for f in FEATURES])
    sd = np.array([stats[f][1] for f in FEATURES])

    def unit(x):
        z = (x - mu) / sd
        return z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)

    sims = unit(anchors[FEATURES].to_numpy()) @ unit(bank[FEATURES].to_numpy()).T
    got = I.similar(work, work.anchors(), 5).toPandas()
    assert (got.groupby("txn_id").size() == 5).all()
    assert bank.ts_ms.max() < work.window.test_start
    for i, a in enumerate(anchors.itertuples()):
        mine = got[got.txn_id == a.txn_id].sort_values("place").similarity
        assert mine.tolist() == pytest.approx(sorted(sims[i], reverse=True)[:5], abs=1e-4)


BLANK = {
    "txn_id": "T1", "amount": 100.0, "score": 0.2, "threshold": 0.3, "device_id": "D1",
    "city": "Pune", "country": "IN", "when": "2024-11-04 12:00 IST", "home_city": "Pune",
    "median_amount": 100.0, "last_hour_count": 0, "last_hour_small": 0, "night_count": 0,
    "travel_minutes": None, "recent_electronics": 0, "same_device_count": 3,
    "same_merchant_count": 0, "device_distinct_users": 1, "device_age_days": 5.0,
    "confirmed_fraud_txns": 0, "merchant_profile_category": "grocery",
    "category_risk_prior": 0.02, "confirmed_fraud_rate": 0.01, "fraud_share": 0.4,
    "speed_reason": None,
}
SCHEMA = (
    "txn_id string, amount double, score double, threshold double, device_id string, "
    "city string, country string, when string, home_city string, median_amount double, "
    "last_hour_count long, last_hour_small long, night_count long, travel_minutes double, "
    "recent_electronics long, same_device_count long, same_merchant_count long, "
    "device_distinct_users long, device_age_days double, confirmed_fraud_txns long, "
    "merchant_profile_category string, category_risk_prior double, "
    "confirmed_fraud_rate double, fraud_share double, speed_reason double"
)
SIGNALS = [
    ({}, 0.0),
    ({"score": 0.6}, 2.0),
    ({"score": 0.3}, 1.0),
    ({"same_device_count": 0, "device_distinct_users": 2}, 2.5),
    ({"same_device_count": 0}, 1.0),
    ({"confirmed_fraud_txns": 1}, 2.0),
    ({"last_hour_count": 4}, 1.5),
    ({"last_hour_count": 3, "last_hour_small": 3}, 1.5),
    ({"amount": 301.0}, 1.0),
    ({"amount": 300.0}, 0.0),
    ({"speed_reason": 501.0}, 2.0),
    ({"country": "AE"}, 1.5),
    ({"category_risk_prior": 0.2}, 1.0),
    ({"confirmed_fraud_rate": 0.06}, 1.0),
    ({"fraud_share": 0.6}, 1.0),
    ({"when": "2024-11-04 23:10 IST"}, 0.5),
    ({"when": "2024-11-04 04:10 IST", "night_count": 1}, 0.0),
    ({"travel_minutes": 1440.0, "city": "Goa"}, -2.5),
    ({"travel_minutes": 1440.0, "city": "Dubai", "country": "AE"}, 1.5),
    ({"same_device_count": 0, "recent_electronics": 1}, -1.0),
    ({"device_age_days": 31.0}, -1.0),
    ({"same_merchant_count": 1}, -1.0),
    ({"fraud_share": 0.2}, -1.0),
    ({"fraud_share": None, "median_amount": None, "home_city": None}, 0.0),
]


def decide_rows(spark, rows):
    names = [f.strip().split()[0] for f in SCHEMA.split(",")]
    data = [tuple({**BLANK, **r, "txn_id": f"T{i:03d}"}[n] for n in names)
            for i, r in enumerate(rows)]
    return D.decide(spark.createDataFrame(data, SCHEMA)).orderBy("txn_id").collect()


def test_points(spark):
    got = decide_rows(spark, [s for s, _ in SIGNALS])
    assert [r.points for r in got] == [p for _, p in SIGNALS]
    assert got[0].verdict == "legit" and got[0].confidence == 0.65
    assert list(got[0].key_evidence) == ["model score 0.20"]


def test_verdicts_patterns_and_actions(spark):
    rows = [
        {"score": 0.7, "last_hour_small": 3, "last_hour_count": 4},
        {"score": 0.7, "country": "AE"},
        {"score": 0.7, "same_device_count": 0, "device_distinct_users": 3},
        {"score": 0.7, "confirmed_fraud_txns": 1},
        {"score": 0.7},
        {"score": 0.9, "same_device_count": 0, "amount": 90.0, "fraud_share": 0.9},
    ]
    got = decide_rows(spark, rows)
    assert [r.verdict for r in got] == [
        "fraud", "fraud", "fraud", "fraud", "needs_review", "fraud"
    ]
    assert [r.fraud_type for r in got] == [
        "card_testing", "geo_jump", "account_takeover", "none", "none", "low_and_slow"
    ]
    assert [r.confidence for r in got] == [0.95, 0.84, 0.92, 0.88, 0.5, 0.88]
    assert {r.recommended_action for r in got if r.verdict == "fraud"} == {
        "block_card_and_contact_customer"
    }
    assert got[4].recommended_action == "step_up_authentication"
    assert "Evidence points: +5.0" in got[0].analyst_summary
    results = spark.createDataFrame(
        [tuple(r[c] for c in D.RESULT_COLUMNS) for r in got],
        "verdict string, confidence double, fraud_type string, key_evidence array<string>, "
        "recommended_action string, analyst_summary string",
    )
    checked = results.withColumn("bad", V.result_violations())
    assert checked.where(F.size("bad") > 0).count() == 0


def test_result_violations(spark):
    row = ("maybe", 1.5, "none", [], "approve", "short")
    df = spark.createDataFrame(
        [row],
        "verdict string, confidence double, fraud_type string, key_evidence array<string>, "
        "recommended_action string, analyst_summary string",
    )
    bad = df.select(V.result_violations()).first()[0]
    assert set(bad) == {"verdict", "confidence", "key_evidence", "analyst_summary"}


def test_every_flagged_event_gets_a_case(work, anchors):
    cases = I.cases(work)
    got = cases.toPandas()
    assert sorted(got.txn_id) == sorted(anchors.txn_id)
    assert got.report_md.str.contains("## Key evidence").all()
    half = cases.limit(len(anchors) // 2)
    safe = D.fail_safe(work.anchors().select("txn_id"), half).toPandas()
    cut = safe[safe.terminated_by == "incomplete"]
    assert len(safe) == len(anchors) and len(cut) == len(anchors) - len(anchors) // 2
    assert set(cut.verdict) == {"needs_review"} and (cut.confidence == 0).all()


def test_text_helpers(spark):
    df = spark.createDataFrame([(1234567.4, 0.345, T0)], "a double, b double, t long")
    r = df.select(
        grouped(F.col("a")), fixed(F.col("b"), 2), percent(F.col("b")), ist_string(F.col("t"))
    ).first()
    assert tuple(r) == ("1,234,567", "0.35", "35%", "2024-11-04 05:30 IST")


def test_case_set(spark):
    rows = [(f"T{i}", i % 2 == 0, ["a", "b", "c"][i % 3 if i % 7 else 0],
             ["x", "y"][i % 5 > 0], 0.5, 1.0) for i in range(200)]
    df = spark.createDataFrame(
        rows, "txn_id string, is_fraud boolean, fraud_type string, context string, "
        "score double, amount double"
    )
    cases = SA.build_cases(df, 16, 1).toPandas()
    assert len(cases) == 16 and cases.txn_id.is_unique and cases.is_fraud.sum() == 8
    per = cases.groupby("stratum").size()
    assert per.max() - per.min() <= 2 and len(per) == 5
    again = SA.build_cases(df, 16, 1).toPandas()
    assert sorted(again.txn_id) == sorted(cases.txn_id)


def test_promotion_rules(spark):
    def frame(rows):
        return spark.createDataFrame(rows, "pair string, recall_at_1pct double, pr_auc double")

    old = frame([("b", 0.8, 0.7), ("c", 0.8, 0.7), ("d", 0.8, 0.7)])
    new = frame([("a", 0.8, 0.7), ("b", 0.805, 0.71), ("c", 0.85, 0.60), ("d", 0.85, 0.72)])
    got = {r.pair: r for r in SC.challenger_decision(old, new).collect()}
    assert [got[k].promote for k in "abcd"] == [True, False, False, True]
    assert "0.800 -> 0.850" in got["d"].reason and "+0.005" in got["b"].reason


def test_champion_as_of(spark):
    promos = spark.createDataFrame(
        [("v1", T0), ("v2", T0 + 3 * DAY + 5)], "version string, promoted_ms long"
    )
    times = [T0 - 1, T0, T0 + 3 * DAY + 4, T0 + 3 * DAY + 5, T0 + 9 * DAY]
    events = spark.createDataFrame(
        [(f"T{i}", t) for i, t in enumerate(times)], "txn_id string, ts_ms long"
    )
    got = SC.champion_asof(events, promos).orderBy("txn_id").collect()
    assert [r.version for r in got] == [None, "v1", "v1", "v2", "v2"]
    hist = SC.promotion_history(promos).orderBy("age_rank").collect()
    assert [(r.version, r.previous) for r in hist] == [("v2", "v1"), ("v1", None)]


def test_eval_numbers(spark):
    cases = spark.createDataFrame(
        [("a", True, "geo_jump", "s1"), ("b", False, "none", "s2"), ("c", True, "none", "s1")],
        "txn_id string, is_fraud boolean, fraud_type string, stratum string",
    )
    runs = spark.createDataFrame(
        [("a", "fraud", 0.9, "geo_jump"), ("b", "fraud", 0.85, "none"),
         ("c", "needs_review", 0.5, "none")],
        "txn_id string, verdict string, confidence double, predicted_type string",
    ).withColumns(
        {"tool_calls": F.lit(7), "latency_ms": F.lit(40.0), "tokens": F.lit(0),
         "cost_usd": F.lit(0.0), "terminated_by": F.lit("submit_verdict")}
    )
    s = E.eval_summary(E.eval_case_rows(cases, runs)).first()
    assert s.n == 3 and s.coverage == pytest.approx(2 / 3) and s.decided_accuracy == 0.5
    assert s.fraud_recall == 0.5 and s.fraud_precision == 0.5 and s.false_blocks == 1
    assert s.missed_fraud == 0 and s.fraud_type_accuracy == 1.0 and s.p50_latency_ms == 40


def test_top_reasons_order(spark):
    df = spark.createDataFrame(
        [([("a", 1.0, 0.5), ("b", 2.0, -0.9), ("c", 3.0, 0.5), ("d", 0.0, 0.1)],)],
        "r array<struct<feature:string,value:double,contribution:double>>",
    )
    got = df.select(SC.top_reasons(F.col("r"), 3).alias("t")).first().t
    assert [(x.feature, x.direction) for x in got] == [
        ("b", "lowers"), ("a", "raises"), ("c", "raises")
    ]
