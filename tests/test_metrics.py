import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fraudspark.operators import drift as P
from fraudspark.operators import metrics as M
from fraudspark.operators.ranks import exact_quantiles, ranged, running_sums, sequential_ids


@pytest.fixture(scope="module")
def data(spark):
    """One model with distinct scores, one with seven."""
    rng = np.random.default_rng(20)
    label = (np.arange(2490) % 83 < 3).astype(int)
    score = rng.triangular(0, np.where(label == 1, 0.85, 0.15), 1)
    pdf = pd.concat(
        pd.DataFrame({"model": model, "label": label, "score": s})
        for model, s in (("distinct", score), ("steps", np.floor(score * 7) / 7))
    )
    return pdf, spark.createDataFrame(pdf).cache()


def test_threshold_and_recall(data):
    pdf, df = data
    for fpr in (0.004, 0.01, 0.03):
        got = {r.model: r.threshold for r in M.threshold_at_fpr(df, fpr, ["model"]).collect()}
        for model, g in pdf.groupby("model"):
            assert got[model] == brute.threshold(g.label.to_numpy(), g.score.to_numpy(), fpr)
    for r in M.recall_at_fprs(df, M.REPORTED_FPRS, ["model"]).collect():
        g = pdf[pdf.model == r.model]
        target = float(r.target.rstrip("%")) / 100
        t = brute.threshold(g.label.to_numpy(), g.score.to_numpy(), target)
        hit = g.score >= t
        assert r.recall == pytest.approx(hit[g.label == 1].mean())
        assert r.fpr == pytest.approx(hit[g.label == 0].mean())
        # Ties at the threshold are flagged, so few distinct scores overshoot the target.
        assert (r.fpr > target) == (r.model == "steps")


@pytest.mark.parametrize(
    "rows, low, high",
    [
        ([(1, 0.7), (1, 0.9)], 0.5, 0.5),
        ([(0, 0.6), (1, 0.9), (0, 0.2)], 0.6, 0.6000001),
    ],
)
def test_threshold_without_enough_negatives(spark, rows, low, high):
    """None at all: one half. Fewer than the rate allows: just over the largest."""
    df = spark.createDataFrame(rows, "label int, score double")
    t = M.threshold_at_fpr(df, 0.01).first()[0]
    assert t == low == high or low < t < high
    m = M.metrics_at_threshold(df, t).first()
    assert (m.tp, m.fp) == (sum(y for y, _ in rows), 0)


def test_areas(data):
    pdf, df = data
    auc = {r.model: r.roc_auc for r in M.roc_auc(df, ["model"]).collect()}
    ap = {r.model: r.pr_auc for r in M.average_precision(df, ["model"]).collect()}
    for model, g in pdf.groupby("model"):
        y, s = g.label.to_numpy(), g.score.to_numpy()
        assert auc[model] == pytest.approx(brute.auc(y, s))
        assert ap[model] == pytest.approx(brute.average_precision(y, s))


def test_area_of_one_class_is_nan(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.4)], "label int, score double")
    assert np.isnan(M.roc_auc(df).first()[0])


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {"g": rng.integers(0, 3, 5000), "v": rng.lognormal(3, 2, 5000).round(2)}
    )
    probs = {"a": 0.1, "b": 0.5, "c": 0.95}
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).toPandas()
    for r in got.itertuples():
        v = pdf[pdf.g == r.g].v
        assert [r.a, r.b, r.c] == pytest.approx([v.quantile(p) for p in probs.values()])


def test_ranges_hold_alike_many_values(spark):
    """One far value, a dense spot and a value on half of the rows fill no range."""
    n = 4000
    values = [float(i) for i in range(n)] + [1e300, -1e300] + [5.0] * n
    values += [7 + i / 1e9 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        placed = ranged(df.groupBy("v").count(), ["v"])
    finally:
        spark.conf.set(key, old)
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    distinct = len(set(values))
    assert len(sizes) == 4 and max(sizes) < 2 * distinct / 4
    got = exact_quantiles(df, [], "v", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}).first()
    want = np.sort(values)
    assert got == pytest.approx(np.quantile(want, [0, 0.3, 0.5, 1]))


def test_nulls_have_no_rank(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,), (None,)], "value double")
    rows = running_sums(df, [], "value", {"n": F.lit(1)}).orderBy("value").collect()
    assert [(r.value, r.n_below, r.n_total) for r in rows] == [(1.0, 0, 2), (3.0, 1, 2)]


def test_sequential_ids(spark):
    pdf = pd.DataFrame({"ts_ms": [5, 1, 5, 9, 1], "txn_id": list("badce")})
    got = sequential_ids(spark.createDataFrame(pdf), ["ts_ms", "txn_id"], "seq").toPandas()
    want = pdf.sort_values(["ts_ms", "txn_id"]).txn_id.tolist()
    assert got.sort_values("seq").txn_id.tolist() == want


def test_psi_by_hand(spark):
    """A switch that goes from half to four fifths, a constant, a value spread over deciles that
    loses its lower half, and the same spread once more."""
    rows = spark.range(1000).select(
        (F.col("id") % 2).cast("double").alias("switch"),
        F.lit(4.0).alias("constant"),
        F.col("id").cast("double").alias("spread"),
        F.col("id").cast("double").alias("same"),
    )
    live = rows.withColumns(
        {
            "switch": (F.col("same") % 5 > 0).cast("double"),
            "spread": 500 + F.floor(F.col("same") / 2).cast("double"),
        }
    )
    names = ["switch", "constant", "spread", "same"]
    table = P.build_reference(rows, names).cache()
    assert table.where("feature = 'spread'").count() == 10
    psi = P.psi_report(table, live, names)
    got = {r.feature: r.psi for r in psi.collect()}
    lost = 5 * (0.1 * np.log(2)) + 5 * (1e-4 - 0.1) * np.log(1e-3)
    want = {"switch": 0.3 * np.log(1.6) - 0.3 * np.log(0.4), "spread": lost}
    assert got == pytest.approx({**want, "constant": 0.0, "same": 0.0}, abs=1e-9)
    report = P.drift_report(psi, live).first()
    assert (report.rows, report.max_feature) == (1000, "spread")
    assert report.shifted_features == ["spread", "switch"] and report.drift_detected
    assert report.status == "shifted"
    calm = P.drift_report(P.psi_report(table, rows, names), rows).first()
    assert calm.status == "stable" and not calm.shifted_features and not calm.drift_detected


@pytest.mark.parametrize("n, status", [(199, "insufficient_data"), (200, "shifted")])
def test_least_number_of_live_rows(spark, n, status):
    rows = spark.range(400).select(F.col("id").cast("double").alias("v"))
    table = P.build_reference(rows, ["v"])
    live = rows.where(F.col("v") < n)
    r = P.drift_report(P.psi_report(table, live, ["v"]), live).first()
    assert (r.rows, r.status) == (n, status)


def test_latency_histogram(spark):
    df = spark.createDataFrame([("v", x) for x in (0.5, 3.0, 3000.0)], "m string, latency_ms double")
    got = {r.le: r.bucket_count for r in M.latency_histogram(df, ["m"]).collect()}
    assert got["1"] == 1 and got["5"] == 2 and got["1000"] == 2 and got["+Inf"] == 3


def test_zero_deviation_becomes_one(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    got = {r.feature: (r.mean, r.std) for r in M.feature_stats(df, ["a", "b"]).collect()}
    assert got["a"] == (1.0, 1.0) and got["b"][0] == 3.0
    assert df.agg(F.count("*")).first()[0] == 2
