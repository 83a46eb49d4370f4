"""Facts before any time and order statistics against plain Python."""

import random
from collections import defaultdict
from statistics import median

import pytest

from fraudspark.operators import asof
from fraudspark.operators import lookups as L
from pyspark.sql import functions as F


def values(seed):
    r = random.Random(seed)
    out = {"flat": [5.0] * 40, "one": [1.0], "heavy": [], "wide": [], "steps": []}
    out["heavy"] = [7.0 if r.random() < 0.8 else r.uniform(0, 20) for _ in range(700)]
    out["wide"] = [r.choice([-1e300, 1e300, r.gauss(0, 1), 1e-300]) for _ in range(500)]
    out["steps"] = [float(i % 37) for i in range(600)]
    return out


@pytest.mark.parametrize("settings", [{}, {"leaf": 10, "fan": 3, "block": 7}, {"leaf": 1, "fan": 2, "block": 64}])
def test_order_statistics(spark, settings):
    data = values(1)
    rows = [(node, i, v) for node, vs in data.items() for i, v in enumerate(vs)]
    r = random.Random(2)
    asked = {(node, n, r.randrange(n)) for node, vs in data.items() for n in [len(vs), *[r.randint(1, len(vs)) for _ in range(60)]]}
    df = spark.createDataFrame(rows, "node string, pos long, value double").repartition(5)
    q = spark.createDataFrame(sorted(asked) * 2, "node string, n long, k long")
    got = {(x["node"], x["n"], x["k"]): x["value"] for x in asof.order_statistics(df, q, **settings).collect()}
    assert got == {(node, n, k): sorted(data[node][:n])[k] for node, n, k in asked}


def test_timeline_is_strictly_before(spark):
    r = random.Random(3)
    events = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 60), r.randint(0, 1), r.random()) for _ in range(900)]
    events += [("hot", 30, 1, 2.0)] * 300  # one instant
    points = [(r.choice(["a", "b", "c", "hot", None]), r.randint(-1, 62)) for _ in range(200)] + [("hot", 30), ("hot", 31)]
    line = asof.Timeline(
        spark.createDataFrame(points, "key string, at long"),
        spark.createDataFrame(events, "key string, at long, x long, value double").repartition(6),
        ["x"],
    )
    got = {(t["key"], t["at"]): (t["x"], t["x_all"]) for t in line.totals().collect()}
    want = {}
    for key, at in points:
        if key is not None:
            mine = [e for e in events if e[0] == key]
            want[key, at] = (sum(e[2] for e in mine if e[1] < at), sum(e[2] for e in mine))
    assert got == want
    places = defaultdict(list)
    for v in line.values("x").collect():
        places[v["node"]].append(v["pos"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len(places["hot"]) == 300


def test_merchant_facts_before_each_anchor(spark):
    r = random.Random(4)
    rows = [(r.choice(["M1", "M2"]), f"U{r.randint(0, 9)}", r.choice([None, r.uniform(1, 50)]), r.randint(0, 99), r.random() < 0.2) for _ in range(400)]
    rows += [("M3", "U1", 5.0, 90, True), ("M4", None, 1.0, 10, False)]
    txns = spark.createDataFrame(rows, "merchant_id string, user_id string, amount double, ts_ms long, is_fraud boolean")
    anchors = spark.createDataFrame(
        [(m, t) for m in ("M1", "M2", "M3", "M4", "M5", None) for t in (0, 1, 20, 55, 70, 71, 99)], "merchant_id string, ts_ms long"
    )
    got = {(x["merchant_id"], x["known_ms"]): x for x in L.merchant_facts(anchors, txns, F.lit(70)).collect()}
    assert {m for m, _ in got} == {"M1", "M2", "M4"}  # M3 has no row before the cutoff
    for (m, t), x in got.items():
        before = [e for e in rows if e[0] == m and e[3] < t]
        prices = [e[2] for e in before if e[2] is not None]
        assert x["resolved_txns"] == len(before)
        assert x["distinct_users"] == len({e[1] for e in before} - {None})
        if before:
            assert x["confirmed_fraud_rate"] == pytest.approx(sum(e[4] for e in before) / len(before), abs=5e-5)
        else:
            assert x["confirmed_fraud_rate"] is None
        if prices:
            assert x["merchant_median_amount"] == pytest.approx(median(prices), abs=1e-4)
        else:
            assert x["merchant_median_amount"] is None
