"""What keeps case work in bounds: sources read once, small samples by id, shares of queries."""

import hashlib

import numpy as np
from conftest import DAY, T0, frame, txn
from pyspark.sql import functions as F

from fraudspark.operators import metrics as M
from fraudspark.operators import neighbours as NB
from fraudspark.operators import sampling as SA
from fraudspark.plans import investigation as I
from fraudspark.plans.models import CHAMPION
from fraudspark.schemas import FEATURES
from fraudspark.sources.adapter import Tables


def test_case_work_reads_written_transactions(spark, users, merchants, monkeypatch):
    rows = frame(spark, [txn(i, T0 + i * DAY, 10 + i) for i in range(30)])
    seen = []

    def features(txns, *args, real=I.feature_frame, **kw):
        seen.extend(txns.inputFiles())
        return real(txns, *args, **kw)

    monkeypatch.setattr(I, "feature_frame", features)
    work = I.prepare(Tables(rows, users, merchants), CHAMPION)
    assert seen and all("/transactions-" in f for f in seen)
    assert work.rows.count() == 30


def test_case_bank_with_null_and_repeated_ids(spark):
    ids = [f"T{i}" for i in range(60)] + ["T3", "T4", None, None]
    pool = spark.createDataFrame(
        [(t, i, "U1", None if i == 7 else i % 3 == 0, "none") for i, t in enumerate(ids)],
        "txn_id string, ts_ms long, user_id string, is_fraud boolean, fraud_type string",
    ).withColumns({f: F.col("ts_ms").cast("double") for f in FEATURES})

    def order(t):
        return (t is not None, t and hashlib.md5(f"{t}:0".encode()).hexdigest(), t)

    want = []
    for label, n in ((True, 9), (False, 14)):
        mine = [t for i, t in enumerate(ids) if i != 7 and (i % 3 == 0) == label]
        want += [(label, t) for t in sorted(mine, key=lambda t: tuple(map(str, order(t))))[:n]]
    bank = SA.case_bank(pool, n_legit=14, n_fraud=9)
    got = [(r.is_fraud, r.txn_id) for r in bank.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert SA.case_bank(pool.where("false")).count() == 0
    # features are read for the rows up to the last only, not sorted with all rows
    plan = bank._jdf.queryExecution().executedPlan().toString()
    assert not any("TakeOrdered" in x and FEATURES[0] in x for x in plan.splitlines())


def test_stats_in_parts(spark):
    df = spark.range(40).withColumns({f: F.col("id") * (i + 1.0) for i, f in enumerate(FEATURES)})
    want = {r.feature: (r["mean"], r["std"]) for r in M.feature_stats(df, FEATURES).collect()}
    got = {r.feature: (r["mean"], r["std"]) for r in M.feature_stats(df, FEATURES, at_once=7).collect()}
    assert list(got) == FEATURES and got == want


def test_many_queries_meet_a_part_in_shares(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.normal(size=(90, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, vec array<double>")
    want = [tuple(x) for x in NB.exact_neighbours(rows, rows, 3).orderBy("id", "place").collect()]
    monkeypatch.setattr(NB, "SHARE", 20)
    sizes = []

    def best(pairs, *args, real=NB._best):
        sizes.extend(x[0] for x in pairs.select(F.size("q_ids")).collect())
        return real(pairs, *args)

    monkeypatch.setattr(NB, "_best", best)
    got = [tuple(x) for x in NB.exact_neighbours(rows, rows, 3).orderBy("id", "place").collect()]
    assert got == want and len(got) == 270
    assert len(sizes) == 5 and sum(sizes) == 90
