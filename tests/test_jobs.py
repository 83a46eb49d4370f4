"""Commit log, stored models, promotions that race, and drift histograms by hour."""

import json
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from fraudspark.operators import drift as P
from fraudspark.plans import drift_job
from fraudspark.plans.models import CHALLENGER, CHAMPION
from fraudspark.plans.registry import Registry
from fraudspark.schemas import FEATURES, HOUR_MS
from fraudspark.sources import commits as C
from fraudspark.sources import tables as TB

START = 480_000 * HOUR_MS


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "a" / "one.json")
    assert C.put_if_absent(spark, path, "ä 1")
    assert not C.put_if_absent(spark, path, "2")
    assert C.read_text(spark, path) == "ä 1"
    assert C.names(spark, str(tmp_path / "a")) == ["one.json"]


def test_racing_appends_keep_every_commit(spark, tmp_path):
    log = C.CommitLog(spark, str(tmp_path / "log"))
    assert log.last() is None and log.rows("commit long").count() == 0

    def add(i):
        return log.append(lambda last: {"who": i, "after": last["who"] if last else None})

    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(add, range(18)))
    rows = log.rows("commit long, who long, after long").orderBy("commit").collect()
    assert [r.commit for r in rows] == list(range(1, 19))
    assert sorted(r.who for r in rows) == list(range(18))
    assert [r.after for r in rows] == [None] + [r.who for r in rows[:-1]]
    assert {d["commit"] for d in done} == set(range(1, 19))
    assert log.append(lambda last: None) is None and log.last()["commit"] == 18


def test_models_are_read_back_as_stored(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "reg"))
    bank = spark.range(3)
    assert r.publish("v1", CHAMPION, 0.25, {"case_bank": bank})
    assert not r.publish("v1", CHALLENGER, 0.5)
    back = r.load("v1")
    assert back.weights == CHAMPION.weights and back.means == CHAMPION.means
    assert list(back.weights) == list(CHAMPION.weights)
    assert (back.intercept, back.threshold, back.version) == (CHAMPION.intercept, 0.25, "v1")
    assert r.table("v1", "case_bank").count() == 3
    assert r.champion() is None and r.history().count() == 0


def test_racing_promotions_give_one_history(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "reg"))
    assert r.promote("base", 0, "first", {}, None)["commit"] == 1
    gate = threading.Barrier(4)
    won, lost = [], []

    def challenge(v):
        gate.wait()
        seen = "base"
        while True:
            entry = r.promote(v, 1, "better", {"pr_auc": 0.5}, seen)
            if entry:
                won.append((v, seen))
                return
            lost.append(v)
            seen = r.champion()["version"]

    threads = [threading.Thread(target=challenge, args=(f"v{i}",)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = r.history().collect()
    assert [x.commit for x in rows] == [5, 4, 3, 2, 1]
    assert [x.previous for x in rows[:-1]] == [x.version for x in rows[1:]]
    assert rows[-1].previous is None and rows[0].metrics == {"pr_auc": 0.5}
    assert {(x.version, x.previous) for x in rows[:-1]} == set(won) and len(lost) >= 3
    assert [x.commit for x in r.history(2).collect()] == [5, 4]
    # A stale comparison is refused, and the first decision on a version stands.
    assert r.promote("late", 2, "stale", {}, "base") is None
    d = {"version": "late", "champion": "base", "promote": False, "reason": "x"}
    assert r.decide("late", d) and not r.decide("late", {**d, "promote": True})
    assert [x.promote for x in r.decisions().collect()] == [False]


@pytest.fixture
def log(spark, tmp_path):
    """300 rows in each of four hours; the amounts of the last hour are ten times as high."""
    row = F.col("id")
    hour = F.floor(row / 300)
    rows = spark.range(1200).select(
        F.concat(F.lit("T"), row.cast("string")).alias("txn_id"),
        (F.lit(START) + hour * HOUR_MS + (row % 300) * 1000).alias("ts_ms"),
        ((row % 10) / 10).alias("score"),
        F.lit("v").alias("model_version"),
        *[
            ((row % 97) * F.when(hour == 3, 10.0).otherwise(1.0)).alias(f)
            if f == "amount"
            else (row % 7).cast("double").alias(f)
            for f in FEATURES
        ],
    )
    path = str(tmp_path / "log")
    TB.write_feature_log(rows, path)
    reference = P.build_reference(
        rows.where(hour < 3).withColumnRenamed("score", P.SCORE), [*FEATURES, P.SCORE]
    )
    return path, rows, reference


def job(spark, log, until, hours, **kw):
    path, _, reference = log
    return drift_job.run(
        spark, path, reference, until, hours, version="v", flag_threshold=0.75, **kw
    )


def test_hours_add_up_to_the_whole(spark, log):
    path, rows, reference = log
    until = START + 4 * HOUR_MS - 1
    report, psi = job(spark, log, until, 3)
    live = rows.withColumnRenamed("score", P.SCORE)
    want = {
        r.feature: r.psi
        for r in P.psi_report(reference, live, [*FEATURES, P.SCORE]).collect()
    }
    got = {r.feature: r.psi for r in psi.collect()}
    assert got.keys() == want.keys() and len(got) == 46
    assert all(abs(got[f] - want[f]) < 1e-9 for f in got)
    r = report.first()
    assert r.rows == 1200 and r.max_feature == "amount" and r.model_version == "v"
    assert abs(r.flag_rate - 0.2) < 1e-12


def test_only_new_and_changed_hours_are_counted(spark, log, monkeypatch):
    path, rows, reference = log
    counted = []
    inner = drift_job.update_histograms

    def spy(*args):
        counted.append([k.split("-")[1] for k in inner(*args)])
        return counted[-1]

    monkeypatch.setattr(drift_job, "update_histograms", spy)
    first, _ = job(spark, log, START + 2 * HOUR_MS, 2)
    assert first.first().rows == 900 and first.first().status == "stable"
    second, _ = job(spark, log, START + 4 * HOUR_MS - 1, 3)
    assert second.first().rows == 1200
    job(spark, log, START + 4 * HOUR_MS - 1, 3)
    # A file that comes late changes its hour only.
    late = rows.where(F.col("ts_ms") < START + HOUR_MS).limit(50)
    TB.write_feature_log(late, path)
    again, _ = job(spark, log, START + 4 * HOUR_MS - 1, 3)
    assert again.first().rows == 1250
    start = (START // HOUR_MS) % 24
    hour = [f"{(start + i) % 24:02d}" for i in range(4)]
    assert [sorted(x) for x in counted] == [sorted(hour[:3]), [hour[3]], [], [hour[0]]]


def test_event_once_per_window(spark, log, tmp_path):
    out = str(tmp_path / "events")
    until = START + 4 * HOUR_MS - 1
    calm, _ = job(spark, log, START + 2 * HOUR_MS, 2)
    assert drift_job.append_event(calm, out) == 0
    assert drift_job.events(spark, out).count() == 0
    shifted, _ = job(spark, log, until, 0)
    with ThreadPoolExecutor(3) as pool:
        wrote = list(pool.map(lambda _: drift_job.append_event(shifted, out), range(3)))
    assert sorted(wrote) == [0, 0, 1]
    (event,) = drift_job.events(spark, out).collect()
    assert event.rows == 300 and event.max_feature == "amount"
    assert "amount" in event.shifted_features and event.until_ms == until
    assert json.loads(C.read_text(spark, f"{out}/{C.names(spark, out)[0]}"))["rows"] == 300


def test_log_without_rows(spark, log, tmp_path):
    _, _, reference = log
    for path, until in ((str(tmp_path / "none"), START), (log[0], START - 90 * HOUR_MS)):
        report, psi = drift_job.run(spark, path, reference, until)
        r = report.first()
        assert r.rows == 0 and r.status == "insufficient_data" and not r.drift_detected
        assert r.max_psi is None and r.flag_rate is None
