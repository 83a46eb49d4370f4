"""Streams give the batch features, survive restarts, and never let a bad record block."""

import base64
import json

import pytest
from brute import replay as brute_replay
from conftest import T0, frame, txn
from pyspark.sql import functions as F
from test_skew import CHECKED, check, skewed_rows

from fraudspark.operators import drift as P
from fraudspark.operators import validate as V
from fraudspark.plans import drift_job
from fraudspark.plans import training as TR
from fraudspark.plans.investigation import prepare
from fraudspark.plans.models import CHALLENGER, CHAMPION
from fraudspark.schemas import FEATURES, WIRE, WIRE_COLUMNS
from fraudspark.sources import adapter, tables as TB
from fraudspark.streaming import jobs as J
from fraudspark.streaming import state as ST

MODELS = {m.version: m for m in (CHAMPION, CHALLENGER)}
# Streams carry no such columns: they belong to the batch look-ups.
STREAMED = [c for c in CHECKED if c not in ("n_before", "device_user_first_ms")]


def write_parts(spark, rows, path, parts):
    """One file per time slice, so that the stream sees several micro-batches."""
    rows = sorted(rows, key=lambda r: (r["ts_ms"], r["txn_id"]))
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = frame(spark, rows[i * size : (i + 1) * size]).select(*WIRE_COLUMNS)
        part.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(WIRE).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_over_micro_batches(spark, tmp_path):
    spark.conf.set(J.PROVIDER, J.ROCKSDB)
    rows = skewed_rows(600, seed=5)
    path = str(tmp_path / "in")
    write_parts(spark, rows, path, 3)
    out = J.run_to_table(
        ST.with_user_state(ST.with_device_state(stream(spark, path))), "state"
    )
    check(out.toPandas(), brute_replay(rows), STREAMED)


def test_sets_overflow_on_the_stream(spark, tmp_path):
    spark.conf.set(J.PROVIDER, J.ROCKSDB)
    rows = [
        txn(i, T0 + i * 1000, 10, device_id=f"D{i % 70}", merchant_id=f"M{i % 330}")
        for i in range(700)
    ]
    path = str(tmp_path / "in")
    write_parts(spark, rows, path, 2)
    out = J.run_to_table(
        ST.with_user_state(ST.with_device_state(stream(spark, path))), "caps"
    )
    check(out.toPandas(), brute_replay(rows), STREAMED)


def capped_rows():
    """One account past every cap of its own, one device past its accounts."""
    rows = [
        txn(i, T0 + i * 60_000, 10 + i % 7, device_id=f"D{(i * 5 + i // 70) % 67}", merchant_id=f"M{i * 7 % 341}")
        for i in range(1300)
    ]
    rows += [
        txn(5000 + i, T0 + i * 90_000 + 5, 20, user_id=f"U{i * 3 % 251}x", device_id="RING")
        for i in range(800)
    ]
    return rows


@pytest.mark.parametrize("replay_rows", [5_000_000, 150])
def test_warm_start_past_every_cap(spark, tmp_path, replay_rows):
    spark.conf.set(J.PROVIDER, J.ROCKSDB)
    rows = sorted(capped_rows(), key=lambda r: (r["ts_ms"], r["txn_id"]))
    old, new = rows[:1500], rows[1500:]
    path = str(tmp_path / "in")
    write_parts(spark, new, path, 2)
    history = frame(spark, old).select(*WIRE_COLUMNS).repartition(5)
    devices = ST.with_device_state(
        stream(spark, path), ST.warm_device_state(history, replay_rows)
    )
    out = J.run_to_table(
        ST.with_user_state(devices, ST.warm_user_state(history, replay_rows)), "warm"
    )
    want = brute_replay(rows)
    assert max(w["user_devices"] for w in want.values()) > 50
    assert max(w["device_users"] for w in want.values()) > 200
    check(out.toPandas(), {r["txn_id"]: want[r["txn_id"]] for r in new}, STREAMED)


def test_late_events_see_what_is_kept(spark, tmp_path):
    """Windows of an event that comes late, and of those after it, hold the kept events whose time
    is in them."""
    spark.conf.set(J.PROVIDER, J.ROCKSDB)
    hour = 3_600_000
    first = [txn(i, T0 + i * hour // 2, 10 + i) for i in range(8)]
    late = [txn(20, T0 + hour // 4, 50), txn(21, T0 + 2 * hour, 60), txn(22, T0 + 5 * hour, 70)]
    path = str(tmp_path / "in")
    for part in (first, late):
        frame(spark, part).select(*WIRE_COLUMNS).coalesce(1).write.mode("append").parquet(path)
    out = J.run_to_table(ST.with_user_state(ST.with_device_state(stream(spark, path))), "late")
    got = {r["txn_id"]: r for r in out.collect()}
    arrived = []
    for r in first + late:
        g = got[r["txn_id"]]
        near = [p for p in arrived if r["ts_ms"] - hour < p["ts_ms"] <= r["ts_ms"]]
        day = [p for p in arrived if p["ts_ms"] <= r["ts_ms"]]
        assert (g["count_1h"], g["count_24h"]) == (len(near), len(day))
        assert g["sum_24h"] == pytest.approx(sum(p["amount"] for p in day))
        assert g["row_no"] == len(arrived) + 1
        arrived.append(r)


def scoring(spark, path, sinks, promotions, users, merchants):
    good = J.good_rows(J.checked_stream(J.payload_stream(spark, path, 1)))
    J.start_scoring(
        J.stateful_features(good, users, merchants), sinks, promotions, MODELS
    ).awaitTermination()


def payload(r):
    d = {k: r[k] for k in WIRE_COLUMNS if k != "ts_ms"} | {"ts": r["ts_ms"] / 1000}
    return base64.b64encode(json.dumps(d).encode()).decode()


def test_scoring_job_restart_and_garbage(spark, tmp_path, users, merchants):
    rows = [txn(i, T0 + i * 60_000, 40 + i) for i in range(30)]
    src = tmp_path / "in"
    src.mkdir()
    garbage = base64.b64encode(json.dumps({"garbage": True}).encode()).decode()
    (src / "1.txt").write_text("\n".join([*map(payload, rows[:20]), garbage, "no base64!"]))
    promotions = str(tmp_path / "promotions")
    spark.createDataFrame(
        [("lin-v2", 1), ("lin-v1", 2)], "version string, promoted_ms long"
    ).write.parquet(promotions)
    sinks = J.Sinks(str(tmp_path / "out"))
    scoring(spark, str(src), sinks, promotions, users, merchants)
    first = spark.read.parquet(sinks.decisions)
    assert first.count() == 20 and {r[0] for r in first.select("model_version").distinct().collect()} == {"lin-v1"}

    # New events and a new champion; the restarted job continues from its state.
    (src / "2.txt").write_text("\n".join(map(payload, rows[20:])))
    spark.createDataFrame(
        [("lin-v2", 3)], "version string, promoted_ms long"
    ).write.mode("append").parquet(promotions)
    scoring(spark, str(src), sinks, promotions, users, merchants)
    log = spark.read.parquet(sinks.feature_log).orderBy("ts_ms").collect()
    assert [r.txn_count_total for r in log] == list(range(30))
    assert {r.model_version for r in log[20:]} == {"lin-v2"}
    assert spark.read.parquet(sinks.decisions).count() == 30

    # Replaying a micro-batch overwrites its folder.
    again = spark.read.parquet(f"{sinks.decisions}/batch_id=1").select("txn_id")
    J.write_batch(again, sinks.flagged, 1)
    J.write_batch(again, sinks.flagged, 1)
    assert spark.read.parquet(f"{sinks.flagged}/batch_id=1").count() == again.count()

    checked = J.checked_stream(J.payload_stream(spark, str(src), 1))
    J.start_quarantine(checked, sinks).awaitTermination()
    bad = spark.read.parquet(sinks.quarantine).collect()
    assert len(bad) == 2 and all("txn_id missing" in r.violations for r in bad)


def test_validation_rules(spark):
    rows = [
        txn(0, T0, 5), txn(1, T0, 0), txn(2, T0, -1), txn(3, T0, 5, channel="CASH"),
        txn(4, T0, 5, city=None), txn(5, T0, 5, country=None, is_online=None),
    ]
    good, bad = V.good_and_bad(frame(spark, rows))
    assert sorted(r.txn_id for r in good.collect()) == ["T000000", "T000005"]
    assert good.where("country = 'IN' AND NOT is_online").count() == 2
    why = {r.txn_id: list(r.violations) for r in bad.collect()}
    assert why == {
        "T000001": ["amount not positive"], "T000002": ["amount not positive"],
        "T000003": ["unknown channel"], "T000004": ["city missing"],
    }


def test_dedupe(spark, tmp_path):
    rows = [txn(i, T0 + i, 5) for i in range(10)]
    path = str(tmp_path / "in")
    write_parts(spark, rows + rows, path, 2)
    assert J.run_to_table(J.dedupe(stream(spark, path)), "dedupe").count() == 10


@pytest.fixture(scope="module")
def work(spark, sf_dir):
    return prepare(adapter.load(spark, sf_dir), CHAMPION)


def test_feature_log_and_drift_job(spark, work, tmp_path):
    path = str(tmp_path / "log")
    rows = work.live.withColumn("score", F.lit(0.01)).withColumn("model_version", F.lit("v"))
    TB.write_feature_log(rows, path)
    end = int(work.window.end)
    day = TB.load_feature_log(spark, path, end - 86_400_000, end)
    lo = (end - 86_400_000) // 3_600_000 * 3_600_000
    assert day.count() == work.live.where(F.col("ts_ms") >= lo).count()
    assert TB.load_feature_log(spark, path, end + 10**7, end + 2 * 10**7).count() == 0
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters")[1][:200]

    ref = P.build_reference(work.train, FEATURES).unionByName(
        P.build_reference(work.val.withColumn(P.SCORE, CHAMPION.score()), [P.SCORE])
    )
    report, psi = drift_job.run(spark, path, ref, end, lookback_hours=24 * 7)
    r = report.first()
    assert r.drift_detected and P.SCORE in r.shifted_features and psi.count() == 46
    events = str(tmp_path / "events")
    assert drift_job.append_event(report, events) == 1
    assert drift_job.append_event(report, events) == 0
    assert [e.max_feature for e in drift_job.events(spark, events).collect()] == [r.max_feature]
    short, _ = drift_job.run(spark, path, ref, end, lookback_hours=1)
    assert short.first().status == "insufficient_data"


def test_models_beat_rules(work):
    bundle = TR.train(work, rounds=5)
    by = {r.model: r for r in bundle.report.collect()}
    assert set(by) == {"rules", "linear", "boosted"}
    assert by["linear"].roc_auc > by["rules"].roc_auc
    assert all(r.n == by["rules"].n for r in by.values())
    assert bundle.case_bank.where("is_fraud").count() > 0
    assert bundle.psi_reference.select("feature").distinct().count() == 46


def test_tables(spark, tmp_path):
    rows = [txn(i, T0 + i * 500 + 7, 5) for i in range(5)]
    raw = frame(spark, rows).withColumn("ts", F.col("ts_ms") / 1000.0).drop("ts_ms")
    raw.write.parquet(str(tmp_path / "t"))
    back = TB.read_transactions(spark, str(tmp_path / "t"))
    assert sorted(r.ts_ms for r in back.collect()) == [r["ts_ms"] for r in rows]
    loads = spark.createDataFrame(
        [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "id string, v long, x string"
    )
    got = {r.id: r.x for r in TB.reference_upsert(loads, "id", "v").collect()}
    assert got == {"a": "new", "b": "only"}
    wire = TB.wire_projection(frame(spark, rows), 1, 3).orderBy("seq").collect()
    assert [r.txn_id for r in wire] == ["T000001", "T000002", "T000003"]
    assert "is_fraud" not in wire[0]
