"""Derived tables: reused while the inputs are the same, made anew after a change, swept when
nobody holds them."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from fraudspark.plans import investigation as I
from fraudspark.plans.models import CHAMPION
from fraudspark.sources import adapter
from fraudspark.sources import commits as C
from fraudspark.sources.cache import DerivedTables, fingerprint


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(10).write.parquet(path)
    return path


def maker(spark, source, calls):
    def make():
        calls.append(1)
        return spark.read.parquet(source).selectExpr("id", "id * 2 AS twice")

    return make


def test_reuse_and_change(spark, source, tmp_path):
    calls = []
    make = maker(spark, source, calls)
    first = DerivedTables(spark, "t", str(tmp_path / "d"))
    other = DerivedTables(spark, "t", str(tmp_path / "d"))
    a = first.get([source], "p", make)
    b = other.get([source], "p", make)
    assert len(calls) == 1 and a.schema == b.schema
    assert sorted(map(tuple, b.collect())) == [(i, 2 * i) for i in range(10)]
    other.get([source], "other parameters", make)
    assert len(calls) == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert first.get([source], "p", make).count() == 12 and len(calls) == 3
    # Same size, newer time.
    mark = fingerprint(spark, [source])
    part = next(f for f in os.listdir(source) if f.endswith(".parquet"))
    os.utime(f"{source}/{part}", (2_000_000_000, 2_000_000_000))
    assert fingerprint(spark, [source]) != mark


def test_makers_that_race(spark, source, tmp_path):
    calls = []
    make = maker(spark, source, calls)
    stores = [DerivedTables(spark, "t", str(tmp_path / "d")) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        counts = list(pool.map(lambda s: s.get([source], "p", make).count(), stores))
    assert counts == [10, 10, 10]
    assert len(C.names(spark, f"{stores[0].base}/data")) == 1


def test_sweep_leaves_what_is_held_and_the_newest(spark, source, tmp_path):
    make = maker(spark, source, [])
    user = DerivedTables(spark, "t", str(tmp_path / "d"))
    old = user.get([source], "p1", make)
    job = DerivedTables(spark, "t", str(tmp_path / "d"))
    job.get([source], "p2", make)
    assert job.sweep() == [] and old.count() == 10
    user.release()
    gone = job.sweep()
    assert gone == [user.key([source], "p1")]
    assert len(C.names(spark, f"{job.base}/data")) == 1
    assert job.sweep() == []
    # Swept entries are made anew; holds of dead sessions lapse.
    again = DerivedTables(spark, "t", str(tmp_path / "d"), hold_hours=1.0)
    assert again.get([source], "p1", make).count() == 10
    assert again.sweep() == []
    assert len(again.sweep(now_ms=4_000_000_000_000)) == 1


def test_data_that_was_lost_is_made_anew(spark, source, tmp_path):
    calls = []
    make = maker(spark, source, calls)
    store = DerivedTables(spark, "t", str(tmp_path / "d"))
    store.get([source], "p", make)
    data = f"{store.base}/data/{C.names(spark, f'{store.base}/data')[0]}"
    C.remove(spark, f"{data}/_SUCCESS")
    assert store.get([source], "p", make).count() == 10 and len(calls) == 2


def test_features_are_not_replayed(spark, sf_dir, tmp_path, monkeypatch):
    calls = []
    inner = I.feature_frame

    def spy(*args, **kw):
        calls.append(1)
        return inner(*args, **kw)

    monkeypatch.setattr(I, "feature_frame", spy)
    t = adapter.load(spark, sf_dir)
    got = [
        I.prepare(
            t, CHAMPION, kept=DerivedTables(spark, "f", str(tmp_path / "d")),
            sources=adapter.source_paths(sf_dir),
        )
        for _ in range(2)
    ]
    assert len(calls) == 1 and got[0].window == got[1].window
    assert got[0].rows.exceptAll(got[1].rows).count() == 0
