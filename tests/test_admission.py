"""Payload files dealt into chunks: bounded batches, order of lines, nothing twice."""

import pytest
from brute import replay as brute_replay
from conftest import T0, txn
from test_skew import check
from test_streaming import STREAMED, payload

from fraudspark.streaming import jobs as J
from fraudspark.streaming import state as ST
from fraudspark.streaming.admission import Admission


def feed(admission, sizes, out):
    def write(batch, batch_id):
        batch = batch.persist()
        if batch.count():
            sizes.append(batch.count())
        J.write_batch(batch, out, batch_id)
        batch.unpersist()

    def start(stream):
        seen = ST.with_user_state(ST.with_device_state(J.good_rows(J.checked_stream(stream))))
        return seen.writeStream.option("checkpointLocation", f"{out}-state").foreachBatch(write).start()

    return admission.feed(start)


def test_a_hot_device_in_one_file_is_met_in_several_batches(spark, tmp_path):
    spark.conf.set(J.PROVIDER, J.ROCKSDB)
    rows = [txn(i, T0 + i * 60_000, 10 + i, device_id="HOT", merchant_id=f"M{i % 7}") for i in range(50)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("\n".join([*map(payload, rows[:40]), "no payload"]))
    admission = Admission(spark, str(tmp_path / "admission"), rows=16)
    admission.take_in(str(src))
    assert admission.waiting() == [(0, 0), (0, 1), (0, 2)]
    sizes, out = [], str(tmp_path / "out")
    assert feed(admission, sizes, out) == 3
    assert sizes == [16, 16, 8]
    # another file and a restart; released chunks are not taken again
    (src / "b.txt").write_text("\n".join(map(payload, rows[40:])))
    admission.take_in(str(src))
    admission.take_in(str(src))
    assert feed(admission, sizes, out) == 4
    assert sizes == [16, 16, 8, 10]
    check(spark.read.parquet(out).toPandas(), brute_replay(rows), STREAMED)


def test_chunks_need_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        Admission(spark, str(tmp_path), rows=0)


def test_a_record_is_parsed_once(spark):
    raw = spark.createDataFrame([(payload(txn(1, T0, 10)),), ("no payload",), (None,)], "data string")
    checked = J.checked_stream(raw)
    plan = J.good_rows(checked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert J.good_rows(checked).count() == 1 and checked.count() == 3


def test_the_stream_never_lists_more_than_one_chunk(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("\n".join(payload(txn(i, T0 + i, 10)) for i in range(40)))
    admission = Admission(spark, str(tmp_path / "admission"), rows=10)
    admission.take_in(str(src))
    listed, out = [], str(tmp_path / "out")

    def write(batch, batch_id):
        listed.append(len(list((tmp_path / "admission" / "released").glob("batch=*"))))
        J.write_batch(batch, out, batch_id)

    def start(stream):
        good = J.good_rows(J.checked_stream(stream))
        return good.writeStream.option("checkpointLocation", f"{out}-state").foreachBatch(write).start()

    assert admission.feed(start) == 4
    assert listed == [1, 1, 1, 1]
    assert admission.waiting() == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert admission.feed(start) == 4
    assert listed == [1, 1, 1, 1] and spark.read.parquet(out).count() == 40
