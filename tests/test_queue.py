"""Late, doubled and reordered messages are all accounted for."""

from collections import defaultdict

from fraudspark.streaming import queue as Q


def messages(rows):
    return [(f"T{i}", u, t, 0.5, "v") for i, u, t in rows]


def test_every_message_has_a_fate(spark, tmp_path):
    minute = 60_000
    first = [(1, "a", 5 * minute), (2, "a", 4 * minute), (2, "a", 4 * minute), (3, "b", minute), (9, "c", 0)]
    second = [(4, "a", 4 * minute + 5), (5, "a", 9 * minute), (1, "a", 5 * minute), (3, "b", minute)]
    third = [(6, "a", 3 * minute), (7, "a", 9 * minute), (8, "a", 8 * minute + 1)]
    src = str(tmp_path / "in")
    for part in (first, second, third):
        spark.createDataFrame(messages(part), Q.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(Q.MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    root = str(tmp_path / "out")
    Q.run_queue(Q.in_order(stream, delay_ms=minute, idle_ms=4000), root, 12)
    sinks = {f: Q.read_sink(spark, root, f).collect() for f in Q.FATES}
    assert sum(map(len, sinks.values())) == 12
    assert sorted(r["txn_id"] for r in sinks[Q.DOUBLED]) == ["T1", "T2", "T3"]
    assert [r["txn_id"] for r in sinks[Q.LATE]] == ["T6"]
    accounts = defaultdict(list)
    for r in sorted(sinks[Q.QUEUED], key=lambda r: r["place"]):
        accounts[r["user_id"]].append((r["place"], r["txn_id"]))
    assert accounts["a"] == list(enumerate(["T2", "T4", "T1", "T8", "T5", "T7"], 1))
    assert accounts["b"] == [(1, "T3")] and accounts["c"] == [(1, "T9")]
