"""Streaming queries: each runs a stream over the event table to its end and returns what the
stream wrote. The SQL side is the same as for the batch form of the query."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark import schemas as S
from fraudspark.operators.scoring import batch_score, flagged_queue
from fraudspark.plans.catalog import SOME, Ctx, payloads, query
from fraudspark.plans.investigation import window_of
from fraudspark.plans.models import CHALLENGER, CHAMPION
from fraudspark.sources.staging import new_path
from fraudspark.streaming import jobs as J
from fraudspark.streaming import queue as Q
from fraudspark.streaming import state as ST
from fraudspark.streaming.admission import Admission

c = F.col
ADMITTED = 25_000
XYZ = ["amount", "lat", "lon"]
ALL_SQL = "SELECT txn_id, ts_ms, user_id, " + ", ".join(S.FEATURES) + " FROM feats"
MODELS = {m.version: m for m in (CHAMPION, CHALLENGER)}


def stream_features(x: Ctx, good_only: bool = False) -> DataFrame:
    events = J.event_stream(x.spark, x.sf_dir)
    if good_only:
        events = J.good_rows(J.checked_stream(events))
    return J.stateful_features(events, x.t.users, x.t.merchants)


@query(
    "stream_source",
    f"SELECT {', '.join(S.WIRE_COLUMNS)} FROM txn WHERE amount > 0",
    XYZ,
)
def _(x: Ctx):
    """Raw payload files, admitted in chunks, decoded and checked on the stream."""
    raw = new_path(x.spark, "payloads")
    payloads(x.txns).write.text(raw)
    admission = Admission(x.spark, new_path(x.spark, "admission"), ADMITTED)
    admission.take_in(raw)
    out = new_path(x.spark, "admitted")

    def start(stream: DataFrame):
        good = J.good_rows(J.checked_stream(stream))
        return (
            good.writeStream.format("parquet")
            .option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/checkpoint")
            .start()
        )

    admission.feed(start)
    return x.spark.read.schema(S.WIRE).parquet(f"{out}/data")


@query("stream_user_state", ALL_SQL, S.FEATURES)
def _(x: Ctx):
    out = J.run_to_table(stream_features(x), "stream-features")
    return out.select("txn_id", "ts_ms", "user_id", *S.FEATURES)


@query(
    "stream_device_state",
    "SELECT txn_id, device_id, device_users, coalesce(device_first_ms, -1) AS device_first_ms"
    " FROM s1d",
    ["device_users"],
)
def _(x: Ctx):
    events = J.event_stream(x.spark, x.sf_dir)
    x.spark.conf.set(J.PROVIDER, J.ROCKSDB)
    out = J.run_to_table(ST.with_device_state(events), "stream-devices")
    return out.select("txn_id", "device_id", "device_users", "device_first_ms").na.fill(
        {"device_first_ms": -1}
    )


@query(
    "state_warmup",
    f"SELECT txn_id, {', '.join(SOME)} FROM test",
    SOME,
)
def _(x: Ctx):
    # State of everything before the live window is built in batch; the stream starts there.
    start = window_of(x.txns, 7, 7, 7).test_start
    history = x.txns.where(c("ts_ms") < start)
    live = J.event_stream(x.spark, x.sf_dir).where(c("ts_ms") >= start)
    features = J.stateful_features(
        live,
        x.t.users,
        x.t.merchants,
        ST.warm_device_state(history),
        ST.warm_user_state(history),
    )
    return J.run_to_table(features, "warm-features").select("txn_id", *SOME)


def scored_stream(x: Ctx) -> J.Sinks:
    """Runs the scoring job; the promotion log names the champion."""
    promotions = new_path(x.spark, "promotions")
    versions = F.array(
        F.struct(F.lit(CHALLENGER.version).alias("version"), F.lit(0).alias("shift")),
        F.struct(F.lit(CHAMPION.version).alias("version"), F.lit(1).alias("shift")),
    )
    first = x.txns.agg(F.min("ts_ms").alias("lo"))
    first.select("lo", F.inline(versions)).select(
        "version", (c("lo") + c("shift")).alias("promoted_ms")
    ).write.parquet(promotions)
    sinks = J.Sinks(new_path(x.spark, "scoring"))
    J.start_scoring(
        stream_features(x, good_only=True), sinks, promotions, MODELS
    ).awaitTermination()
    return sinks


DECISION_SQL = f"""SELECT s.txn_id, s.user_id, s.merchant_id, s.device_id, s.amount, s.score,
   s.score >= {CHAMPION.threshold} AS flagged, '{CHAMPION.version}' AS model_version,
   t.ts_ms AS event_ms, t.merchant_category AS category, t.channel, t.city, t.country, t.lat, t.lon,
   t.is_online AS online, s.amount_z, s.speed_kmh, s.device_user_count,
   {S.DECISION_TTL_DAYS} AS days_kept, true AS scored_in_run
   FROM scored s JOIN txn t ON t.txn_id = s.txn_id"""


@query(
    "sink_decisions",
    DECISION_SQL,
    ["amount", "score", "lat", "lon", "amount_z", "speed_kmh", "device_user_count"],
)
def _(x: Ctx):
    """Decision rows, read back with the event and the features they were made from."""
    start = F.lit(int(time.time() * 1000))
    d = x.spark.read.parquet(scored_stream(x).decisions)
    txn = F.from_json("txn", "ts double, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in S.TRANSACTION.fields
        if f.name in S.WIRE_COLUMNS and f.name != "ts_ms"
    ))
    made = F.from_json("features", ", ".join(f"{f} double" for f in S.FEATURES))
    return d.withColumns({"event": txn, "made": made}).select(
        "event.txn_id", "event.user_id", "event.merchant_id", "event.device_id", "event.amount",
        "score", "flagged", "model_version",
        F.round(c("event.ts") * 1000).cast("long").alias("event_ms"),
        c("event.merchant_category").alias("category"), "event.channel", "event.city",
        "event.country", "event.lat", "event.lon", c("event.is_online").alias("online"),
        "made.amount_z", "made.speed_kmh", "made.device_user_count",
        F.expr(f"(expires_ms - scored_ms) div {S.DAY_MS}").alias("days_kept"),
        c("scored_ms").between(start, F.unix_millis(F.current_timestamp())).alias("scored_in_run"),
    )


@query(
    "sink_feature_log",
    f"""SELECT txn_id, ts_ms, score, '{CHAMPION.version}' AS model_version,
       {', '.join(SOME)}, ts_ms // {S.DAY_MS} AS day,
       (ts_ms % {S.DAY_MS}) // {S.HOUR_MS} AS hour FROM scored""",
    ["score", *SOME],
)
def _(x: Ctx):
    log = x.spark.read.parquet(scored_stream(x).feature_log)
    return log.select("txn_id", "ts_ms", "score", "model_version", *SOME, "day", "hour")


@query(
    "stream_score",
    f"""SELECT txn_id, user_id, ts_ms, score, '{CHAMPION.version}' AS model_version
       FROM scored WHERE score >= {CHAMPION.threshold}""",
    ["score"],
)
def _(x: Ctx):
    queue = x.spark.read.parquet(scored_stream(x).flagged)
    return queue.select("txn_id", "user_id", "ts_ms", "score", "model_version")


@query(
    "bad_record_routing",
    """SELECT txn_id, 'amount not positive' AS violations, false AS passed FROM txn
       WHERE NOT amount - 1e1 > 0
       UNION ALL SELECT txn_id, '', true FROM txn WHERE amount - 1e1 > 0""",
)
def _(x: Ctx):
    raw = J.event_stream(x.spark, x.sf_dir).withColumn("amount", c("amount") - 10.0)
    checked = J.checked_stream(raw)
    sinks = J.Sinks(new_path(x.spark, "routing"))
    J.start_quarantine(checked, sinks).awaitTermination()
    bad = x.spark.read.schema(checked.schema).parquet(sinks.quarantine)
    good = J.run_to_table(J.good_rows(checked), "good")
    return bad.select(
        "txn_id", F.concat_ws(";", "violations").alias("violations"), F.lit(False).alias("passed")
    ).unionByName(
        good.select("txn_id", F.lit("").alias("violations"), F.lit(True).alias("passed"))
    )


@query(
    "stream_dedupe",
    f"""SELECT txn_id, user_id, ts_ms, score, '{CHAMPION.version}' AS model_version,
       row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, txn_id) AS place
       FROM scored WHERE score >= {CHAMPION.threshold}""",
    ["score"],
)
def _(x: Ctx):
    """Flagged events come twice and out of order; the queue has each once, in order."""
    decisions = batch_score(x.features(), CHAMPION, explain=False)
    sent = flagged_queue(decisions).select(*Q.MESSAGE)
    messages, root = new_path(x.spark, "messages"), new_path(x.spark, "queue")
    twice = sent.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    twice.write.parquet(messages)
    stream = x.spark.readStream.schema(Q.MESSAGE_SCHEMA).parquet(messages)
    Q.run_queue(Q.in_order(stream), root, x.spark.read.parquet(messages).count())
    return Q.read_sink(x.spark, root, Q.QUEUED).select(*Q.MESSAGE, "place")


@query(
    "parity_check",
    "SELECT count(*) AS compared, 0::bigint AS differing FROM txn",
)
def _(x: Ctx):
    stream = J.run_to_table(stream_features(x), "parity").select("txn_id", *S.FEATURES)
    names = {f: f"batch_{f}" for f in S.FEATURES}
    batch = x.features().select("txn_id", *S.FEATURES).withColumnsRenamed(names)
    gaps = [
        (F.abs(c(f) - c(n)) <= 1e-6) & c(f).isNotNull() for f, n in names.items()
    ]
    same = F.coalesce(reduce(lambda a, b: a & b, gaps), F.lit(False))
    return stream.join(batch, "txn_id", "full").agg(
        F.count("*").alias("compared"),
        F.sum((~same).cast("long")).alias("differing"),
    )
