"""Streaming jobs: score every event with the current champion and write all sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fraudspark.operators import validate as V
from fraudspark.operators.features import feature_columns, with_reference
from fraudspark.operators.scoring import LinearModel, batch_score, flagged_queue
from fraudspark.schemas import DAY_MS, DECISION_TTL_DAYS, FEATURES, WIRE_COLUMNS
from fraudspark.sources import adapter
from fraudspark.sources.staging import new_path
from fraudspark.sources.tables import feature_log_rows, with_day_hour
from fraudspark.streaming.state import with_device_state, with_user_state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
TXN_COLUMNS = [
    "merchant_id", "device_id", "merchant_category", "channel", "city", "lat", "lon", "country"
]


def event_stream(
    spark: SparkSession, sf_dir: str, bytes_per_trigger: int = 512 * 1024 * 1024
) -> DataFrame:
    """The event table as a stream of wire rows. ``bytes_per_trigger`` bounds a micro-batch, and
    with it what one task holds of a hot key at a time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    reader = spark.readStream.schema(adapter.EVENT_SCHEMA).option(
        "maxBytesPerTrigger", bytes_per_trigger
    )
    # A pattern serves a single file as well as a folder of files.
    events = reader.parquet(f"{sf_dir}/events.parquet*")
    customer = adapter.read(spark, sf_dir, "customer", adapter.CUSTOMER_SCHEMA)
    return adapter.transactions(events, customer).select(*WIRE_COLUMNS)


def payload_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Text files with one base64 JSON record per line."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
        .withColumnRenamed("value", "data")
    )


def stateful_features(
    events: DataFrame,
    users: DataFrame,
    merchants: DataFrame,
    device_state: DataFrame | None = None,
    user_state: DataFrame | None = None,
) -> DataFrame:
    """Features of a stream of valid wire rows: device state, then account state, then the
    same projection as in batch."""
    events.sparkSession.conf.set(PROVIDER, ROCKSDB)
    seen = with_user_state(with_device_state(events, device_state), user_state)
    rows = with_reference(seen, users, merchants)
    return rows.select(
        "txn_id", "ts_ms", "user_id", *feature_columns(),
        *[c for c in TXN_COLUMNS if c not in FEATURES],
    )


@dataclass(frozen=True)
class Sinks:
    """Folders of one scoring stream."""

    root: str

    @property
    def decisions(self) -> str:
        return f"{self.root}/decisions"

    @property
    def feature_log(self) -> str:
        return f"{self.root}/feature-log"

    @property
    def flagged(self) -> str:
        return f"{self.root}/flagged"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def current_champion(
    promotions: DataFrame, models: dict[str, LinearModel]
) -> LinearModel:
    """The model promoted last; a log of a few rows."""
    row = promotions.orderBy(F.desc("promoted_ms"), F.desc("version")).first()
    return models[row["version"]]


def write_batch(rows: DataFrame, path: str, batch_id: int, *partition: str) -> None:
    """Each micro-batch owns one folder and overwrites it, so a replay leaves no doubles."""
    writer = rows.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(*partition)
    writer.parquet(f"{path}/batch_id={batch_id}")


def decision_rows(scored: DataFrame, model: LinearModel) -> DataFrame:
    """Decisions as they are kept: with the event and its features as they were scored, as JSON,
    the time of scoring, and the time after which the row may go."""
    event = [
        (F.col("ts_ms") / 1000.0).alias("ts") if n == "ts_ms"
        else (F.col(n) > 0).alias(n) if n == "is_online"
        else F.col(n)
        for n in WIRE_COLUMNS
    ]
    scored_ms = F.unix_millis(F.current_timestamp())
    rows = scored.withColumns(
        {
            "txn": F.to_json(F.struct(*event)),
            "features": F.to_json(F.struct(*FEATURES)),
            "scored_ms": scored_ms,
            "expires_ms": scored_ms + DECISION_TTL_DAYS * DAY_MS,
        }
    )
    keep = ["merchant_id", "device_id", "amount", "txn", "features", "scored_ms", "expires_ms"]
    return batch_score(rows, model, keep=keep)


def score_batch_writer(
    sinks: Sinks, promotions_path: str, models: dict[str, LinearModel]
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: champion of this batch, decisions, feature log, flagged queue."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The three sinks share one run of the stateful part.
        batch = batch.persist()
        try:
            model = current_champion(spark.read.parquet(promotions_path), models)
            decisions = decision_rows(batch, model)
            write_batch(with_day_hour(decisions).drop("hour"), sinks.decisions, batch_id, "day")
            log = batch.withColumn("score", model.score(batch.columns)).withColumn(
                "model_version", F.lit(model.version)
            )
            write_batch(
                with_day_hour(feature_log_rows(log)), sinks.feature_log, batch_id, "day", "hour"
            )
            write_batch(flagged_queue(decisions), sinks.flagged, batch_id)
        finally:
            batch.unpersist()

    return write


def start_scoring(
    features: DataFrame,
    sinks: Sinks,
    promotions_path: str,
    models: dict[str, LinearModel],
    available_now: bool = True,
) -> StreamingQuery:
    writer = (
        features.writeStream.outputMode("append")
        .option("checkpointLocation", f"{sinks.checkpoint}/score")
        .foreachBatch(score_batch_writer(sinks, promotions_path, models))
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 second"}
    return writer.trigger(**trigger).start()


def start_quarantine(checked: DataFrame, sinks: Sinks) -> StreamingQuery:
    """Rows with violations go to their own folder; the scoring stream never sees them."""
    bad = checked.where(F.size("violations") > 0)
    return (
        bad.writeStream.outputMode("append")
        .format("parquet")
        .option("path", sinks.quarantine)
        .option("checkpointLocation", f"{sinks.checkpoint}/quarantine")
        .trigger(availableNow=True)
        .start()
    )


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("violations") == 0).select(*WIRE_COLUMNS)


def checked_stream(raw: DataFrame) -> DataFrame:
    """Decoded when the stream carries payloads, then checked."""
    rows = V.decode_payload(raw) if "data" in raw.columns else raw
    return V.validate(rows)


def dedupe(flagged: DataFrame, delay: str = "1 day") -> DataFrame:
    """A queue drops messages it has seen; the watermark bounds what it has to remember."""
    at = F.timestamp_millis(F.col("ts_ms"))
    return (
        flagged.withColumn("event_time", at)
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["txn_id"])
    )


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now and returns its output as a table."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    q = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
