"""Raw payloads admitted to a stream in chunks of bounded rows, in order.

A file of payloads may be larger than a micro-batch may be, and Spark's file source takes files
whole. So arriving files are dealt into chunks first: lines are numbered over all new files (by
time and name of the file, block, and line), from counts per block and without a sort of the lines,
and written once, by chunk. Chunks are then moved to the folder that the stream reads, one at a
time, the next one when the stream has taken the last, and out of it again, so that the stream never
lists more than one. A micro-batch thus holds the rows of one chunk, and a key that fills a file is
met in several batches, in the order of its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fraudspark.sources import commits as C
from fraudspark.sources.staging import stage

CHUNK_ROWS = 1_000_000
PLACE = ["file_modification_time", "file_path", "file_block_start"]


def dealt(lines: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """``data``, ``place`` (0, 1, ... over all lines) and ``chunk`` of payload lines with the
    columns of PLACE. Only counts per block are brought together."""
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    blocks = numbered.groupBy(*PLACE).agg(F.min("line").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.col("before") + F.col("line") - F.col("first")
    return (
        numbered.join(F.broadcast(stage(blocks, "payload-blocks")), PLACE)
        .select("data", place.alias("place"))
        .withColumn("chunk", F.floor(F.col("place") / rows))
    )


class Admission:
    """Chunks of the payload files under one folder, and the stream over them."""

    def __init__(self, spark: SparkSession, root: str, rows: int = CHUNK_ROWS):
        if rows < 1:
            raise ValueError("a chunk must hold a row at least")
        self.spark, self.root, self.rows = spark, root.rstrip("/"), rows

    @property
    def spool(self) -> str:
        return f"{self.root}/spool"

    @property
    def released(self) -> str:
        return f"{self.root}/released"

    @property
    def done(self) -> str:
        return f"{self.root}/done"

    def take_in(self, path: str) -> None:
        """Deals files that have come since the last call. A file is taken in once; each call that
        is repeated after a failure writes the same chunks again."""

        def write(batch: DataFrame, batch_id: int) -> None:
            chunks = dealt(batch, self.rows).repartition("chunk", F.floor(F.col("place") / F.lit(max(1, self.rows // 8))))
            chunks.write.mode("overwrite").partitionBy("chunk").parquet(f"{self.spool}/batch_id={batch_id}")

        lines = self.spark.readStream.text(path).select(
            F.col("value").alias("data"), *[F.col(f"_metadata.{c}").alias(c) for c in PLACE]
        )
        (
            lines.writeStream.option("checkpointLocation", f"{self.root}/intake")
            .foreachBatch(write)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    def waiting(self) -> list[tuple[int, int]]:
        """Chunks in order, those that have been fed included; one name a chunk comes to the driver."""
        found = {
            (int(b.partition("=")[2]), int(c.partition("=")[2]))
            for b in C.names(self.spark, self.spool) if b.startswith("batch_id=")
            for c in C.names(self.spark, f"{self.spool}/{b}") if c.startswith("chunk=")
        }
        for folder in (self.released, self.done):
            fed = [x.partition("=")[2].split("-") for x in C.names(self.spark, folder)]
            found |= {(int(batch_id), int(chunk)) for batch_id, chunk in fed}
        return sorted(found)

    def stream(self) -> DataFrame:
        """Released payloads: ``data`` and its ``place`` in its intake."""
        return self.spark.readStream.schema("data string, place long").parquet(f"{self.released}/*")

    def feed(self, start: Callable[[DataFrame], StreamingQuery]) -> int:
        """Starts a query over the stream and releases all chunks to it in order; gives their
        number. A chunk that an earlier call has released is not released again."""
        chunks = self.waiting()
        fed = set(C.names(self.spark, self.done))
        query = start(self.stream())
        try:
            for batch_id, chunk in chunks:
                name = f"batch={batch_id}-{chunk}"
                if name in fed:
                    continue
                if not C.exists(self.spark, f"{self.released}/{name}"):
                    C.move(self.spark, f"{self.spool}/batch_id={batch_id}/chunk={chunk}", f"{self.released}/{name}")
                query.processAllAvailable()
                # what is taken is in the query's log: it is read no more
                C.move(self.spark, f"{self.released}/{name}", f"{self.done}/{name}")
        finally:
            query.stop()
        if query.exception() is not None:
            raise query.exception()
        return len(chunks)
