"""Contiguous shards of equal bytes from global prefix sums of per-partition totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column(1).to_numpy()
        upto = total + np.cumsum(size)
        n = len(size)
        cols = [*b.columns, pa.array(np.full(n, part, np.int32))]
        cols += [pa.array(np.arange(rows, rows + n)), pa.array(upto - size)]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "part", "rows_in", "bytes_in"])
        if n:
            rows, total = rows + n, int(upto[-1])


def byte_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Deals all rows into ``shards`` runs of the id order, cut where the running sum of sizes
    passes equal shares of the total.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1; it goes where its middle
    lies. Rows are sorted by id (null first), checksum and size; rows equal in all three are
    interchangeable. ``slot`` numbers the rows of a shard from 0. No rows give no rows. Other
    columns are not read.

    One range shuffle of narrow rows; only one total per partition and one row number per shard
    reach the driver. The sorted rows are written once, so that the totals and the shards come
    from the same cut into partitions, even after an executor is lost.
    """
    text = docs[text_col].cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    narrow = docs.select(docs[id_col].alias("id"), size.alias("size"), crc.alias("crc"))
    order = ["id", "crc", "size"]
    kind = dict(narrow.dtypes)["id"]
    ranged = stage(
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _running, f"id {kind}, size long, crc long, part int, rows_in long, bytes_in long"
        ),
        "byte-shards",
    )
    spark = docs.sparkSession
    totals = (
        ranged.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    )
    offsets, rows, total = [], 0, 0
    for t in sorted(totals, key=lambda t: t.part):
        offsets.append((t.part, rows, total))
        rows, total = rows + t.rows, total + t.bytes
    before = spark.createDataFrame(offsets, "part int, rows_before long, bytes_before long")
    placed = ranged.join(F.broadcast(before), "part").select(  # a row for each partition
        "id",
        "size",
        "crc",
        (F.col("rows_before") + F.col("rows_in")).alias("row"),
        F.expr(
            f"(2 * (bytes_before + bytes_in) + size) * {shards} div {2 * max(total, 1)}"
        ).cast("int").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # a row for each shard
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
