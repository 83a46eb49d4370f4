"""Facts of a key strictly before any time, for many (key, time) points at once.

Points and events are put on one line per key, ordered by time, and dealt by ranges of that order,
so a hot key lies in many tasks. Running sums start anew in each part and take what earlier parts
of the key hold from a small table. A point's sums are its facts: no row meets another row.

Medians need order statistics: the k-th smallest of a key's first n values. They are answered from
a tree over the values whose nodes keep their rows in time order. A node's rows are cut into blocks;
a block holds the child of each of its rows and how many rows of the node before it went to each
child. A query meets one block per level, learns which child has its answer, and how many of that
child's rows come before it. Children are cut at the node's own quantiles, and a value that is a
quantile has a child of its own, so that nodes shrink whatever the values are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage

#: Values of a node that one task sorts, children's quantiles of a larger one, rows of a block.
LEAF, FAN, BLOCK = 4096, 64, 1024
POINT, EVENT = 0, 1


class Timeline:
    """Points and events in order. ``points``: ``key`` and ``at``, repeated points count once.
    ``events``: ``key``, ``at``, the summed columns and, if medians are asked for, ``value``.
    Null keys are no keys: points with one get no facts."""

    def __init__(self, points: DataFrame, events: DataFrame, sums: list[str]):
        self.sums = sums
        asked = points.where("key IS NOT NULL AND at IS NOT NULL").select("key", "at").distinct()
        rows = events.where("key IS NOT NULL AND at IS NOT NULL").withColumn("kind", F.lit(EVENT))
        both = asked.withColumn("kind", F.lit(POINT)).unionByName(rows, allowMissingColumns=True)
        both = both.fillna(0, sums).withColumn("tie", F.monotonically_increasing_id())
        order = ["key", "at", "kind", "tie"]
        dealt = both.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
        self.rows = stage(dealt, "timeline")

    def _carried(self) -> DataFrame:
        """What the parts of a key before each part hold; as many rows as keys and parts."""
        before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = self.rows.groupBy("key", "part").agg(*[F.sum(s).alias(s) for s in self.sums])
        return parts.select(
            "key",
            "part",
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_carried") for s in self.sums],
            *[F.sum(s).over(Window.partitionBy("key")).alias(f"{s}_all") for s in self.sums],
        )

    def _running(self) -> DataFrame:
        """Each row with the sums of all events before it."""
        inside = Window.partitionBy("key", "part").orderBy("at", "kind", "tie")
        before = inside.rowsBetween(Window.unboundedPreceding, -1)
        own = self.rows.withColumns({f"{s}_in": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in self.sums})
        return own.join(self._carried(), ["key", "part"]).withColumns(
            {f"{s}_before": F.col(f"{s}_in") + F.col(f"{s}_carried") for s in self.sums}
        )

    def totals(self) -> DataFrame:
        """``key``, ``at``, and of each sum ``<name>`` before the point and ``<name>_all``."""
        points = self._running().where(F.col("kind") == POINT)
        return points.select(
            "key", "at", *[F.col(f"{s}_before").alias(s) for s in self.sums], *[f"{s}_all" for s in self.sums]
        )

    def values(self, counted: str) -> DataFrame:
        """``node``, ``pos`` and ``value`` of the events that add 1 to ``counted``: their place
        among these events of their key."""
        rows = self._running().where((F.col("kind") == EVENT) & (F.col(counted) == 1))
        return rows.select(F.col("key").alias("node"), F.col(f"{counted}_before").alias("pos"), "value")


def order_statistics(
    values: DataFrame, queries: DataFrame, leaf: int = LEAF, fan: int = FAN, block: int = BLOCK
) -> DataFrame:
    """``queries`` (``node``, ``n``, ``k``, 0 <= k < n) with ``value``: the k-th smallest, from 0,
    of the first ``n`` values of the node by ``pos`` (0, 1, ... without gaps). Equal queries count
    once. A node of any size is spread over tasks; the number of rounds grows with the logarithm of
    the largest one."""
    rows = values.select(F.col("node").cast("string").alias("node"), F.col("pos").cast("long").alias("pos"), "value")
    asked = queries.select(F.col("node").cast("string").alias("node"), "n", "k").distinct()
    asked = asked.select(*[F.col(c).alias(f"asked_{c}") for c in ("node", "n", "k")], "node", "n", "k")
    found, level = [], 0
    while True:
        value = F.col("value")
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        sizes = stage(sizes, "order-sizes")
        constant, large = F.col("lo") == F.col("hi"), F.col("size") > leaf
        found.append(asked.join(sizes.where(constant).select("node", F.col("lo").alias("value")), "node"))
        small = rows.join(sizes.where(~constant & ~large).select("node"), "node", "left_semi")
        found.append(_in_leaves(small, asked))
        big = sizes.where(~constant & large).select("node", "size")
        if not big.limit(1).count():
            break
        rows, asked = _one_level_down(rows, asked, big, fan, block, level)
        level += 1
    out = found[0].select("asked_node", "asked_n", "asked_k", "value")
    for f in found[1:]:
        out = out.unionByName(f.select(*out.columns))
    return out.select(*[F.col(f"asked_{c}").alias(c) for c in ("node", "n", "k")], "value")


def _in_leaves(rows: DataFrame, asked: DataFrame) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    leaves = rows.groupBy("node").agg(listed.alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = b.column("n").to_pylist(), b.column("k").to_pylist()
            lists = b.column("values")
            out = [np.partition(lists[i].values.to_numpy()[: n[i]], k[i])[k[i]] for i in range(len(n))]
            names = ["asked_node", "asked_n", "asked_k"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(out, pa.float64())], names=[*names, "value"]
            )

    met = asked.join(leaves, "node").select("asked_node", "asked_n", "asked_k", "n", "k", "values")
    return met.mapInArrow(run, "asked_node string, asked_n long, asked_k long, value double")


def _one_level_down(
    rows: DataFrame, asked: DataFrame, big: DataFrame, fan: int, block: int, level: int
) -> tuple[DataFrame, DataFrame]:
    kids = 2 * fan + 1
    cuts = [i / fan for i in range(1, fan)]
    mine = rows.join(big.select("node"), "node", "left_semi")
    splits = mine.groupBy("node").agg(
        F.array_sort(F.array_distinct(F.percentile_approx("value", cuts, fan * 100))).alias("splits")
    )
    blocks = mine.groupBy("node", F.expr(f"pos div {block}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("rows")
    )
    blocks = blocks.select("node", "block", F.col("rows.value").alias("values")).join(splits, "node")

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            child, count = [], []
            for values, s in zip(b.column("values"), b.column("splits"), strict=True):
                v, s = values.values.to_numpy(), s.values.to_numpy()
                left = np.searchsorted(s, v, "left")
                c = (2 * left + (np.searchsorted(s, v, "right") > left)).astype(np.int32)
                child.append(c)
                count.append(np.bincount(c, minlength=kids))
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("block"), b.column("values")]
                + [pa.array(child, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int64()))],
                names=["node", "block", "values", "child", "count"],
            )

    kinds = "node string, block long, values array<double>, child array<int>, count array<long>"
    blocks = stage(blocks.mapInArrow(children, kinds), f"order-blocks-{level}")
    # per child, what the node's earlier blocks sent to it; a window holds one child of one node
    before = Window.partitionBy("node", "c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.select("node", "block", F.posexplode("count").alias("c", "m"))
    running = counts.select("node", "block", "c", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"))
    sent = running.groupBy("node", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("c", "m"))), lambda x: x["m"]).alias("sent")
    )
    blocks = stage(blocks.drop("count").join(sent, ["node", "block"]), f"order-tree-{level}")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                child = b.column("child")[i].values.to_numpy()
                start = b.column("sent")[i].values.to_numpy()
                order = np.argsort(child, kind="stable")
                first = np.searchsorted(child[order], np.arange(kids))
                pos = np.empty(len(child), np.int64)
                pos[order] = np.arange(len(child)) - first[child[order]]
                node = b.column("node")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{node}/{c}" for c in child.tolist()], pa.string()),
                        pa.array(pos + start[child]),
                        b.column("values")[i].values,
                    ],
                    names=["node", "pos", "value"],
                )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, k = [], [], []
            for i in range(b.num_rows):
                rest = b.column("n")[i].as_py() - block * b.column("block")[i].as_py()
                child = b.column("child")[i].values.to_numpy()[:rest]
                have = b.column("sent")[i].values.to_numpy() + np.bincount(child, minlength=kids)
                upto, at = np.cumsum(have), b.column("k")[i].as_py()
                c = int(np.searchsorted(upto, at, "right"))
                node.append(f"{b.column('node')[i].as_py()}/{c}")
                n.append(int(have[c]))
                k.append(at - int(upto[c] - have[c]))
            names = ["asked_node", "asked_n", "asked_k"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(node, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64())],
                names=[*names, "node", "n", "k"],
            )

    below = blocks.mapInArrow(down, "node string, pos long, value double")
    placed = asked.join(big, "node").withColumn("block", F.expr(f"least(n div {block}, (size - 1) div {block})"))
    met = placed.join(blocks.select("node", "block", "child", "sent"), ["node", "block"])
    kinds = "asked_node string, asked_n long, asked_k long, node string, n long, k long"
    return stage(below, f"order-rows-{level}"), stage(met.mapInArrow(choose, kinds), f"order-queries-{level}")


def medians(values: DataFrame, prefixes: DataFrame, **settings: int) -> DataFrame:
    """``node``, ``n`` and ``median`` of a node's first ``n`` values, for each distinct prefix with
    n > 0; of an even number it is the mean of the two in the middle."""
    asked = prefixes.where("n > 0").select(F.col("node").cast("string").alias("node"), F.col("n").cast("long").alias("n"))
    k = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    found = order_statistics(values, asked.distinct().withColumn("k", F.explode(k)), **settings)
    return found.groupBy("node", "n").agg(F.avg("value").alias("median"))


def earliest(rows: DataFrame, by: list[str], time: str) -> DataFrame:
    """The first time of each combination, which is when it adds to a distinct count."""
    return rows.groupBy(*by).agg(F.min(time).alias(time))


def bound(time: Column, cutoff: Column) -> Column:
    """Facts that come from labels are known up to the event or the cutoff, what is earlier."""
    return F.least(time, cutoff)
