"""Mixing sources to target weights: equal-token blocks by highest quotients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS = 1 << 20
#: Primes over any number of blocks; a source's seed picks one as its stride.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the sum of all
    sizes. A target stops at ``most`` times its source's size; what is over is shared again by
    weight. The fixed point is a water level: sources in order of cap over weight are capped until
    the level of the rest lies under the next one's ratio.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = sizes.withColumn("rank", rank).withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    w = w.withColumn("cap", (most * F.col("source_size")).cast("double"))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    taken = F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))
    weight = F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    w = w.withColumn("total", F.sum("source_size").over(everything))
    w = w.withColumn(
        "level", (F.col("total") - taken) / (F.sum("weight").over(everything) - weight)
    )
    level = F.min_by(
        F.when(F.col("level") <= F.col("ratio"), F.col("level")),
        F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank")),
    ).over(everything)
    return w.withColumn("water", level).select(
        "source",
        "source_size",
        F.col("total").alias("total"),
        F.when(F.col("water").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
        .alias("target"),
    )


def block_quotas(goal: DataFrame, blocks: int = BLOCKS, most: int = 3) -> DataFrame:
    """Adds ``block`` (words), ``n_blocks`` and ``quota`` (blocks to take) to each target.

    Sainte-Laguë: seats go to the highest target / (2 k + 1). A quota differs from its share by
    at most half a seat and its part of half as many seats as there are sources; only quotients
    in that band are listed, at most four a source on average, and the best of them seated.
    """
    one = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = goal.withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("total") / blocks)).cast("long"))
    g = g.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    g = g.withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long"))
    part = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    slack = part * F.count("*").over(one) / 2 + 1
    g = g.withColumn("sure", F.greatest(F.lit(0), F.floor(part * F.col("seats") - slack)).cast("long"))
    g = g.withColumn("upto", F.ceil(part * F.col("seats") + slack).cast("long"))
    g = g.withColumn("left", F.col("seats") - F.sum("sure").over(one))
    seats = g.where("target > 0").select(
        "source", "left", "target", F.explode(F.sequence("sure", "upto")).alias("k")
    )
    best = Window.orderBy(
        (F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last()
    )
    more = (
        seats.withColumn("place", F.row_number().over(best))
        .where("place <= left")
        .groupBy(F.col("source").alias("s"))
        .agg(F.count("*").alias("more"))
    )
    quota = F.col("sure") + F.coalesce(F.col("more"), F.lit(0))
    return g.join(more, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source",
        "source_size",
        "target",
        "block",
        "n_blocks",
        F.least(quota, most * F.col("n_blocks")).alias("quota"),
    )


def shard_quotas(quotas: DataFrame, shards: int = 16) -> DataFrame:
    """Splits each source's quota over shards, at most one block apart."""
    upto = lambda k: F.floor(k * F.col("quota") / F.lit(shards))
    return quotas.select(
        "source", "quota", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    ).select("source", "shard", (upto(F.col("shard") + 1) - upto(F.col("shard"))).alias("quota"))


def _copies(seed: int) -> Column:
    """How often block ``j`` is taken: whole rounds of all blocks, and one more for as many as are
    left, which a seeded stride through the blocks picks; the stride is prime, so it meets each
    block once."""
    h = F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull(), F.lit(seed))
    stride = F.element_at(F.array(*map(F.lit, STRIDES)), (F.pmod(h, F.lit(len(STRIDES))) + 1).cast("int"))
    return F.struct(
        F.pmod(stride, F.greatest("n_blocks", F.lit(1))).cast("long").alias("stride"),
        F.pmod(F.shiftright(h, 8), F.greatest("n_blocks", F.lit(1))).cast("long").alias("shift"),
    )


def mix(
    docs: DataFrame,
    blocks: int = BLOCKS,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Words that the mix takes from each document.

    The texts of a source, in a seeded order, are one sequence of words, cut into blocks of equal
    length (about ``blocks`` over all sources). Quotas come from ``block_quotas``; a document's
    ``taken`` is the sum over the blocks that meet it. A source without a name is one source,
    sorted last. Texts without words, or null, take 0. Rows that repeat an id stay rows of their
    own. No rows give no rows; other columns are not read.

    Sizes are counted once and written narrow. A document's place in its source is a bucket's
    start plus a sum inside the bucket: with the square root of the rows as buckets, neither the
    rows of a bucket nor the buckets of a source grow beyond that root. Per source there is one
    small row.
    """
    sized = stage(
        docs.select(
            docs[id_col].alias("id"),
            docs[source_col].cast("string").alias("source"),
            word_count(docs[text_col]).alias("size"),
        ),
        "mix-sizes",
    )
    n = max(1, int(sized.count() ** 0.5))
    order = F.xxhash64("id", F.lit(seed))
    sized = sized.withColumn("r", order).withColumn(
        "bucket", (F.shiftrightunsigned("r", 33) * n / (1 << 31)).cast("int")
    )
    key = ["source", "bucket"]
    buckets = sized.groupBy(*key).agg(F.sum("size").alias("bucket_size"))
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(
        F.col("source").alias("s"),
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)).alias("start"),
    )
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    plan = block_quotas(targets(sizes), blocks).withColumn("pick", _copies(seed))
    starts = starts.join(plan, starts.s.eqNullSafe(plan.source)).drop("source")
    in_bucket = Window.partitionBy(*key).orderBy("r", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    joined = placed.join(
        starts, placed.source.eqNullSafe(starts.s) & (placed.bucket == starts.b)
    ).withColumn("at", F.col("start") + F.col("inner"))
    taken = F.expr(
        """CASE WHEN size = 0 THEN 0L ELSE aggregate(
             sequence(at div block, (at + size - 1) div block), 0L,
             (acc, j) -> acc
               + (least(at + size, (j + 1) * block) - greatest(at, j * block))
               * (quota div n_blocks + CASE
                    WHEN (j * pick.stride + pick.shift) % n_blocks < quota % n_blocks
                    THEN 1 ELSE 0 END)) END"""
    )
    return joined.select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken")
    )
