"""Nearest vectors by cosine similarity: exact in blocks, and by an inverted-file index.

Vectors are dealt as blocks, matrices of some thousand rows. A block of queries meets a block of
the bank in one matrix product, and only the best k per query and block leave the task; Spark cuts
them to k per query before and after the shuffle. Nothing of a bank goes to the driver or to all
tasks.

The index puts every row into the list of its nearest centroid. Centroids are fitted on a bounded
sample; lists that hold many rows are cut into salted parts, so that a list with a third of all
rows is many blocks in many tasks. A query reads the lists of its nearest centroids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage

#: Rows of a block, of a salted part of a list, and of the queries that meet a part in one task.
BLOCK, PART, SHARE = 2048, 32_768, 16_384
#: Rows that centroids are fitted on, lists at most, rounds of the fit.
SAMPLE, MAX_LISTS, ROUNDS = 20_000, 2048, 12
#: Rows whose true neighbours set the number of lists to read, and the share of them to find.
TRIALS, TARGET = 200, 0.95
DIGITS = 9


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec``, a vector of length 1 (a zero vector stays zero). Rows whose vector is
    null, empty, or holds null or non-finite entries have no neighbours and are left out."""
    v = F.transform(rows[vec_col], lambda e: e.cast("double"))
    good = F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf"))))
    kept = rows.select(rows[id_col].alias("id"), v.alias("v")).where(F.size("v") > 0).where(good)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    scaled = F.when(norm > 0, F.transform("v", lambda e: e / norm)).otherwise(F.col("v"))
    return kept.withColumn("norm", norm).select("id", scaled.alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (``keys``, id, vec) as blocks: the keys, the ids, and the matrix as one flat array.
    Rows of equal keys must lie together in a partition."""
    kind = dict(rows.dtypes)["id"]
    key_kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, count, fields = None, [], 0, None

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            flat = table.column("vec").combine_chunks().flatten()
            ids = table.column("id").combine_chunks()
            firsts = [table.column(k).combine_chunks().slice(0, 1) for k in keys]
            nested = [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
            ]
            return pa.RecordBatch.from_arrays([*firsts, *nested], names=[*keys, "ids", "matrix"])

        for b in batches:
            lists = list(zip(*[b.column(k).to_pylist() for k in keys], strict=True))
            cuts = [0, *[i for i in range(1, len(lists)) if lists[i] != lists[i - 1]], len(lists)]
            for lo, hi in pairwise(cuts):
                while lo < hi:
                    if held and (lists[lo] != key or count >= BLOCK):
                        yield close()
                        held, count = [], 0
                    key, take = lists[lo], min(hi - lo, BLOCK - count)
                    held.append(b.slice(lo, take))
                    lo, count = lo + take, count + take
        if held:
            yield close()

    return rows.select(*keys, "id", "vec").mapInArrow(run, f"{key_kinds}, ids array<{kind}>, matrix array<double>")


def _best(pairs: DataFrame, k: int, kind: str, bank_kind: str, skip_self: bool) -> DataFrame:
    """The k best of each query in each pair of blocks, then over all. Similarities are compared at
    nine decimals, equal ones by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                query, bank = (b.column(c)[i].values for c in ("q_ids", "ids"))
                q = b.column("q_matrix")[i].values.to_numpy().reshape(len(query), -1)
                m = b.column("matrix")[i].values.to_numpy().reshape(len(bank), -1)
                if q.shape[1] != m.shape[1]:
                    continue
                names = np.array(bank.to_pylist())
                order = np.argsort(names, kind="stable")
                sims = np.round(q @ m[order].T, DIGITS)
                if skip_self:
                    sims[np.array(query.to_pylist())[:, None] == names[order][None, :]] = -np.inf
                top = min(k, len(bank))
                # the k-th best similarity of each query; all above it, and of equals the least ids
                edge = -np.partition(-sims, top - 1, axis=1)[:, top - 1 : top]
                rows, columns = np.nonzero(sims >= edge)
                value = sims[rows, columns]
                best = np.lexsort((columns, -value, rows))
                rows, columns, value = rows[best], columns[best], value[best]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                keep = (place < top) & np.isfinite(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        query.take(pa.array(rows[keep])),
                        bank.take(pa.array(order[columns[keep]])),
                        pa.array(value[keep]),
                    ],
                    names=["id", "neighbour", "similarity"],
                )

    found = pairs.select("q_ids", "q_matrix", "ids", "matrix").mapInArrow(
        run, f"id {kind}, neighbour {bank_kind}, similarity double"
    )
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def _parts(df: DataFrame, count: int) -> DataFrame:
    """Rows dealt evenly over numbered parts."""
    return df.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return _blocks(rows.repartition(*keys).sortWithinPartitions(*keys), keys)


def _named(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})


def exact_neighbours(queries: DataFrame, bank: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """``id``, ``neighbour``, ``similarity`` and ``place`` (1 to k) over the whole bank. Both sides
    are ``id`` and ``vec`` of length 1; ids of a side are not null and unique. The bank is dealt
    into parts once and queries are sent to every part, as blocks; many queries are cut into shares,
    and a part meets each share in a task of its own."""
    if k < 1:
        raise ValueError("k must be at least 1")
    count = max(1, -(-bank.count() // PART))
    every = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    shares = max(1, -(-queries.count() // SHARE))
    share = F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    asked = queries.select("id", "vec", share.alias("share"), every.alias("part"))
    asked = _dealt(asked, ["part", "share"])
    parts = _dealt(_parts(bank, count), ["part"]).withColumn("share", each)
    pairs = parts.join(_named(asked), ["part", "share"])
    return _best(pairs, k, dict(queries.dtypes)["id"], dict(bank.dtypes)["id"], skip_self)


@dataclass(frozen=True)
class Index:
    """An inverted file: centroids (bounded), and every row in a block of its list, staged."""

    centroids: np.ndarray
    blocks: DataFrame
    parts: DataFrame
    rows: DataFrame
    id_kind: str


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means from distinct sample rows; an empty list takes the row that is furthest
    from its centroid."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.permutation(len(sample))[:lists])]
    for _ in range(ROUNDS):
        sims = sample @ centres.T
        home = sims.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        empty = np.setdiff1d(np.arange(len(centres)), home)
        sums[empty] = sample[np.argsort(sims.max(axis=1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, norm, out=centres.copy(), where=norm > 0)
    return centres


def build_index(bank: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 0) -> Index:
    """Indexes every row of ``bank`` (``id``, ``vec``). Centroids are fitted on the ``sample`` rows
    with the least hash of their id; there are the square root of the rows of lists, 2,048 at most,
    unless ``lists`` is given."""
    n = bank.count()
    order = F.xxhash64(F.col("id"), F.lit(seed))
    chosen = bank.orderBy(order, "id").limit(sample).select("vec").collect()
    if not chosen:
        nothing = bank.sparkSession.createDataFrame([], "list int, part int, parts int")
        return Index(np.zeros((0, 0)), nothing, nothing, bank.limit(0), dict(bank.dtypes)["id"])
    wanted = lists or min(MAX_LISTS, max(1, round(n**0.5)))
    centroids = fit_centroids(np.array([r["vec"] for r in chosen]), wanted, seed)
    placed = stage(_nearest_lists(bank, centroids, 1), "index-rows")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sizes = stage(sizes, "index-lists")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    salted = placed.join(F.broadcast(sizes), "list").withColumn("part", part)
    blocks = stage(_dealt(salted, ["list", "part"]), "index-blocks")
    return Index(centroids, blocks, sizes, placed, dict(bank.dtypes)["id"])


def probes_for(index: Index, k: int, target: float = TARGET, trials: int = TRIALS, seed: int = 1) -> int:
    """How many lists a query must read so that ``target`` of its ``k`` true neighbours are found,
    measured on the ``trials`` rows with the least hash of their id, against all rows. One row a
    trial and neighbour comes to the driver."""
    order = F.xxhash64(F.col("id"), F.lit(seed))
    asked = stage(index.rows.orderBy(order, "id").limit(trials).select("id", "vec"), "index-trials")
    truth = exact_neighbours(asked, index.rows.select("id", "vec"), k, skip_self=True)
    homes = index.rows.select(F.col("id").alias("neighbour"), "list")
    lists = truth.select("id", "neighbour").join(homes, "neighbour").select("id", "list").collect()
    if not lists:
        return 1
    vectors = {r["id"]: r["vec"] for r in asked.collect()}
    rank = {i: np.argsort(np.argsort(-(index.centroids @ np.array(v)), kind="stable")) for i, v in vectors.items()}
    needed = np.sort([rank[r["id"]][r["list"]] for r in lists])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def _nearest_lists(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows with each of their nearest ``probes`` lists."""
    most = min(probes, len(centroids))
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for b in batches:
            x = _matrix(b.column("vec"))
            if not len(x) or x.shape[1] != centres.shape[1]:
                continue
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most].astype(np.int32)
            again = pa.array(np.repeat(np.arange(len(x)), most))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(again), b.column("vec").take(again), pa.array(near.ravel())], names=["id", "vec", "list"]
            )

    kind = dict(rows.dtypes)["id"]
    return rows.select("id", "vec").mapInArrow(run, f"id {kind}, vec array<double>, list int")


def indexed_neighbours(index: Index, queries: DataFrame, k: int, probes: int, skip_self: bool = False) -> DataFrame:
    """Like :func:`exact_neighbours`, over the ``probes`` lists nearest to each query; with as many
    probes as lists it is exact. :func:`probes_for` gives the number for a recall."""
    if k < 1 or probes < 1:
        raise ValueError("k and probes must be at least 1")
    kind = dict(queries.dtypes)["id"]
    if not len(index.centroids):
        return queries.sparkSession.createDataFrame(
            [], f"id {kind}, neighbour {index.id_kind}, similarity double, place int"
        )
    asked = _nearest_lists(queries, index.centroids, probes).join(F.broadcast(index.parts), "list")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = index.blocks.join(_named(_dealt(asked, ["list", "part"])), ["list", "part"])
    return _best(pairs, k, kind, index.id_kind, skip_self)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of true neighbours that were found."""
    hits = truth.select("id", "neighbour").join(found.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count()
    return hits / max(1, truth.count())
