"""Whitening of embeddings: each distinct vector is worked on once, weighted by its copies.

Vectors are put on an integer grid, so equal ones are equal exactly and sums are exact. Identical
vectors become one row with a count. Tasks add up weighted, centred products of their rows (one
matrix product a batch); the sums of a matrix row meet in one group, and only the finished matrix,
whose size is set by the dimension, comes to the driver for its eigenvectors. Every distinct
vector is projected once, and rows get the result back by the digest of their vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage

#: Fixed values of the grid: steps a unit, and what is added.
STEPS, ZERO = 64, 1_000_000
#: Grid values lie in plus or minus this; entries beyond are held there.
BOUND = 1 << 40
LONG = (1 << 63) - 1
#: A vector with more than one of so many rows is joined by broadcast: there are fewer such vectors
#: than this, whatever the input.
HOT_SHARE = 1000


def on_grid(entry: Column) -> Column:
    scaled = F.floor(F.greatest(F.least(entry.cast("double") * STEPS, F.lit(float(BOUND))), F.lit(-float(BOUND))))
    return scaled.cast("long") + ZERO


def grid_vectors(rows: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """``id``, ``x`` and its digest, of rows whose vector is whole: not null, no entry null or not
    finite, and as long as most vectors are (of equal counts the longer)."""
    v = F.col("v")
    good = v.isNotNull() & F.forall(
        v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    )
    named = rows.select(rows[id_col].alias("id"), rows[vec_col].alias("v"))
    kept = named.where(F.coalesce(good, F.lit(False)) & (F.size("v") > 0))
    sizes = kept.groupBy(F.size("v").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    kept = kept.where(F.size("v") == (most[0]["d"] if most else 0))
    x = kept.select("id", F.transform("v", on_grid).alias("x"))
    return x.withColumn("digest", F.unhex(F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)))


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind or flat.dtype, copy=False).reshape(len(column), len(flat) // max(len(column), 1))


class Centre:
    """Number of vectors and sum of each entry; gives ``n*x-S``, in plain integers when those pass
    a long."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.limit = LONG // (2 * max(n, 1))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        if (len(x) and np.abs(x).max() > self.limit) or max(map(abs, self.sums)) > LONG // 2:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * np.int64(self.n) - np.array(self.sums, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of squares of ``n*x-S``; null where a long cannot hold it."""
        z = self.scaled(x)
        if z.dtype == object or (len(z) and int(np.abs(z).max()) ** 2 * z.shape[1] > LONG):
            z = z.astype(object)
        return [s if s <= LONG else None for s in map(int, (z * z).sum(axis=1))]


def _sums(distinct: DataFrame, dimension: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for b in batches:
            x, w = _matrix(b.column("x")), b.column("n").to_numpy()
            whole = int(w.sum()) * (BOUND + ZERO) > LONG
            part = (x.astype(object) if whole else x) * w[:, None]
            n += int(w.sum())
            total = [a + int(s) for a, s in zip(total, part.sum(axis=0), strict=True)]
        values = [n, *total]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int32()), pa.array(map(str, values), pa.string())], names=["i", "s"]
        )

    parts = distinct.select("x", "n").mapInArrow(run, "i int, s string")
    sums = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    found = [int(r["s"]) for r in sums]
    return Centre(found[0], found[1:])


def weighted_products(rows: DataFrame, vector: str, centred, dimension: int) -> np.ndarray:
    """Sum over rows of ``n`` times the outer product of a centred vector with itself. ``centred``
    makes an array of doubles of a matrix of vectors. Sums of a task are added by row of the
    matrix in the order of tasks, so a rerun gives the same bits for the same partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((dimension, dimension))
        for b in batches:
            z = centred(_matrix(b.column(vector), None))
            total += (z * b.column("n").to_numpy()[:, None]).T @ z
        task = np.full(dimension, TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dimension, dtype=np.int32)), pa.array(task), _rows(total)],
            names=["i", "task", "part"],
        )

    def add(group: pa.Table) -> pa.Table:
        parts = _matrix(group.sort_by("task").column("part").combine_chunks(), np.float64)
        total = np.zeros(dimension)
        for p in parts:
            total += p
        return pa.table({"i": group.column("i").slice(0, 1), "row": _rows(total[None, :])})

    parts = rows.select(vector, "n").mapInArrow(run, "i int, task int, part array<double>")
    summed = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").orderBy("i").collect()
    return np.array([r["row"] for r in summed])


def _rows(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(matrix.ravel()))


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest entry
    positive. Values that are zero to double precision are given as 0."""
    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    floor = max(value[0], 0) * len(covariance) * np.finfo(float).eps
    vector = vector * np.where(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])] < 0, -1, 1)
    return np.where(value > floor, value, 0.0), vector


def _no_rows(rows: DataFrame, id_col: str) -> DataFrame:
    kind = dict(rows.dtypes)[id_col]
    return rows.sparkSession.createDataFrame(
        [], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def whiten(
    rows: DataFrame, components: int = 32, vec_col: str = "embedding", id_col: str = "vec_id"
) -> DataFrame:
    """For each row and component: the number of vectors, the row's exact squared distance from
    their mean (times n squared), its whitened value, the component's share of all variance, and
    the largest entry by which the covariance of the whitened values departs from the identity.

    Rows whose vector is null, empty, of another length than most vectors, or holds null or
    non-finite entries are left out; the others count each, repeated rows and ids included. An
    entry whose grid value would pass 2^40 is held there. A component without variance has
    ``whitened`` null and is not in ``identity_error``; where there is no variance at all,
    ``explained`` is null. Equal eigenvalues keep the order of the solver, the same for all rows.
    A deviation that a long cannot hold is null. No vectors give no rows. Other columns are not
    read. The matrices have the size of the dimension; a vector that many rows share is one row
    until the end.
    """
    vectors = grid_vectors(rows, vec_col, id_col)
    distinct = vectors.groupBy("digest", "x").agg(F.count("*").alias("n"))
    distinct = stage(distinct, "whitening-distinct")
    first = distinct.select(F.size("x").alias("d")).limit(1).collect()
    if not first:
        return _no_rows(rows, id_col)
    d = first[0]["d"]
    centre = _sums(distinct, d)
    n = centre.n
    covariance = weighted_products(distinct, "x", centre.centred, d) / n
    value, vector = components_of(covariance, min(components, d))
    trace = float(np.trace(covariance))
    kept = np.flatnonzero(value > 0)
    project = vector[:, kept] / np.sqrt(value[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"))
            white = _rows(centre.centred(x) @ project) if len(kept) else pa.array([[]] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), b.column("n"), pa.array(centre.deviations(x), pa.int64()), white],
                names=["digest", "n", "deviation", "white"],
            )

    white = distinct.mapInArrow(run, "digest binary, n long, deviation long, white array<double>")
    white = stage(white, "whitening-vectors")
    error = _identity_error(white, n, len(kept))
    out = _joined(vectors.select("id", "digest"), white, n)
    values = F.concat("white", F.array_repeat(F.lit(None).cast("double"), F.lit(len(value) - len(kept))))
    share = F.array(*[F.lit(float(e / trace) if trace > 0 else None).cast("double") for e in value])
    out = out.select(
        F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", F.posexplode(values).alias("at", "whitened")
    )
    return out.select(
        id_col,
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _identity_error(white: DataFrame, n: int, size: int) -> float:
    """Measured on the values that are returned, centred by their own mean."""
    if not size:
        return 0.0
    sums = white.agg(*[F.sum(F.col("n") * F.col("white")[i]).alias(f"s{i}") for i in range(size)]).first()
    mean = np.array(sums) / n
    covariance = weighted_products(white, "white", lambda w: w - mean, size) / n
    return float(np.abs(covariance - np.eye(size)).max())


def _joined(rows: DataFrame, white: DataFrame, n: int) -> DataFrame:
    """Rows with their vector's values. Vectors that hold over a thousandth of all rows are sent to
    the rows, the others meet theirs by digest."""
    hot = white.where(F.col("n") * HOT_SHARE > n)
    cold = white.where(F.col("n") * HOT_SHARE <= n).drop("n")
    keys = F.broadcast(hot.select("digest"))
    few = rows.join(keys, "digest", "left_anti").join(cold, "digest")
    many = rows.join(F.broadcast(hot.drop("n")), "digest")
    names = ["id", "deviation", "white"]
    return few.select(*names).unionByName(many.select(*names))
