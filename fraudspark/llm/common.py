"""Helpers of the corpus operators: Arrow text slices, words and their hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.sources.staging import stage

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SLICE_BYTES = 500_000
LONG_WORD = 1 << 12
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are wide rows: batches of Spark's default 10,000 are made smaller, others kept."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "256")


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``key`` (a unique long in the order of ids), ``id`` and ``text``; and whether keys are not
    the ids themselves. Ids that are null, repeated or no integers are numbered in order of id and
    text, null first; the numbered rows are written, so that a rerun cannot number them anew."""
    ids = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    whole_numbers = dict(ids.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    if whole_numbers and not (
        ids.groupBy("id").count().where("id IS NULL OR count > 1").limit(1).count()
    ):
        return ids.withColumn("key", F.col("id").cast("long")), False
    order = [F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = ids.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.withColumn("key", F.monotonically_increasing_id()), "keyed"), True


@dataclass
class Slice:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each text starts and ends."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a column of texts into runs of rows of about ``limit`` bytes; a longer text is a slice
    of its own. Null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def _table(inside: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in inside:
        t[a : b + 1] = True
    return t


#: Bytes of words: all but blanks; and letters, digits and whatever is not ASCII.
NOT_BLANK = ~_table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


#: A number for each byte at each place of a word. Sums of them have no structure in the letters,
#: which powers of one base modulo 2^64 do.
_PLACED = mix64(mix64(np.arange(1, 256 * LONG_WORD + 1, dtype=U64) * U64(_P)) ^ U64(_Q))


@dataclass
class Words:
    """Words of a slice in order: byte bounds, a 64-bit hash, and each text's first word (one
    bound more than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words(s: Slice, member: np.ndarray = NOT_BLANK, lower: bool = False) -> Words:
    data = LOWER[s.data] if lower else s.data
    n = len(data)
    m = np.zeros(n + 2, bool)
    m[1:-1] = member[data]
    edge = np.zeros(n + 1, bool)
    edge[s.at] = True
    start = np.flatnonzero(m[1:-1] & (~m[:-2] | edge[:-1]))
    end = np.flatnonzero(m[1:-1] & (~m[2:] | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, s.at), _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    out = np.empty(len(start), U64)
    size = end - start
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(data) + step, step)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = start[lo], end[hi - 1]
        inner = np.arange(a, b) - np.repeat(start[lo:hi], np.diff(np.append(start[lo:hi], b)))
        kept = inner < np.repeat(size[lo:hi], np.diff(np.append(start[lo:hi], b)))
        v = _PLACED[np.minimum(inner, LONG_WORD - 1) * 256 + data[a:b]] * kept
        out[lo:hi] = np.add.reduceat(v, start[lo:hi] - a)
    out = mix64(out + size.astype(U64) * U64(_Q))
    for i in np.flatnonzero(size >= LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` hashes in a row, one for each start that has them: of runs of 1, 2,
    4, ... hashes, two at a time, mixed at each step."""
    if len(h) < k:
        return np.zeros(0, U64)
    size, part, done, out = 1, h, 0, None
    n = len(h) - k + 1
    for bit in bin(k)[:1:-1]:
        if bit == "1":
            piece = part[done : done + n]
            out = piece if out is None else mix64(out * U64(_Q) + piece)
            done += size
        if done < k:
            part = mix64(part[: len(part) - size] * U64(_P) + part[size:])
            size *= 2
    return mix64(out + U64(k))


def whole(w: Words, k: int) -> np.ndarray:
    """Starts of runs of ``k`` words that lie in one text."""
    n = len(w.start) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    doc = w.doc()
    return np.flatnonzero(doc[:n] == doc[k - 1 :])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: Keys that a broadcast may hold: 8 bytes each, and what a hash table adds.
KEYS = 500_000


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """The rows with a unique long key: their id where ids are integers, not null and unique, else
    a number written with the rows. Gives the key's name, which no column has."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    whole_numbers = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    if whole_numbers:
        odd = docs.groupBy(docs[id_col].alias("i")).agg(F.count("*").alias("c"))
        if not odd.where("i IS NULL OR c > 1").limit(1).count():
            return docs.withColumn(key, docs[id_col].cast("long")), key
    order = [F.col(id_col).asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def picked(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """A join by key that leaves wide rows where they are while the (written) keys are few, and
    shuffles them otherwise."""
    return rows.join(F.broadcast(keys) if keys.count() <= KEYS else keys, key, how)
