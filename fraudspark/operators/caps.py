"""Bounded known-sets, exactly: first in, first out.

An account remembers 50 devices and 300 merchants, a device 200 accounts. A set that
overflows forgets its oldest member, which then counts as new again. Below the cap the
window columns are exact. Keys that may overflow are found by a small bitmap per key and
confirmed by an exact count; only their (key, member, time) rows are replayed in order, with
memory for one set.

Whether a member is still known depends on every earlier eviction, so one key's replay cannot
run in parallel. A key with very many rows is replayed in slices, and the set is handed from
one slice to the next through a staged table: no task holds more than one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import exp, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.operators.skew import (
    DEFAULT,
    SkewPolicy,
    Split,
    chunked,
    find_hot,
    hot_split,
    key_sizes,
)
from fraudspark.schemas import (
    DEVICE_USERS_CAP,
    KNOWN_DEVICES_CAP,
    KNOWN_MERCHANTS_CAP,
)
from fraudspark.sources.staging import stage

REPLAY_ROWS = 5_000_000


@dataclass(frozen=True)
class KnownSet:
    key: str
    member: str
    cap: int
    first: str
    count: str


SETS = [
    KnownSet("user_id", "device_id", KNOWN_DEVICES_CAP, "user_device_first_ms", "user_devices"),
    KnownSet(
        "user_id", "merchant_id", KNOWN_MERCHANTS_CAP, "user_merchant_first_ms", "user_merchants"
    ),
    KnownSet("device_id", "user_id", DEVICE_USERS_CAP, "device_user_first_ms", "device_users"),
]

CARRIED, EVENT = 0, 1
REPLAY_SCHEMA = (
    "key string, member string, ts_ms bigint, txn_id string, kind int, known_ms bigint, size int"
)


def _replay(cap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key, carried members first, then events in time order."""
        key, known = None, {}

        def carry() -> list[tuple]:
            return [(key, m, t, x, CARRIED, t, 0) for m, (t, x) in known.items()]

        names = [f.split()[0] for f in REPLAY_SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for k, member, ts, txn, kind in zip(
                pdf["key"], pdf["member"], pdf["ts_ms"], pdf["txn_id"], pdf["kind"]
            ):
                if k != key:
                    out += carry()
                    key, known = k, {}
                since = known.get(member)
                if kind == EVENT:
                    size = len(known) + (since is None)
                    out.append((k, member, ts, txn, EVENT, since and since[0], size))
                if since is None:
                    known[member] = (ts, txn)
                    if len(known) > cap:
                        # Dicts keep insertion order: the first entry is the oldest.
                        del known[next(iter(known))]
            frame = pd.DataFrame(out, columns=names)
            frame["known_ms"] = frame["known_ms"].astype("Int64")
            yield frame
        if key is not None:
            frame = pd.DataFrame(carry(), columns=names)
            frame["known_ms"] = frame["known_ms"].astype("Int64")
            yield frame

    return run


def _rounds(
    txns: DataFrame, over: Overflow, s: KnownSet, replay_rows: int
) -> tuple[DataFrame, DataFrame]:
    """Replayed events of the keys, and the members each key knows after its last event."""
    policy = SkewPolicy(hot_rows=replay_rows, chunk_rows=replay_rows)
    rows = txns.select(s.key, s.member, "ts_ms", "txn_id").join(
        over.keys, s.key, "left_semi"
    )
    if over.largest > replay_rows:
        split = find_hot(rows, s.key, policy)
    else:
        split = Split(s.key, None)
    cols = [
        F.col(s.key).alias("key"),
        F.col(s.member).alias("member"),
        "ts_ms",
        "txn_id",
        F.lit(EVENT).alias("kind"),
    ]
    rounds = 1
    if split.hot_keys is None:
        sliced = rows.select(*cols, F.lit(0).alias("slice"))
    else:
        cold, hot = split.apply(rows)
        cut = chunked(hot, s.key, 0, policy).select(*cols, F.col("chunk").alias("slice"))
        sliced = cold.select(*cols, F.lit(0).alias("slice")).unionByName(cut)
        sliced = stage(sliced, "replay-slices")
        rounds = int(sliced.agg(F.max("slice")).first()[0]) + 1

    done, ended, carried = [], [], None
    for i in range(rounds):
        part = sliced.where(F.col("slice") == i).drop("slice")
        if carried is not None:
            part = part.unionByName(carried)
        out = (
            part.repartition("key")
            .sortWithinPartitions("key", "kind", "ts_ms", "txn_id")
            .mapInPandas(_replay(s.cap), REPLAY_SCHEMA)
        )
        kept = out.where(F.col("kind") == CARRIED)
        if rounds > 1:
            out = stage(out, "replay")
            # Only keys with a later slice need their set again.
            later = sliced.where(F.col("slice") > i).select("key").distinct()
            kept = out.where(F.col("kind") == CARRIED)
            carried = kept.select("key", "member", "ts_ms", "txn_id", "kind").join(
                later, "key", "left_semi"
            )
            kept = kept.join(later, "key", "left_anti")
        done.append(out.where(F.col("kind") == EVENT))
        ended.append(kept)
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, ended)


def replay(
    txns: DataFrame, over: Overflow, s: KnownSet, replay_rows: int = REPLAY_ROWS
) -> DataFrame:
    """(txn_id, known_ms, size) for all rows of the keys: since when the member has been known
    (null when new) and the size of the set with it."""
    events, _ = _rounds(txns, over, s, replay_rows)
    return events.select("txn_id", "known_ms", "size")


def snapshot(txns: DataFrame, s: KnownSet, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """The set of each key after all its rows: key, member, ``first_ms`` (since when it is known)
    and ``seq``, 1 for the member that goes first.

    A set that never exceeded its cap holds every member from its first row on. One that did is
    replayed, as what it holds depends on what it forgot. Members are counted exactly.
    """
    first = stage(
        txns.groupBy(s.key, s.member)
        .agg(F.min(F.struct("ts_ms", "txn_id")).alias("f"), F.count("*").alias("rows"))
        .select(s.key, s.member, "f.ts_ms", "f.txn_id", "rows"),
        "known-members",
    )
    sizes = first.groupBy(s.key).agg(F.count("*").alias("members"), F.sum("rows").alias("rows"))
    over = stage(sizes.where(F.col("members") > s.cap).select(s.key, "rows"), "known-overflow")
    largest = over.agg(F.max("rows")).first()[0]
    known = first.select(s.key, s.member, "ts_ms", "txn_id")
    if largest is not None:
        keys = over.select(s.key)
        _, ended = _rounds(txns, Overflow(keys, largest), s, replay_rows)
        held = ended.select(
            F.col("key").alias(s.key), F.col("member").alias(s.member), "ts_ms", "txn_id"
        )
        known = known.join(keys, s.key, "left_anti").unionByName(held)
    order = Window.partitionBy(s.key).orderBy("ts_ms", "txn_id")
    return known.select(
        s.key, s.member, F.col("ts_ms").alias("first_ms"), F.row_number().over(order).alias("seq")
    )


# Words of 64 bits per known-set sketch.
WORDS = {KNOWN_DEVICES_CAP: 2, DEVICE_USERS_CAP: 4, KNOWN_MERCHANTS_CAP: 4}


def _words(s: KnownSet) -> int:
    return WORDS.get(s.cap, 2)


def sketch(s: KnownSet) -> list[Column]:
    """Aggregates for a bitmap of hashed members: a few longs per key, so partial aggregation
    stays small however many keys a task meets."""
    place = F.pmod(F.xxhash64(s.member), F.lit(64 * _words(s)))
    return [
        F.bit_or(
            F.when(
                F.floor(place / 64) == i,
                F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")),
            ).otherwise(F.lit(0).cast("long"))
        ).alias(f"{s.member}_bits_{i}")
        for i in range(_words(s))
    ]


def may_overflow(s: KnownSet) -> Column:
    """Set bits are at least seven deviations below what ``cap`` + 1 members leave only for
    sets that are well inside the cap."""
    m, n = 64 * _words(s), s.cap + 1
    load = exp(-n / m)
    deviation = sqrt(m * load * (1 - (1 + n / m) * load))
    least = int(m * (1 - load) - 7 * deviation)
    bits = sum(
        (F.bit_count(f"{s.member}_bits_{i}") for i in range(_words(s))), F.lit(0)
    )
    return bits >= least


def confirm(txns: DataFrame, candidates: DataFrame, s: KnownSet) -> DataFrame | None:
    """Candidates that really exceed the cap, counted exactly."""
    over = (
        txns.select(s.key, s.member)
        .join(candidates, s.key, "left_semi")
        .distinct()
        .groupBy(s.key)
        .count()
        .where(F.col("count") > s.cap)
        .select(s.key)
    )
    return None if over.isEmpty() else over


@dataclass(frozen=True)
class Overflow:
    """Keys whose set exceeds its cap; no key has more than ``largest`` rows."""

    keys: DataFrame
    largest: int


@dataclass(frozen=True)
class Survey:
    """What one pass over a key column tells: hot keys, and keys whose sets overflow."""

    split: Split
    overflow: dict[KnownSet, Overflow]


def survey(
    txns: DataFrame, key: str, policy: SkewPolicy = DEFAULT, sets: list[KnownSet] = SETS
) -> Survey:
    mine = [s for s in sets if s.key == key]
    sizes = key_sizes(txns, key, [a for s in mine for a in sketch(s)])
    hits = sizes.agg(
        F.count_if(F.col("key_rows") > policy.hot_rows).alias("hot"),
        F.max("key_rows").alias("largest"),
        *[F.count_if(may_overflow(s)).alias(s.member) for s in mine],
    ).first()
    overflow = {}
    for s in mine:
        if hits[s.member]:
            keys = confirm(txns, sizes.where(may_overflow(s)).select(key), s)
            if keys is not None:
                overflow[s] = Overflow(keys, hits["largest"])
    return Survey(hot_split(sizes, key, hits["hot"], policy), overflow)


def apply_set_caps(
    state: DataFrame,
    txns: DataFrame,
    overflow: dict[KnownSet, Overflow],
    replay_rows: int = REPLAY_ROWS,
) -> DataFrame:
    """Replaces the window columns of rows whose key overflows by replayed ones."""
    out = state
    for s, over in overflow.items():
        fixed = replay(txns, over, s, replay_rows).withColumn("_fix", F.lit(True))
        out = (
            out.join(fixed, "txn_id", "left")
            .withColumns(
                {
                    s.first: F.when(F.col("_fix"), F.col("known_ms")).otherwise(
                        F.col(s.first)
                    ),
                    s.count: F.when(
                        F.col("_fix"), F.col("size").cast("double")
                    ).otherwise(F.col(s.count)),
                }
            )
            .drop("known_ms", "size", "_fix")
        )
    return out.select(*state.columns)
