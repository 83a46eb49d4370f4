"""Rolling state per device and per account on a stream.

The processors emit each event with the state *before* it, under the column names of the
batch windows (DEVICE_STATE, USER_STATE), so one definition of the features serves both.
State is bounded: 24 hours and 500 events, 50 devices, 300 merchants, 200 accounts per device.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fraudspark.operators.caps import REPLAY_ROWS, SETS, snapshot
from fraudspark.schemas import (
    DAY_MS,
    DEVICE_USERS_CAP,
    HOUR_MS,
    KNOWN_DEVICES_CAP,
    KNOWN_MERCHANTS_CAP,
    RECENT_CAP,
    SMALL_AMOUNT,
    WIRE,
)
from fraudspark.sources.staging import stage

DEVICES, SHOPS, ACCOUNTS = SETS
DEVICE_STATE_SCHEMA = "users array<string>, first_ms bigint, n bigint"
LISTS = {
    "recent_ms": T.LongType(),
    "recent_amount": T.DoubleType(),
    "device_ids": T.StringType(),
    "device_ms": T.LongType(),
    "merchant_ids": T.StringType(),
}
USER_STATE_SCHEMA = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("m2", T.DoubleType()),
        *[T.StructField(name, T.ArrayType(kind)) for name, kind in LISTS.items()],
        T.StructField("first_ms", T.LongType()),
        T.StructField("last_ms", T.LongType()),
        T.StructField("last_lat", T.DoubleType()),
        T.StructField("last_lon", T.DoubleType()),
        T.StructField("last_city", T.StringType()),
    ]
)
DEVICE_FIELDS = T.StructType(
    [
        T.StructField("device_row_no", T.LongType()),
        T.StructField("device_first_ms", T.LongType()),
        T.StructField("device_users", T.DoubleType()),
    ]
)
USER_FIELDS = T.StructType(
    [
        T.StructField("row_no", T.LongType()),
        T.StructField("mean_prior", T.DoubleType()),
        T.StructField("std_prior", T.DoubleType()),
        T.StructField("count_1h", T.DoubleType()),
        T.StructField("count_24h", T.DoubleType()),
        T.StructField("sum_24h", T.DoubleType()),
        T.StructField("small_1h", T.DoubleType()),
        T.StructField("prev_ms", T.LongType()),
        T.StructField("prev_lat", T.DoubleType()),
        T.StructField("prev_lon", T.DoubleType()),
        T.StructField("prev_city", T.StringType()),
        T.StructField("first_ms", T.LongType()),
        T.StructField("user_device_first_ms", T.LongType()),
        T.StructField("user_devices", T.DoubleType()),
        T.StructField("user_merchant_first_ms", T.LongType()),
        T.StructField("user_merchants", T.DoubleType()),
    ]
)
DEVICE_OUT = T.StructType(WIRE.fields + DEVICE_FIELDS.fields)
USER_OUT = T.StructType(DEVICE_OUT.fields + USER_FIELDS.fields)


def _in_order(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of one micro-batch arrive in several chunks and in no order."""
    return pd.concat(list(chunks)).sort_values(["ts_ms", "txn_id"], ignore_index=True)


def _joined(rows: pd.DataFrame, seen: dict[str, object], fields: T.StructType) -> pd.DataFrame:
    kinds = {"long": "Int64", "double": "float64"}
    extra = {
        f.name: pd.Series(seen[f.name], dtype=kinds.get(f.dataType.typeName(), object))
        for f in fields
    }
    return pd.concat([rows, pd.DataFrame(extra)], axis=1)


@dataclass
class Members:
    """A bounded set in the order of its sequence numbers: the member in front goes first.
    ``by_time``: the one that came at the earliest time goes first, which is the one in front
    unless events came late."""

    names: list
    since: list
    cap: int
    by_time: bool = False

    def meet(self, names: np.ndarray, times: np.ndarray) -> tuple[list, np.ndarray]:
        """For each row, since when its member was known before it (None: new), and how many are
        known with it. A batch that cannot overflow the set is one pass over arrays."""
        codes, distinct = pd.factorize(names)
        place = {m: i for i, m in enumerate(self.names)}
        known = np.array([place.get(m, -1) for m in distinct], np.int64)
        if len(self.names) + int((known < 0).sum()) > self.cap:
            return self._one_by_one(names, times)
        _, first = np.unique(codes, return_index=True)
        came = times[first]
        if self.since:
            came = np.where(known >= 0, np.array(self.since, np.int64)[known], came)
        rows = np.arange(len(codes))
        fresh = (known[codes] < 0) & (first[codes] == rows)
        size = len(self.names) + np.cumsum(fresh)
        since = came[codes].astype(object)
        since[fresh] = None
        self.names += [distinct[c] for c in codes[fresh]]
        self.since += times[fresh].tolist()
        return since.tolist(), size

    def _one_by_one(self, names: np.ndarray, times: np.ndarray) -> tuple[list, np.ndarray]:
        held = dict(zip(self.names, self.since, strict=True))
        since, size = [], np.empty(len(names), np.int64)
        for i, (name, at) in enumerate(zip(names.tolist(), times.tolist(), strict=True)):
            since.append(held.get(name))
            size[i] = len(held) + (name not in held)
            held.setdefault(name, at)
            if size[i] > self.cap:
                del held[min(held, key=held.__getitem__) if self.by_time else next(iter(held))]
        self.names, self.since = list(held), list(held.values())
        return since, size


class DeviceHistory(StatefulProcessor):
    """Accounts seen on a device, first use, number of events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("device", DEVICE_STATE_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((list(r["users"]), int(r["first_ms"]), int(r["n"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        users, first, n = self.state.get() if self.state.exists() else ([], None, 0)
        accounts = Members(list(users), [0] * len(users), DEVICE_USERS_CAP)
        times = batch["ts_ms"].to_numpy(np.int64)
        _, size = accounts.meet(batch["user_id"].to_numpy(object), times)
        begun = [first if n else None] + [first if n else int(times[0])] * (len(batch) - 1)
        seen = {
            "device_row_no": n + 1 + np.arange(len(batch)),
            "device_first_ms": begun,
            "device_users": size,
        }
        self.state.update((accounts.names, first if n else int(times[0]), n + len(batch)))
        yield _joined(batch, seen, DEVICE_FIELDS)

    def close(self) -> None:
        pass


@dataclass
class Account:
    """What an account's events so far amount to; ``fold`` takes a run of events at once."""

    n: int
    mean: float
    m2: float
    times: np.ndarray
    amounts: np.ndarray
    devices: Members
    shops: Members
    first: int | None
    last: tuple

    def run_length(self, times: np.ndarray) -> int:
        """How many of the sorted events can be folded at once: all of them if none is older than
        what is kept, else one by one until the kept events are in order again."""
        kept = self.times
        in_order = not len(kept) or (np.all(kept[1:] >= kept[:-1]) and times[0] >= kept[-1])
        return len(times) if in_order else 1

    def fold(self, rows: pd.DataFrame) -> dict[str, object]:
        t = rows["ts_ms"].to_numpy(np.int64)
        a = rows["amount"].to_numpy(float)
        size = len(rows)
        seen: dict[str, object] = {"row_no": self.n + 1 + np.arange(size)}
        seen |= self._moments(a)
        seen |= self._windows(t, a)
        for name, place in zip(("ms", "lat", "lon", "city"), range(4), strict=True):
            column = "ts_ms" if name == "ms" else name
            seen[f"prev_{name}"] = [self.last[place], *rows[column].tolist()[:-1]]
        seen["first_ms"] = [self.first] + [int(t[0]) if self.first is None else self.first] * (size - 1)
        known, many = self.devices.meet(rows["device_id"].to_numpy(object), t)
        seen |= {"user_device_first_ms": known, "user_devices": many}
        known, many = self.shops.meet(rows["merchant_id"].to_numpy(object), t)
        shop = [None if k is None else f for k, f in zip(known, seen["first_ms"], strict=True)]
        seen |= {"user_merchant_first_ms": shop, "user_merchants": many}
        self.n += size
        self.first = int(t[0]) if self.first is None else self.first
        newest = rows.iloc[-1]
        self.last = (int(t[-1]), newest["lat"], newest["lon"], newest["city"])
        return seen

    def _moments(self, a: np.ndarray) -> dict[str, np.ndarray]:
        """Mean and deviation before each event, by sums of distances from the mean so far."""
        at = self.mean if self.n else a[0]
        d = a - at
        s, q = np.cumsum(d), np.cumsum(d * d)
        before = self.n + np.arange(len(a))
        s0, q0 = np.concatenate(([0.0], s[:-1])), np.concatenate(([0.0], q[:-1]))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.where(before > 0, at + s0 / before, np.nan)
            spread = np.maximum(self.m2 + q0 - s0 * s0 / before, 0.0)
            deviation = np.where(before > 1, np.sqrt(spread / (before - 1)), np.nan)
        n = self.n + len(a)
        self.mean, self.m2 = float(at + s[-1] / n), float(max(self.m2 + q[-1] - s[-1] ** 2 / n, 0.0))
        return {"mean_prior": mean, "std_prior": deviation}

    def _windows(self, t: np.ndarray, a: np.ndarray) -> dict[str, np.ndarray]:
        """Counts and sums over the last hour and day, of the 500 newest events at most."""
        times, amounts = np.concatenate((self.times, t)), np.concatenate((self.amounts, a))
        here = len(self.times) + np.arange(len(t))
        if len(t) == 1:  # what is kept may be out of order
            age = t[0] - self.times
            spans = [(age >= 0) & (age < width) for width in (HOUR_MS, DAY_MS)]
            hour, day = (np.flatnonzero(x) for x in spans)
            out = [len(hour), len(day), self.amounts[day].sum(), (self.amounts[hour] < SMALL_AMOUNT).sum()]
            out = [np.array([v], float) for v in out]
        else:
            start = [
                np.maximum(np.searchsorted(times, t - width, "right"), here - RECENT_CAP)
                for width in (HOUR_MS, DAY_MS)
            ]
            total = np.concatenate(([0.0], np.cumsum(amounts)))
            small = np.concatenate(([0], np.cumsum(amounts < SMALL_AMOUNT)))
            out = [here - start[0], here - start[1], total[here] - total[start[1]], small[here] - small[start[0]]]
        kept = times > t[-1] - DAY_MS
        kept[-1] = True
        self.times, self.amounts = times[kept][-RECENT_CAP:], amounts[kept][-RECENT_CAP:]
        return dict(zip(("count_1h", "count_24h", "sum_24h", "small_1h"), out, strict=True))

    def row(self) -> tuple:
        return (
            self.n, self.mean, self.m2, self.times.tolist(), self.amounts.tolist(),
            self.devices.names, [int(v) for v in self.devices.since], self.shops.names,
            self.first, self.last[0], float(self.last[1]), float(self.last[2]), self.last[3],
        )

    @classmethod
    def of(cls, row: tuple | None) -> Account:
        if row is None:
            row = (0, 0.0, 0.0, [], [], [], [], [], None, None, None, None, None)
        n, mean, m2, times, amounts, ids, since, shops, first, *last = row
        return cls(
            n, mean, m2, np.array(times, np.int64), np.array(amounts, float),
            Members(list(ids), list(since), KNOWN_DEVICES_CAP, by_time=True),
            Members(list(shops), [0] * len(shops), KNOWN_MERCHANTS_CAP),
            first, tuple(last),
        )


class UserHistory(StatefulProcessor):
    """Amounts, recent events, devices, merchants and last place of an account."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", USER_STATE_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        whole = ("n", "first_ms", "last_ms")
        self.state.update(
            tuple(
                r[c].tolist() if c in LISTS else int(r[c]) if c in whole else r[c]
                for c in USER_STATE_SCHEMA.fieldNames()
            )
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        account = Account.of(self.state.get() if self.state.exists() else None)
        times = batch["ts_ms"].to_numpy(np.int64)
        done = 0
        while done < len(batch):
            size = account.run_length(times[done:])
            part = batch.iloc[done : done + size].reset_index(drop=True)
            yield _joined(part, account.fold(part), USER_FIELDS)
            done += size
        self.state.update(account.row())

    def close(self) -> None:
        pass


def with_device_state(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    return events.groupBy("device_id").transformWithStateInPandas(
        DeviceHistory(),
        DEVICE_OUT,
        "append",
        "none",
        initialState=initial.groupBy("device_id") if initial is not None else None,
    )


def with_user_state(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    return events.groupBy("user_id").transformWithStateInPandas(
        UserHistory(),
        USER_OUT,
        "append",
        "none",
        initialState=initial.groupBy("user_id") if initial is not None else None,
    )


# --- state of a history, built in batch ---


def _in_sequence(members: DataFrame, key: str, *fields: str) -> DataFrame:
    """Members of each key as a list in the order in which they go. A list holds a cap at most."""
    return members.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("k")
    )


def warm_device_state(history: DataFrame, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """(device_id, users, first_ms, n), as the stream would hold it after the history: a user list
    that has overflowed is the one that its evictions left."""
    members = snapshot(history, ACCOUNTS, replay_rows)
    lists = _in_sequence(members, "device_id", "user_id").select(
        "device_id", F.transform("k", lambda x: x["user_id"]).alias("users")
    )
    totals = history.groupBy("device_id").agg(
        F.min("ts_ms").alias("first_ms"), F.count("*").alias("n")
    )
    return stage(lists.join(totals, "device_id"), "warm-devices")


def warm_user_state(history: DataFrame, replay_rows: int = REPLAY_ROWS) -> DataFrame:
    """One USER_STATE_SCHEMA row per account, as the stream would hold it after the history. Recent
    events are cut to their cap by a ranked filter before they are collected. Written once: every
    micro-batch plans its initial state anew."""
    last = F.max_by(F.struct("ts_ms", "lat", "lon", "city"), F.struct("ts_ms", "txn_id"))
    totals = (
        history.groupBy("user_id")
        .agg(
            F.count("*").alias("n"),
            F.avg("amount").alias("mean"),
            F.var_pop("amount").alias("var"),
            F.min("ts_ms").alias("first_ms"),
            last.alias("last"),
        )
        .select(
            "user_id", "n", "mean", (F.col("var") * F.col("n")).alias("m2"), "first_ms",
            F.col("last.ts_ms").alias("last_ms"), F.col("last.lat").alias("last_lat"),
            F.col("last.lon").alias("last_lon"), F.col("last.city").alias("last_city"),
        )
    )
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts_ms"), F.desc("txn_id"))
    recent = (
        history.select("user_id", "ts_ms", "txn_id", "amount")
        .withColumn("age", F.row_number().over(newest))
        .where(F.col("age") <= RECENT_CAP)
        .join(totals.select("user_id", "last_ms"), "user_id")
        .where(F.col("ts_ms") > F.col("last_ms") - DAY_MS)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("ts_ms", "txn_id", "amount"))).alias("r"))
    )
    devices = _in_sequence(snapshot(history, DEVICES, replay_rows), "user_id", "device_id", "first_ms")
    shops = _in_sequence(snapshot(history, SHOPS, replay_rows), "user_id", "merchant_id")

    def part(name: str, field: str):
        return F.transform(name, lambda x: x[field])

    state = (
        totals.join(recent, "user_id")
        .join(devices.withColumnRenamed("k", "d"), "user_id")
        .join(shops.withColumnRenamed("k", "s"), "user_id")
        .select(
            "user_id", "n", "mean", "m2",
            part("r", "ts_ms").alias("recent_ms"), part("r", "amount").alias("recent_amount"),
            part("d", "device_id").alias("device_ids"), part("d", "first_ms").alias("device_ms"),
            part("s", "merchant_id").alias("merchant_ids"),
            "first_ms", "last_ms", "last_lat", "last_lon", "last_city",
        )
    )
    return stage(state, "warm-accounts")
