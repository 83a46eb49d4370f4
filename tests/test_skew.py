"""Hot keys, chunks, halos and set replay give the rows the plain way gives."""

import random

import pytest
from brute import replay as brute_replay
from conftest import DAY, T0, frame, txn

from fraudspark.operators import caps
from fraudspark.operators.features import state_frame
from fraudspark.operators.skew import SkewPolicy
from fraudspark.operators.windows import DEVICE_STATE, USER_STATE

CHECKED = [
    "row_no", "n_before", "mean_prior", "std_prior", "count_1h", "count_24h", "sum_24h",
    "small_1h", "prev_ms", "first_ms", "user_device_first_ms", "user_devices", "user_merchants",
    "device_user_first_ms", "device_users",
]


def skewed_rows(n=1500, seed=1):
    """One account and one device hold about half of all rows; instants repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.5
        rows.append(
            txn(
                i,
                T0 + rng.randrange(3 * DAY // 20_000) * 20_000,
                rng.randrange(1, 3000),
                user_id="HOT" if hot else f"U{rng.randrange(20)}",
                device_id="RING" if rng.random() < 0.4 else f"D{rng.randrange(12)}",
                merchant_id=f"M{rng.randrange(25)}",
                lat=float(rng.randrange(8, 30)),
            )
        )
    return rows


@pytest.fixture(scope="module")
def rows():
    return skewed_rows()


@pytest.fixture(scope="module")
def expected(rows):
    return brute_replay(rows)


def check(pdf, expected, columns=CHECKED):
    assert len(pdf) == len(expected)
    for r in pdf.to_dict("records"):
        e = expected[r["txn_id"]]
        for c in columns:
            if e[c] is None:
                assert r[c] is None or r[c] != r[c], (r["txn_id"], c, r[c])
            else:
                assert r[c] == pytest.approx(e[c], abs=1e-6), (r["txn_id"], c)


@pytest.mark.parametrize(
    "policy",
    [SkewPolicy(), SkewPolicy(300, 200), SkewPolicy(30, 1000), SkewPolicy(50, 11)],
    ids=["plain", "hot", "one-chunk", "tiny-chunks"],
)
def test_state_equals_brute_force(spark, rows, expected, policy):
    df = state_frame(frame(spark, rows), policy)
    check(df.select("txn_id", *USER_STATE, *DEVICE_STATE).toPandas(), expected)


@pytest.mark.parametrize("slice_rows", [10**9, 60], ids=["one-pass", "slices"])
def test_set_replay(spark, rows, slice_rows):
    sets = [
        caps.KnownSet("user_id", "device_id", 4, "user_device_first_ms", "user_devices"),
        caps.KnownSet("user_id", "merchant_id", 10, "user_merchant_first_ms", "user_merchants"),
        caps.KnownSet("device_id", "user_id", 6, "device_user_first_ms", "device_users"),
    ]
    txns = frame(spark, rows)
    state = state_frame(txns, set_caps=False)
    over = {}
    for key in ("user_id", "device_id"):
        over |= caps.survey(txns, key, sets=sets).overflow
    got = caps.apply_set_caps(state, txns, over, slice_rows).toPandas()
    check(got, brute_replay(rows, devices_cap=4, merchants_cap=10, users_cap=6))


def test_overflow_is_found(spark):
    rows = [txn(i, T0 + i, 5, device_id=f"D{i}") for i in range(51)]
    rows += [txn(100 + i, T0 + i, 5, user_id="U2", device_id=f"D{i % 50}") for i in range(200)]
    found = caps.survey(frame(spark, rows), "user_id").overflow
    assert {s.member for s in found} == {"device_id"}
    (over,) = found.values()
    assert [r.user_id for r in over.keys.collect()] == ["U1"] and over.largest == 200


def test_strictly_before_columns(spark):
    rows = [
        txn(0, T0, 5, user_id="A", device_id="X"),
        txn(1, T0, 5, user_id="B", device_id="X"),
        txn(2, T0 + 5, 5, user_id="C", device_id="X"),
    ]
    for policy in (SkewPolicy(), SkewPolicy(1, 2)):
        got = state_frame(frame(spark, rows), policy).orderBy("txn_id").collect()
        assert [r.device_n_before for r in got] == [0, 0, 2]
        assert [r.device_users_before for r in got] == [0, 0, 2]
        assert [r.device_first_before_ms for r in got] == [None, None, T0]
