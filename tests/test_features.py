"""The 45 features on a small made-up world, worked out by hand. Every story has accounts, devices
and merchants of its own, so that one run of the operator serves them all."""

import math

import pytest
from conftest import DAY, T0, frame, txn

from fraudspark.operators.features import feature_frame
from fraudspark.schemas import FEATURES, MERCHANT, USER

MINUTE = 60_000
HOUR = 60 * MINUTE
HOME = {"city": "Nagpur", "lat": 21.0, "lon": 79.0}


class World:
    def __init__(self):
        self.events = []

    def add(self, who, at, amount=10, **kw):
        """An event of account ``who``; device and merchant are its own unless named."""
        i = len(self.events)
        own = {"user_id": who, "device_id": f"{who}-phone", "merchant_id": f"{who}-shop"}
        self.events.append(txn(i, T0 + at, amount, **{**own, **HOME, **kw}))
        return f"T{i:06d}"


@pytest.fixture(scope="module")
def story():
    w = World()
    names = {"opening": w.add("opening", 6 * HOUR + 30 * MINUTE, 800)}
    # Mean 100, squared distances 2 * (70^2 + 40^2 + 10^2) = 13,200.
    for i, amount in enumerate((30, 60, 90, 110, 140, 170)):
        w.add("ladder", i * 8 * MINUTE, amount)
    names["ladder"] = w.add("ladder", 50 * MINUTE, 250)
    for gap in (HOUR - 1, HOUR, DAY - 1, DAY):
        w.add(f"gap{gap}", 2 * DAY - gap, 70)
        names[f"gap{gap}"] = w.add(f"gap{gap}", 2 * DAY, 70)
    names["tie1"] = w.add("tie", HOUR, 5)
    names["tie2"] = w.add("tie", HOUR, 6)
    # A quarter of the equator in four hours.
    w.add("flight", 0, lat=0.0, lon=10.0)
    names["flight"] = w.add("flight", 4 * HOUR, lat=0.0, lon=100.0, city="Elsewhere", country="AE")
    for i, who in enumerate(("ann", "bob", "ann", "cyd")):
        names[f"ring{i}"] = w.add(who, i * 6 * HOUR, device_id="ring")
    for at in (0, 17 * HOUR, 4 * DAY + 18 * HOUR + 30 * MINUTE, 5 * DAY, 6 * DAY + 23 * HOUR + 59 * MINUTE):
        names[f"clock{at}"] = w.add(f"clock{at}", at)
    names["stranger1"] = w.add("stranger", 0, city="Kochi")
    names["stranger2"] = w.add("stranger", 12 * HOUR, city="Agra")
    for i in range(620):
        w.add("busy", i * 1000, 1 + 2 * (i % 2))
    names["busy"] = w.add("busy", 620 * 1000, 3)
    for kind, cap in (("device", 50), ("merchant", 300)):
        for many in (cap, cap + 7):
            for turn in range(2):
                for i in range(many):
                    last = w.add(
                        f"{kind}{many}", (turn * many + i) * MINUTE, **{f"{kind}_id": f"{kind}-{many}-{i}"}
                    )
            names[f"{kind}{many}"] = last
    return w.events, names


@pytest.fixture(scope="module")
def of(spark, story):
    events, names = story
    known = sorted({e["user_id"] for e in events} - {"stranger"})
    users = spark.createDataFrame(
        [(u, "Nagpur", 21.0, 79.0, T0 - 250 * DAY, 1.0) for u in known], USER
    )
    merchants = spark.createDataFrame(
        [(f"{u}-shop", "grocery", "Nagpur", "IN", False, T0 - 120 * DAY, 0.02) for u in known],
        MERCHANT,
    )
    rows = feature_frame(frame(spark, events), users, merchants).toPandas()
    assert len(rows) == len(events)
    assert list(rows.columns[3 : 3 + len(FEATURES)]) == FEATURES and len(FEATURES) == 45
    rows = rows.set_index("txn_id")
    return lambda name: rows.loc[names[name]]


def agrees(row, **want):
    assert {k: row[k] for k in want} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_opening_event(of):
    agrees(
        of("opening"),
        amount=800, amount_log=math.log(801), amount_z=0, amount_ratio_mean=1,
        txn_count_1h=0, txn_count_24h=0, amount_sum_24h=0, small_txn_count_1h=0,
        txn_count_total=0, seconds_since_last=30 * 86_400,
        is_new_device=1, device_user_age_days=0, user_device_count=1,
        is_new_merchant=1, device_user_count=1, device_age_days=0,
        distance_from_last_km=0, speed_kmh=0, is_home_city=1, is_international=0,
        hour_local=12, is_night=0, is_weekend=0, is_online=0,
        account_age_days=250 + 6.5 / 24, merchant_age_days=120 + 6.5 / 24,
        category_risk=0.02, cat_grocery=1, channel_card=0, channel_netbanking=0,
    )


def test_ladder_of_amounts(of):
    agrees(
        of("ladder"),
        amount_z=150 / math.sqrt(13_200 / 5), amount_ratio_mean=2.5, txn_count_total=6,
        txn_count_1h=6, txn_count_24h=6, amount_sum_24h=600, small_txn_count_1h=3,
        seconds_since_last=600, is_new_device=0, is_new_merchant=0,
        device_user_age_days=50 / 1440, device_age_days=50 / 1440,
    )


@pytest.mark.parametrize(
    "gap, hour, day", [(HOUR - 1, 1, 1), (HOUR, 0, 1), (DAY - 1, 0, 1), (DAY, 0, 0)]
)
def test_ends_of_the_windows(of, gap, hour, day):
    agrees(
        of(f"gap{gap}"),
        txn_count_1h=hour, small_txn_count_1h=hour, txn_count_24h=day, amount_sum_24h=70 * day,
        seconds_since_last=gap / 1000,
    )


def test_events_of_one_instant_count_in_order(of):
    agrees(of("tie1"), txn_count_1h=0, txn_count_total=0, is_new_device=1)
    agrees(of("tie2"), txn_count_1h=1, txn_count_total=1, is_new_device=0, amount_sum_24h=5)


def test_quarter_of_the_equator(of):
    f = of("flight")
    quarter = math.pi / 2 * 6371
    assert f.distance_from_last_km == pytest.approx(quarter, rel=1e-3)
    assert f.speed_kmh == pytest.approx(f.distance_from_last_km / 4)
    agrees(f, is_home_city=0, is_international=1)


def test_device_that_goes_round(of):
    for i, (users, new, days) in enumerate(
        [(1, 1, 0), (2, 1, 0.25), (2, 0, 0.5), (3, 1, 0.75)]
    ):
        agrees(of(f"ring{i}"), device_user_count=users, is_new_device=new, device_age_days=days)
    agrees(of("ring2"), device_user_age_days=0.5, user_device_count=1)


@pytest.mark.parametrize(
    "at, hour, night, weekend",
    [
        (0, 5.5, 0, 0),
        (17 * HOUR, 22.5, 0, 0),
        (4 * DAY + 18 * HOUR + 30 * MINUTE, 0, 1, 1),
        (5 * DAY, 5.5, 0, 1),
        (6 * DAY + 23 * HOUR + 59 * MINUTE, 5 + 29 / 60, 1, 0),
    ],
)
def test_clock_of_the_customer(of, at, hour, night, weekend):
    agrees(of(f"clock{at}"), hour_local=hour, is_night=night, is_weekend=weekend)


def test_account_and_merchant_without_a_profile(of):
    agrees(
        of("stranger1"), account_age_days=0, merchant_age_days=0, category_risk=0.1,
        is_home_city=1,
    )
    # Home is then where the account was last.
    agrees(of("stranger2"), account_age_days=0.5, merchant_age_days=0, is_home_city=0)


def test_recent_list_is_full(of):
    agrees(
        of("busy"), txn_count_1h=500, txn_count_24h=500, amount_sum_24h=1000,
        small_txn_count_1h=500, txn_count_total=620,
    )


@pytest.mark.parametrize(
    "name, new, devices", [("device50", 0, 50), ("device57", 1, 51)]
)
def test_devices_are_forgotten(of, name, new, devices):
    agrees(of(name), is_new_device=new, user_device_count=devices)


@pytest.mark.parametrize("name, new", [("merchant300", 0), ("merchant307", 1)])
def test_merchants_are_forgotten(of, name, new):
    agrees(of(name), is_new_merchant=new)
