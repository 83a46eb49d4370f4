"""Events of accounts that are no customers stay, in batch and on both sides of the check."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from fraudspark.plans import oracle as O
from fraudspark.sources import adapter


def test_unknown_accounts_stay(spark, tmp_path):
    at = dt.datetime(2024, 1, 3, 4, 5, 6)
    rows = [
        (i, at + dt.timedelta(hours=i), user, "click", 2.5, f'{{"k": {k}}}')
        for i, (user, k) in enumerate([(3, 1), (3, 13), (3000, 1), (3000, 14)])
    ]
    events = spark.createDataFrame(rows, adapter.EVENT_SCHEMA)
    customer = spark.createDataFrame([(1, 6)], adapter.CUSTOMER_SCHEMA)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    got = adapter.transactions(events, customer).orderBy("txn_id")
    found = [(r.txn_id, r.user_id, r.city, r.country) for r in got.collect()]
    assert found == [
        ("T000000000", "U000001", "CITY_6", "IN"),
        ("T000000001", "U000001", "CITY_13", "IN"),
        ("T000000002", "U001000", "CITY_0", "IN"),
        ("T000000003", "U001000", "CITY_7", "AE"),
    ]
    assert got.where(F.col("city").isNull() | F.col("lat").isNull()).count() == 0
    con = duckdb.connect()
    for name, table in (("events", events), ("customer", customer)):
        table.coalesce(1).write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    want = con.execute(
        O.sql("SELECT txn_id, user_id, city, country FROM txn") + " ORDER BY 1"
    ).fetchall()
    assert found == want
