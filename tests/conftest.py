import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fraudspark.schemas import MERCHANT, TRANSACTION, USER  # noqa: E402
from fraudspark.session import build  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
T0 = 1_730_678_400_000  # Monday, 2024-11-04 00:00 UTC
DAY = 86_400_000


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test data is not there")
    return SF_DIR


def txn(i, ts_ms, amount, **kw):
    row = {
        "txn_id": f"T{i:06d}",
        "ts_ms": int(ts_ms),
        "user_id": "U1",
        "merchant_id": "M1",
        "merchant_category": "grocery",
        "device_id": "D1",
        "channel": "UPI",
        "amount": float(amount),
        "city": "Nagpur",
        "lat": 21.0,
        "lon": 79.0,
        "country": "IN",
        "is_online": False,
        "is_fraud": False,
        "fraud_type": "none",
        "context": "regular",
    }
    row.update(kw)
    return row


def frame(spark, rows):
    names = TRANSACTION.fieldNames()
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], TRANSACTION)


@pytest.fixture(scope="session")
def users(spark):
    return spark.createDataFrame(
        [("U1", "Nagpur", 21.0, 79.0, T0 - 250 * DAY, 1.0)], USER
    )


@pytest.fixture(scope="session")
def merchants(spark):
    return spark.createDataFrame(
        [("M1", "grocery", "Nagpur", "IN", False, T0 - 120 * DAY, 0.02)], MERCHANT
    )
