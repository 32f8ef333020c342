import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seatward.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def at():
    """Minute of a fixed day as a datetime."""

    def make(minute: float, day: int = 1) -> datetime:
        seconds = round(minute * 60)
        return datetime(2026, 5, day, seconds // 3600, seconds // 60 % 60, seconds % 60)

    return make


REQUEST = (
    "id long, email string, pool string, payment_status string, is_waitlist boolean, created_at timestamp_ntz, "
    "promoted_at timestamp_ntz, cancelled_at timestamp_ntz, paid_at timestamp_ntz, admin_notes string, "
    "amount_eur decimal(8,2)"
)


@pytest.fixture
def requests_df(spark):
    def make(rows):
        names = [c.strip().split()[0] for c in REQUEST.replace("decimal(8,2)", "decimal").split(",")]
        base = {"payment_status": "pending", "is_waitlist": False}
        return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], REQUEST)

    return make


@pytest.fixture
def payers_df(spark):
    schema = "id long, email string, pool string, transaction_id string, expected_champions int, montant_eur decimal(12,2)"

    def make(rows):
        names = [c.strip().split()[0] for c in schema.replace("decimal(12,2)", "decimal").split(",")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    return make
