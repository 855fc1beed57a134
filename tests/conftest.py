import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barwise import schemas  # noqa: E402
from barwise.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from {ticker: [close, ...]} on consecutive days; open = close, high and low one apart."""

    def make(series, start=dt.date(2020, 1, 1), sector="Tech"):
        rows = [
            (t, start + dt.timedelta(days=i), c, None if c is None else c + 1.0,
             None if c is None else c - 1.0, c, 100 + i, sector)
            for t, closes in series.items() for i, c in enumerate(closes)
        ]
        schema = "ticker string, date date, open double, high double, low double, close double, volume long, sector string"
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def make_returns(spark):
    """A return series per ticker on consecutive days."""

    def make(series, start=dt.date(2020, 1, 1), sector="Tech"):
        rows = [
            (t, start + dt.timedelta(days=i), sector, None if r is None else float(r))
            for t, rs in series.items() for i, r in enumerate(rs)
        ]
        return spark.createDataFrame(rows, "ticker string, date date, sector string, daily_return double")

    return make


def ordered(df, *cols):
    return [tuple(r) for r in df.orderBy("ticker", "date").select(*cols).collect()]


assert schemas.BARS["ticker"].nullable is False
