import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from raw_logs import write_csv  # noqa: E402

from fraud_engine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def raw(spark, tmp_path):
    """Raw transactions from rows, through the CSV reader."""
    from fraud_engine.sources import read_transactions

    def make(rows, columns=None):
        return read_transactions(spark, write_csv(tmp_path / "raw.csv", rows, columns))

    return make


@pytest.fixture
def rows_of():
    def collect(df):
        return [tuple(r) for r in df.collect()]

    return collect
