import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plenum.session import local_session, ship
    from plenum.sources import store

    session = ship(local_session("4", "tests"))
    session.sparkContext.setLogLevel("OFF")
    yield session
    store.clean(session)
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    for path in glob.glob(f"{DATA}/*.parquet"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {os.path.basename(path)[:-8]} AS FROM '{path}'")
    return duckdb
