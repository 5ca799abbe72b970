import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plexar.session import session

    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__sql__maxMetadataStringLength="5000")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def store(spark, tmp_path):
    from plexar.sources.tables import Store

    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def engine(store):
    from plexar.plans.engine import Engine

    return Engine(store)
