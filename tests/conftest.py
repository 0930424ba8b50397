import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chatterlake.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    extra = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = build_session(
        "tests", "local[4]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", **extra},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def data():
    return DATA


def rows(df):
    return [tuple(r) for r in df.collect()]


def column(df):
    return [r[0] for r in df.collect()]
