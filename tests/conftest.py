import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ruleharbor.session import CHECKPOINT_KEY, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", **{
        "spark.master": "local[8]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        CHECKPOINT_KEY: str(tmp_path_factory.mktemp("checkpoint")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
