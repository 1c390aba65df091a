import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

import pytest

import oracle


@pytest.fixture(scope="session")
def spark():
    s = oracle.session(
        4,
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.default.parallelism": "3",
            "spark.driver.memory": "6g",
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    yield s
    s.stop()
