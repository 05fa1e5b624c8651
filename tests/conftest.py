import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.master": "local[4]", "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.log.level": "ERROR",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    yield session
    session.stop()


def same_rows(a, b) -> None:
    """Equal columns and rows, whatever their order."""
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda d: sorted(tuple(repr(x) for x in r) for r in d[cols].astype(object).itertuples(index=False))
    assert key(a) == key(b)
