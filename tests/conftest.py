import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from veritab.session import build_session

    session = build_session(
        "local[8]", "tests",
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
