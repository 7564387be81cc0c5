import os
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def drained():
    """Stops a query when its batch with the n new rows is done: one with state that expires by the clock makes batches without end."""

    def wait(query, n, seconds=90):
        until = time.time() + seconds
        while query.isActive and time.time() < until:
            done = [p["numInputRows"] for p in query.recentProgress]
            if sum(done) >= n and done[-1] == 0:
                query.stop()
            time.sleep(0.1)
        if query.exception():
            raise query.exception()
        assert not query.isActive

    return wait
