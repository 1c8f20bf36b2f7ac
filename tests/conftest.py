import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from factloom.session import checkpoints, local_session

    s = local_session(4, "3g")
    s.conf.set("spark.sql.shuffle.partitions", "3")
    checkpoints(s)
    return s


@pytest.fixture(scope="session")
def facts(spark):
    """Results as {name: [canonical JSON, ...]} to a table of facts."""
    def make(results):
        return spark.createDataFrame([(n, i, e) for n, es in results.items() for i, e in enumerate(es)], "name string, fact_pos int, expr string")

    return make
