import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opswell import session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    cpus = os.environ.get("TEST_CPUS", "8")
    spark = session.build(
        f"local[{cpus}]",
        "opswell-tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": os.environ.get("TEST_MEMORY", "8g"), "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from opswell.sources.tables import Tables

    return Tables(spark, SMALL)
