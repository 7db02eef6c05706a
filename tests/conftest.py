import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from check import session

    spark = session(4)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def extracted(spark):
    """The small request table, stored, and its sites."""
    from registry.access_log import stored_extract

    return stored_extract(spark, SMALL)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
