import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from retail_insight.sources.workspace import release  # noqa: E402


SHARED = f"/tmp/retail-insight-tests-{os.getpid()}"


def new_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("retail-insight-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", SHARED)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = new_session()
    yield session
    release(session)
    left = [p for p in Path(SHARED).rglob("*") if p.is_file()]
    assert not left, f"stages left behind: {left[:3]}"
