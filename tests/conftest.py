import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def plant(spark, tmp_path_factory):
    """The small export as an ingested workspace."""
    from fixtures import PROJECT
    from millwright.sources.workspace import ingest

    folder = tmp_path_factory.mktemp("plant")
    (folder / "plant.L5X").write_text(PROJECT)
    return ingest(spark, str(folder / "*.L5X"), str(folder / "w"))
