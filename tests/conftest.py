import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))

from presswork.schemas import SCHEMAS  # noqa: E402
from presswork.sources.tables import canonical  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # One JVM on this machine, so a local folder is shared by all tasks.
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module")
def interpreted(spark):
    """No code generation: it takes longer than the queries on a few rows."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode":
                "NO_CODEGEN", "spark.sql.adaptive.enabled": "false",
                "spark.sql.shuffle.partitions": "1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.fixture(scope="session")
def table(spark):
    """Makes a canonical table from dictionaries; columns not given are NULL."""
    def make(name, *rows):
        schema = SCHEMAS[name]
        values = [tuple(row.get(field.name) for field in schema) for row in rows]
        return canonical(spark.createDataFrame(values, schema), name)
    return make


def at(text):
    """``"10:00"``, ``"10:00:59"`` on 1 March 2024, or a full ISO time."""
    return datetime.fromisoformat(text if "-" in text else f"2024-03-01 {text}")


def rows(df, *columns):
    """The rows as tuples; of single values if there is one column."""
    found = [tuple(row) for row in df.select(*(columns or df.columns)).collect()]
    return [row[0] for row in found] if len(columns) == 1 else found
