import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pricelens.session import get_session

    session = get_session("tests", cores="8", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "pricelens.spread.partitions": "8",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def one(spark):
    """Value of a column expression over named string inputs."""

    def value(expression, **inputs):
        schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for n, v in inputs.items())
        frame = spark.createDataFrame([tuple(inputs.values())], schema) if inputs else spark.range(1)
        return frame.select(expression.alias("v")).first()["v"]

    return value


@pytest.fixture()
def items(spark):
    """300 items with distinct titles and texts in three categories; cards name a brand, a use and a colour."""
    kinds = ("Electronics", "Automotive", "Office_Products")
    rows = [
        (i, f"No. {i}", kinds[i % 3], 4.0 + (i * 53 % 911), f"long text of number {i}; " * (1 + i % 4), i % 5 * 0.75,
         f"Title: No. {i}\nBrand: maker{i % 13}\nDescription: use{i % 11} in colour{i % 6}")
        for i in range(300)
    ]
    return spark.createDataFrame(
        rows, "id bigint, title string, category string, price double, full string, weight double, summary string"
    )
