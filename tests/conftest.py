import os
import sys

import pytest
from pyspark import cloudpickle

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newslens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def functions_travel(request):
    """Functions defined in a test module reach the Python workers by value."""
    cloudpickle.register_pickle_by_value(request.module)


@pytest.fixture
def evaluate(spark):
    """Apply a column expression to Python values: ``evaluate(fn, [(a, b), ...], 'a string, b int')``."""

    def run(fn, values, schema="x string"):
        values = [v if isinstance(v, tuple) else (v,) for v in values]
        df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"_i int, {schema}")
        columns = [df[c] for c in df.columns[1:]]
        return [r[0] for r in df.orderBy("_i").select(fn(*columns)).collect()]

    return run
