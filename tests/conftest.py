import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from articleflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of an expression over one text."""

    def run(make, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        schema = ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([tuple(texts)], schema)
        from pyspark.sql import functions as F

        return df.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return run
