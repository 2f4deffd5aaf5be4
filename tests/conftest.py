import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from dualcheck.session import local_session
    s = local_session(4, shuffle_partitions=4, app="dualcheck-tests")
    yield s
    s.stop()


def one(spark, expr, value, ddl="v string"):
    """Evaluate a column expression over a single value."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(value,)], ddl)
    return df.select(expr(F.col("v")).alias("x")).first()["x"]
