import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


def _plain(value):
    import datetime
    import math

    import pandas as pd

    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (pd.Timestamp, datetime.date)):
        return str(pd.Timestamp(value))
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 9)
    return value


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(_plain(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_as_sql(spark, small):
    """Checks that a query and SQL over the same tables give the same rows."""
    import duckdb

    def check(query, sql, sf_dir=small):
        con = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        left, right = rows_of(query(spark, sf_dir).toPandas()), rows_of(con.sql(sql).df())
        assert left[0] == right[0]
        assert left[1] == right[1]
        return len(left[1])

    return check
