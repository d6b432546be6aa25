import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def rows_of(pdf, columns):
    d = pdf[columns].astype(object)
    d = d.where(pdf[columns].notna(), None)
    # whole numbers look alike whether or not a null made pandas read their column as floats
    plain = lambda v: str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return sorted(tuple(plain(v) for v in row) for row in d.values.tolist())


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert rows_of(got, columns) == rows_of(want, columns)

    return check
