import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture
def same(duck):
    """Asserts that a DataFrame has the rows and columns of a SQL query."""

    def canon(rows):
        return sorted(tuple(repr(v) for v in r) for r in rows)

    def check(df, sql):
        columns = sorted(df.columns)
        rel = duck.sql(sql)
        assert sorted(rel.columns) == columns
        assert canon(tuple(r) for r in df.select(*columns).collect()) == canon(rel.select(*[f'"{c}"' for c in columns]).fetchall())

    return check
