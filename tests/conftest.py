import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

import duckdb  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a DataFrame and a SQL text give the same rows."""

    def text(v):
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    def check(df, sql):
        got, want = df.collect(), duck.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        names = sorted(df.columns)
        a = sorted(tuple(text(r[c]) for c in names) for r in got)
        at = [want.columns.index(c) for c in names]
        b = sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())
        assert a == b

    return check
