import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    """Values in one form for both engines; floats to six places."""
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.fixture(scope="session")
def same(duck):
    """Asserts that a Spark result and a SQL text give the same rows."""

    def check(df, sql):
        cols = sorted(df.columns)
        got = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect()]
        done = duck.execute(sql)
        names = [d[0] for d in done.description]
        assert sorted(names) == cols
        want = [tuple(plain(r[names.index(c)]) for c in cols) for r in done.fetchall()]
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted(got, key=key) == sorted(want, key=key)

    return check
