import os
import sys
from pathlib import Path

import pytest
from tables import SMALL, TABLES

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(shared),
        "spark.sql.warehouse.dir": str(shared / "warehouse"),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query with its SQL on the small tables."""

    def norm(v):
        if isinstance(v, float):
            return round(v, 9)
        if isinstance(v, list | tuple):
            return tuple(map(norm, v))
        return v

    def check(query, sql):
        df = query(spark, SMALL)
        got = [[r[c] for c in sorted(df.columns)] for r in df.collect()]
        res = duck.execute(sql)
        cols = [x[0] for x in res.description]
        assert sorted(cols) == sorted(df.columns)
        at = [cols.index(c) for c in sorted(cols)]
        want = [[r[i] for i in at] for r in res.fetchall()]
        assert sorted(repr(norm(r)) for r in got) == sorted(repr(norm(r)) for r in want)

    return check
