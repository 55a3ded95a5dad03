import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from textloom.session import ship

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "3g"}
    session = ship(SparkSession.builder.master("local[4]").config(map=conf).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def compare(spark, name, query, sql, folder=SMALL):
    """Rows of a query and of its SQL as sorted lists of strings."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = query(spark, folder).toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns), name
    cols = sorted(got.columns)

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = [sorted([tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)], key=str) for df in (got, want)]
    assert rows[0] == rows[1], name
    return got
