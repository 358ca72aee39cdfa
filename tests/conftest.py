import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Compares a query's rows with its SQL's: names, number and values, in any order."""

    def check(spark, duck, query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        got = sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
        relation = duck.sql(sql)
        assert columns == sorted(relation.columns)
        want = sorted(repr(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
        assert got == want

    return check
