import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf_dir):
    """Compare a Spark query with its SQL on the small tables, any order."""

    def plain(rows):
        return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)

    def check(query, sql):
        df = query(spark, sf_dir)
        columns = sorted(df.columns)
        got = plain(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))
        assert columns == sorted(c for c, *_ in duck.execute(f"DESCRIBE {sql}").fetchall())
        names = ", ".join(f'"{c}"' for c in columns)
        assert got == plain(duck.execute(f"SELECT {names} FROM ({sql})").fetchall())

    return check
