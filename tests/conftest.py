import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def agree(spark, name, f, sql, data=DATA):
    """A query and its SQL give the same rows."""
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine = f(spark, data)
    columns = sorted(mine.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    show = lambda x: "null" if x is None else "nan" if x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    tidy = lambda rs: sorted(tuple(show(x) for x in r) for r in rs)
    assert tidy(mine.select(*columns).collect()) == tidy(theirs), name
