import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in Path(f"{DATA}/sf0.001").glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def rows_of(frame, names):
    """Rows as sorted tuples of text, so that both engines' types compare."""
    import pandas as pd

    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return ""
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return repr(float(x))
        return str(x)

    return sorted(tuple(map(text, row)) for row in frame[names].astype(object).itertuples(index=False))


def same_rows(spark, duck, query, sql):
    ours, theirs = query(spark, f"{DATA}/sf0.001").toPandas(), duck.execute(sql).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    assert rows_of(ours, names) == rows_of(theirs, names)
    return ours
