import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame):
    """Rows as sorted tuples of comparable text, columns by name."""
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)

    def text(v):
        return f"{float(v) + 0.0:.5g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    return columns, sorted(tuple(text(v) for v in row) for row in values.itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        ca, ra = canonical(a)
        cb, rb = canonical(b)
        assert ca == cb
        assert len(ra) == len(rb)
        assert [x for x in zip(ra, rb, strict=True) if x[0] != x[1]][:3] == []

    return check
