import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("SIFTLIGHT_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from siftlight.ship import ship

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp())
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v):
    """A value in a form in which both engines' results can be compared."""
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Checks a query against its SQL on the smallest data."""

    def check(query, sql):
        df = query(spark, DATA)
        got = table_of(df.columns, [tuple(r) for r in df.collect()])
        cur = duck.execute(sql)
        want = table_of([d[0] for d in cur.description], cur.fetchall())
        assert got == want

    return check
