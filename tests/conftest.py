"""A local session, and a comparison of Spark rows with what DuckDB finds in the same tables."""

import math
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")}
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def table(names, rows):
    """Rows with columns in order of their names, sorted."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql():
    def check(df, sql, sf_dir=SF_DIR):
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got = con.execute(sql)
        want = table([d[0] for d in got.description], got.fetchall())
        have = table(df.columns, [tuple(r) for r in df.collect()])
        assert have[0] == want[0]
        assert len(have[1]) == len(want[1])
        for a, b in zip(have[1], want[1], strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9), (a, b)

    return check
