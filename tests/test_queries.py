"""Every registered query of the library against its DuckDB text, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallystone.plans import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, (int, float)):
        return float(f"{v:.9g}")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(rows, key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_nulls_come_last_and_are_all_there(spark):
    rows = registry.QUERIES["o05_nulls_last_whole"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/customer.parquet").count()
    keys = [(r["o_orderkey"] is None, r["o_orderkey"] or 0, r["c_custkey"]) for r in rows]
    assert keys == sorted(keys) and keys[-1][0] and not keys[0][0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_opens_no_file_of_spark(tmp_path):
    """The entry file imports where Spark's jars lie elsewhere: a `pyspark` that says that it lives in an empty folder."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import pyspark; pyspark.__file__ = sys.argv[1] + '/__init__.py'; import __spark_entry__ as e; assert len(e.oracle_sql()) > 150"
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", "import sys; sys.path.insert(0, sys.argv[2]); " + code, str(tmp_path), root], check=True, timeout=120)
