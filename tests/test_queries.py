"""Queries against their SQL on the smallest tables, and the promise that nothing needs the llm subpackage."""

import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CORE = {name: f for plan in entry._PLANS for name, f in plan.QUERIES.items()}
CORE_SQL = {name: s for plan in entry._PLANS for name, s in plan.SQL.items()}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


def same_rows(spark, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_query_equals_sql(spark, name):
    same_rows(spark, CORE[name], CORE_SQL[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(CORE) - set(CORE_SQL)))
def test_query_runs(spark, name):
    assert CORE[name](spark, DATA).count() >= 0


def test_core_imports_without_llm():
    code = "import sys; sys.modules['goldspan.llm'] = None\nimport goldspan.plans.core, goldspan.plans.catalogue, goldspan.streaming.streams, goldspan.operators.loads"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    code = "import sys; sys.modules['goldspan.llm'] = None\nimport __spark_entry__ as e; assert 'p6_found' in e.queries() and not any(n.startswith(('p1_', 'p5_')) for n in (*e.queries(), *e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
    for folder, _, files in os.walk(os.path.join(ROOT, "goldspan")):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "goldspan.llm" not in open(os.path.join(folder, f)).read()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["p3_profile_whole", "p3_expressions"])
def test_every_column_of_a_load_is_profiled(spark, name):
    want = set(spark.read.parquet(f"{DATA}/load_extract.parquet").columns) - {"load_no", "source_system"}
    assert {r.attr_name for r in CORE[name](spark, DATA).select("attr_name").distinct().collect()} == want
