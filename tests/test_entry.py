"""Every query with SQL against DuckDB, and the contract's shape."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from brindle import queries as core


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "~" if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["k"] for r in rows] == list(range(100, 200))
    assert {(r["range_count"], r["first_key"], r["last_key"]) for r in rows} == {(100, 100, 199)}


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    found = duck.sql(core.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


def test_entry_without_the_subpackage(tmp_path):
    """The entry module works where llm and the pipeline are gone."""
    root = Path(entry.__file__).parent
    import shutil

    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(core.QUERIES)), str(len(core.SQL))], out.stderr


def test_pushdown(spark, sf):
    """Range predicates and column choice reach the scan."""
    plan = core.QUERIES["range_incl"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "LessThanOrEqual(o_orderkey,200)" in plan
    assert "o_custkey" not in plan
    assert "TakeOrderedAndProject" in core.QUERIES["top_k"](spark, sf)._jdf.queryExecution().executedPlan().toString()
