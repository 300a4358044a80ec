import importlib
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
CORE = importlib.import_module("tabulon.operators.queries")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE.SQL))
def test_query_equals_sql(spark, duck, small, name):
    got = CORE.queries()[name](spark, small)
    columns = sorted(got.columns)
    want = duck.execute(CORE.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE.queries()) - set(CORE.SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert CORE.queries()[name](spark, small).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['tabulon.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "tabulon").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tabulon.llm" not in path.read_text(encoding="utf-8"), path
