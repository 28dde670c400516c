"""Every registered graph query against its SQL, and the entry points."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from halyard import queries


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(values, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(([round(v[k], 8) if isinstance(v[k], float) else v[k] for k in order] for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = queries.QUERIES[name](spark, sf_dir)
    want = tables.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_entry_points():
    code = "import __spark_entry__ as e; q = e.queries(); assert callable(e.entry) and len(q) >= 33 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
