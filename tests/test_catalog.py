"""Every core query with SQL agrees with DuckDB on the smallest data set."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from lakeloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW \"{p.stem}\" AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, names, order):
    at = [names.index(n) for n in order]
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (float, int)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    found = db.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert plain(got, df.columns, order) == plain(found.fetchall(), names, order)


def test_the_library_does_without_llm():
    for p in Path(__file__).parents[1].glob("lakeloom/**/*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.MULTILINE), p
