"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one runs with a stable schema."""

from pathlib import Path

import duckdb
import pytest

from quarrylens.plans import core_queries, reference_queries

QUERIES = core_queries.QUERIES | reference_queries.QUERIES
ORACLES = core_queries.ORACLES | reference_queries.ORACLES


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: norm(x) for k, x in sorted(v.items())}
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(repr([norm(v) for v in r]) for r in cur.fetchall())
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
