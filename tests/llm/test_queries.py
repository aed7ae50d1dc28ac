"""The llm queries with SQL give DuckDB's rows; the others run with a stable schema, and those that share rows agree."""

from pathlib import Path

import duckdb
import pytest

from quarrylens.llm.queries import ORACLES, QUERIES


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else v


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
    assert sorted(repr([norm(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_queries_of_one_problem_agree(spark, sf):
    rates = QUERIES["p1_rates"](spark, sf).groupBy().sum("n_invalid").first()[0]
    assert rates == QUERIES["p1_found"](spark, sf).count()
    distinct = QUERIES["p5_distinct"](spark, sf).selectExpr("sum(n_copies - 1) AS further").first().further
    assert distinct == QUERIES["p5_found"](spark, sf).count()
    exact = {tuple(r) for r in QUERIES["p7_found"](spark, sf).collect()}
    near = QUERIES["p7_near"](spark, sf)
    # a passage of 24 equal words is one of 12
    assert {(r.doc_id, r.item_id) for r in near.filter("edits = 0").collect()} <= exact
    mix = QUERIES["p8_mix"](spark, sf).groupBy("source").sum("n_tokens").collect()
    used = {r.source: r.tokens_used for r in QUERIES["p8_shares"](spark, sf).collect() if r.tokens_used}
    assert {r[0]: r[1] for r in mix} == used
    assert {r.doc_id for r in QUERIES["p9_restored"](spark, sf).collect()} == {r.doc_id for r in QUERIES["p9_found"](spark, sf).collect()}
