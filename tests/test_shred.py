import pytest

from quarrylens.operators.shred import places, shred, shred_all, triples

SCHEMA = "k bigint, pos int, items array<struct<a:int,pos:string,inner:struct<x:double>,more:array<int>>>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nulls_empty_and_places(spark):
    df = spark.createDataFrame(
        [
            (1, 9, [(1, "p", (0.5,), [7, None, 8]), None, (None, None, None, None)]),
            (2, 9, []),
            (3, 9, None),
            (None, 9, [(5, "q", (None,), [])]),
            (1, 9, [(1, "p", (0.5,), None)]),
        ],
        SCHEMA,
    )
    got = shred(df, "k", "items")
    assert got.columns == ["k", "parent_pos", "pos", "ordinals", "a", "elem_pos", "inner_x"]
    assert sorted(((r.k, r.pos, r.a, r.elem_pos, r.inner_x) for r in got.collect()), key=repr) == sorted([(1, 0, 1, "p", 0.5), (1, 2, None, None, None), (None, 0, 5, "q", None), (1, 0, 1, "p", 0.5)], key=repr)
    deep = shred(df, "k", "items[].more")
    assert rows(deep.select("k", "parent_pos", "pos", "value", "ordinals")) == [(1, 0, 0, 7, [0, 0]), (1, 0, 2, 8, [0, 2])]


def test_empty_table_and_triples(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert shred(df, "k", "items").count() == 0 and triples(df, "k", "items", "items").count() == 0
    one = spark.createDataFrame([(1, 0, [(3, "z", (1.0,), [])])], SCHEMA)
    got = {(r.leaf_path, r.value) for r in triples(one, "k", "items", "items").collect()}
    assert {(p, v if p != "inner.x" else float(v)) for p, v in got} == {("", None), ("a", "3"), ("pos", "z"), ("inner.x", 1.0)}


def test_wide_and_long(spark):
    df = spark.createDataFrame([(i, 0, [(j, "t" * 5000, (1.0,), list(range(50))) for j in range(40)]) for i in range(30)], SCHEMA)
    assert shred(df, "k", "items").count() == 1200
    assert shred(df, "k", "items[].more").count() == 60000


def test_places(spark, sf):
    got = places(spark.read.parquet(f"{sf}/samples.parquet"), spark.read.parquet(f"{sf}/ledger.parquet"))
    assert got.columns == ["child", "record_id", "parent_pos", "pos"]


def test_all_tables_from_one_pass(spark, tmp_path):
    schema = "k bigint, child string, o struct<x:int,m:map<string,struct<p:int,q:array<int>>>>, a array<struct<key:int,b:array<array<string>>>>, t0 string"
    data = [
        (1, "c", (5, {"u": (1, [7, None]), "v": None}), [(3, [["s", None], None, []]), None], "z"),
        (2, None, None, None, None),
        (3, "d", (None, {}), [], "y"),
    ]
    df = spark.createDataFrame(data, schema)
    got = shred_all(df, "k")
    assert list(got.structs) == ["", "o.m{}", "o.m{}.value.q[]", "a[]", "a[].b[]", "a[].b[][]"]
    assert rows(got.table("")) == [(1, "c", 5, "z"), (2, None, None, None), (3, "d", None, "y")]
    assert got.table("").columns == ["k", "child", "o_x", "t0"]
    assert got.table("o.m{}").columns == ["k", "parent_pos", "pos", "ordinals", "key", "value_p"]
    assert sorted((r.k, r.parent_pos, r.key, r.value_p) for r in got.table("o.m{}").collect()) == [(1, -1, "u", 1), (1, -1, "v", None)]
    at = {r.key: r.pos for r in got.table("o.m{}").collect()}
    assert rows(got.table("o.m{}.value.q").select("k", "parent_pos", "pos", "value")) == [(1, at["u"], 0, 7)]
    assert rows(got.table("a").select("k", "pos", "key")) == [(1, 0, 3)]
    assert rows(got.table("a[].b").select("k", "parent_pos", "pos")) == [(1, 0, 0), (1, 0, 2)]
    assert rows(got.table("a[].b[][]").select("k", "parent_pos", "pos", "value", "ordinals")) == [(1, 0, 0, "s", [0, 0, 0])]
    plan = got.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got.write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == got.rows.count() == 3 + 2 + 1 + 1 + 2 + 1
    assert shred_all(df.limit(0), "k").rows.count() == 0
    assert shred_all(df, "k", ["a"], ["a", "a[].b"], values=False).rows.columns == ["k", "child", "parent_pos", "pos", "ordinals"]


def test_no_such_path(spark):
    df = spark.createDataFrame([], SCHEMA)
    for f in (lambda: shred(df, "k", "pos"), lambda: shred_all(df, "k", tables=["items[].a"]), lambda: shred_all(df, "k", tables=["items"]).table("items[].more")):
        with pytest.raises(ValueError):
            f()


def test_maps_of_a_slice(spark):
    df = spark.range(0, 50_000, 1, 3).selectExpr("id", "if(id % 3 = 0, null, map('a', id, 'b', id + 1)) AS m").filter("id % 2 = 0")
    got = shred_all(df, "id").table("m{}")
    assert got.filter("(key = 'a' AND value = id) OR (key = 'b' AND value = id + 1)").count() == got.count() == 2 * df.filter("m IS NOT NULL").count()
