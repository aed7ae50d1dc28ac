import json

import pytest
from pyspark.sql import functions as F

from quarrylens.sources import jsonl


def put(path, *lines):
    path.write_text("\n".join(lines))
    return str(path)


def test_strict_reader(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"id": "é", "n": 1}', "", "  ", '{"id": "b"}')
    assert sorted(tuple(r) for r in jsonl.read_jsonl(spark, p, "id string, n int").fillna(0).collect()) == [("b", 0), ("é", 1)]
    for bad in ("[1]", "nope", '{"id": '):
        with pytest.raises(Exception, match="JSON|MALFORMED|malformed"):
            jsonl.read_jsonl(spark, put(tmp_path / "b.jsonl", bad), "id string").collect()


def test_unique_ids(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert jsonl.unique_ids(df, "id").count() == 2
    with pytest.raises(Exception, match="repeated id a"):
        jsonl.unique_ids(df.unionByName(df.limit(1)), "id").collect()


def test_tolerant_ids(spark):
    good = [json.dumps({"id": f"x{i}"}) for i in range(10)]
    df = spark.createDataFrame([(x,) for x in [*good, good[0], '{"id": 5}', '{"id": ""}', "", None, "broken"]], "l string")
    assert jsonl.tolerant_ids(df, "l").count() == 10
    with pytest.raises(Exception, match="too many malformed"):
        jsonl.tolerant_ids(spark.createDataFrame([("x",), (good[0],)], "l string"), "l").collect()


def test_documents_and_versions(spark, tmp_path):
    p = put(tmp_path / "d.json", '{"schema_version": 2,', '"rows": [{"a": 1}, {"a": 2}]}')
    assert jsonl.read_versioned(spark, p, "a:int", 2).count() == 2
    with pytest.raises(Exception, match="version 3"):
        jsonl.read_versioned(spark, p, "a:int", 3).collect()
    assert jsonl.read_json(spark, p).first().schema_version == 2


def test_logs_latest_and_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("entropy=0.5 entropy=2",), ("none",), ("x entropy=-3",)], "l string")
    assert sorted(r.value for r in jsonl.log_values(lines, "l", r"entropy=(-?\d+(?:\.\d+)?)").collect()) == [-3.0, 0.5]
    put(tmp_path / "f1.jsonl", "{}")
    assert jsonl.latest_file(spark, str(tmp_path / "*.jsonl")).first().path.endswith("f1.jsonl")
    assert jsonl.latest_file(spark, str(tmp_path / "no*.txt")).count() == 0
    df = spark.createDataFrame([("a", None), ("b", "ü")], "id string, v string")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert '"v":null' in "".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))
    for _ in range(2):
        jsonl.append_new(df, str(tmp_path / "sink"), ["id"])
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2
    jsonl.write_document(df.limit(1), str(tmp_path / "doc"))
    assert len(list((tmp_path / "doc").glob("*.json"))) == 1


def test_typed_fields(spark):
    from pyspark.sql import functions as F

    rows = [('{"a": 5}',), ('{"a": 5.5}',), ('{"a": "5"}',), ('{"a": true}',), ('{"a": null}',), ("{}",), ("x",), (None,)]
    v = F.try_parse_json("l")
    df = spark.createDataFrame(rows, "l string").select(*[jsonl.typed(v, "$.a", k).alias(k) for k in ("integer", "number", "string", "boolean")], jsonl.typed(v, "$.a", "number", high=5).alias("low"))
    assert [tuple(r) for r in df.collect()] == [(5, 5.0, None, None, 5.0), (None, 5.5, None, None, None), (None, None, "5", None, None), (None, None, None, True, None), *[(None,) * 5] * 4]


def test_config(tmp_path):
    from quarrylens.config import resolve

    p = put(tmp_path / "c.json", '{"extract": {"fpr": 0.05, "mode": "x"}}')
    base = {"fpr": 0.01, "mode": "semantic", "k": 1}
    assert resolve(base, {"mode": "dual", "k": None}, p, "extract") == {"fpr": 0.05, "mode": "dual", "k": 1}
    with pytest.raises(ValueError, match="unknown"):
        resolve(base, {"other": 1})


def test_pair(spark, tmp_path):
    df = spark.range(3)
    jsonl.write_pair(df, str(tmp_path / "a"), df.limit(1), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_splits_and_empty_solutions(spark, tmp_path):
    from quarrylens.sources.tables import load_splits, normal_source

    spark.createDataFrame([(1, "p", "c"), (2, None, "d")], "id int, prompt string, code string").write.parquet(str(tmp_path / "s" / "train"))
    spark.createDataFrame([(3, "e", 0)], "id int, code string, other int").write.parquet(str(tmp_path / "s" / "test"))
    got = load_splits(spark, str(tmp_path / "s"), {"id": "id", "prompt": "prompt", "code": "code"})
    assert sorted(map(tuple, got.collect())) == [("test", 3, None, "e"), ("train", 1, "p", "c"), ("train", 2, None, "d")]
    whole = lambda name: {r.s for r in got.select(normal_source(F.lit(name), F.col("prompt"), F.col("code")).alias("s")).collect()}
    assert whole("humaneval") == {"pc", "d", "e"} and whole("mbpp") == {"c", "d", "e"}
    for bad in (None, "", " \n"):
        with pytest.raises(Exception, match="empty solution"):
            spark.createDataFrame([("x", bad)], "p string, c string").select(normal_source(F.lit("mbpp"), F.col("p"), F.col("c"))).collect()
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        load_splits(spark, str(tmp_path / "none"), {"id": "id"})
