import json
from datetime import datetime

import pytest

from quarrylens.operators.drift import catalogue, changes, consistent, footers, parse_object

SCHEMA = "artifact string, stream string, file_name string, file_stamp timestamp, line_no int, raw_line string, other int"


def lines(spark, *files, stream="s"):
    rows = []
    for i, f in enumerate(files):
        for n, o in enumerate(f):
            rows.append(("a", stream, f"f{i}", datetime(2024, 1, i + 1), n, o if o is None or isinstance(o, str) else json.dumps(o), 0))
    return spark.createDataFrame(rows, SCHEMA)


def log(spark, *files):
    return sorted(tuple(r)[2:] for r in changes(lines(spark, *files)).collect())


def test_added_removed_types(spark):
    got = log(spark, [{"id": "1", "a": 1, "b": None}], [{"id": "1", "a": "1", "c": [1]}])
    assert got == [("f1", "added", "c", ""), ("f1", "removed", "b", ""), ("f1", "type_changed", "a", "")]


def test_null_only_fields_change_no_type(spark):
    assert log(spark, [{"id": "1", "a": None}], [{"id": "1", "a": 3}]) == []


def test_rename_moves_and_objects(spark):
    one = [{"id": str(i), "n": i, "o": {"x": i, "y": [{"q": i}]}} for i in range(3)]
    two = [{"id": str(i), "m": i, "p": {"x": i, "y": [{"q": i}]}} for i in range(1, 4)]
    assert log(spark, one, two) == [("f1", "renamed", "m", "n"), ("f1", "renamed", "p", "o"), ("f1", "renamed", "p.x", "o.x"), ("f1", "renamed", "p.y", "o.y"), ("f1", "renamed", "p.y[].q", "o.y[].q")]
    moved = log(spark, [{"id": "1", "n": 5, "k": 1}], [{"id": "1", "box": {"n": 5}, "k": 1}])
    assert moved == [("f1", "added", "box", ""), ("f1", "renamed", "box.n", "n")]


def test_other_values_or_no_shared_record_is_no_rename(spark):
    assert log(spark, [{"id": "1", "n": 5}], [{"id": "1", "m": 6}]) == [("f1", "added", "m", ""), ("f1", "removed", "n", "")]
    assert log(spark, [{"id": "1", "n": 5}], [{"id": "2", "m": 5}]) == [("f1", "added", "m", ""), ("f1", "removed", "n", "")]


def test_lines_that_count_for_nothing(spark):
    bad = [None, "", "  ", "null", "[1]", '{"a": 1', 'x{"a":1}', '{"a": NaN}']
    assert all(parse_object(b) is None for b in bad)
    assert log(spark, [{"id": "1", "a": 1}, *bad], [{"id": "1", "a": 1}, {"id": "1", "a": 1}]) == []
    assert changes(lines(spark)).count() == 0


def test_gap_is_two_lifespans(spark):
    files = [[{"id": "1", "a": 1}], [{"id": "1"}], [{"id": "1", "a": 2}]]
    assert log(spark, *files) == [("f1", "removed", "a", ""), ("f2", "added", "a", "")]
    spans = sorted((r.path, r.first_seq, r.last_seq) for r in catalogue(lines(spark, *files)).collect())
    assert spans == [("a", 1, 1), ("a", 3, 3), ("id", 1, 3)]


def test_consistent_table(spark):
    t = lines(spark, [{"id": "1", "n": 1, "w": 1}], [{"id": "1", "m": 1, "w": "x"}, {"id": "2", "m": 2.5, "w": None}])
    foot = footers(t, ["artifact", "stream", "file_name", "file_stamp"], "raw_line", shapes=True)
    got = consistent(t, changes(t), foot, ["file_name", "line_no"])
    assert dict(got.dtypes)["m"] == "double" and dict(got.dtypes)["w"] == "string" and "n" not in got.columns
    assert sorted((r.file_name, r.id, r.m, r.w) for r in got.collect() if r.w) == [("f0", "1", 1.0, "1"), ("f1", "1", 1.0, "x")]


def one_table(spark, *tables):
    t = tables[0]
    for more in tables[1:]:
        t = t.unionByName(more)
    foot = footers(t, ["artifact", "stream", "file_name", "file_stamp"], "raw_line", shapes=True)
    return consistent(t, changes(t), foot, ["stream", "file_name"])


def test_names_linked_by_renames_are_one_column(spark):
    # a cycle in one stream, a branch of it in another, and a third stream in which nothing is renamed
    cycle = lines(spark, [{"id": "1", "hits": 7}], [{"id": "1", "counts": {"hits": 7}}], [{"id": "1", "hits": 7}, {"id": "2", "hits": 8}])
    branch = lines(spark, [{"id": "1", "hits": 5}], [{"id": "1", "score": {"hits": 5}}], stream="t")
    plain = lines(spark, [{"id": "1", "hits": 9}], stream="u")
    got = one_table(spark, cycle, branch, plain)
    names = [c for c in got.columns if "hits" in c]
    assert len(names) == 1
    assert sorted(r[names[0]] for r in got.collect()) == [5, 5, 7, 7, 7, 8, 9] and got.filter("clashes IS NOT NULL").count() == 0


def test_name_taken_up_again_is_another_field(spark):
    # n becomes m; later another n stands beside m. In stream t both stand side by side from the start.
    again = lines(spark, [{"id": "1", "n": 1}], [{"id": "1", "m": 1}], [{"id": "1", "m": 1, "n": "x"}])
    got = one_table(spark, again, lines(spark, [{"id": "1", "m": 3, "n": "y"}], stream="t"))
    assert sorted((r.stream, r.file_name, r.m, r.n) for r in got.collect()) == [("s", "f0", 1.0, None), ("s", "f1", 1.0, None), ("s", "f2", 1.0, "x"), ("t", "f0", 3.0, "y")]


def test_fields_below_a_renamed_object_follow_it(spark):
    one = lines(spark, [{"id": "1", "o": 1}], [{"id": "1", "p": 1}], [{"id": "1", "p": {"x": 2}}])
    two = lines(spark, [{"id": "1", "o": {"x": 2}}], [{"id": "1", "p": {"x": 2}}], stream="t")
    got = one_table(spark, one, two)
    assert "o__x" not in got.columns and sorted(r.p__x for r in got.collect() if r.p__x is not None) == [2, 2, 2]


def test_values_without_a_place_are_reported(spark):
    files = [[{"id": "1", "n": 1}], [{"id": "1", "m": 1}], [{"id": "1", "n": 2, "m": 3}], [{"id": "1", "m": 2, "k": 3}]]
    got = one_table(spark, lines(spark, *files))
    values = sorted(v for r in got.collect() for c, v in r.asDict().items() if c not in ("stream", "file_name", "id", "clashes") and v is not None)
    assert values == [1, 1, 2, 2, 3, 3] or got.filter("clashes IS NOT NULL").count() > 0


def test_classes_of_names():
    from quarrylens.operators.drift import _classes

    cycle, far, below = ("a", "b", "a"), ("a", "c"), ("b.x", "c.x")
    assert _classes({cycle: 1, far: 1, ("c",): 1, below: 1, ("a.x",): 1, ("d",): 1}, set()) == [[("a", "b", "a"), ("a", "c"), ("c",)], [("a.x",)], [("b.x", "c.x")], [("d",)]]
    assert [("b.x",), ("c.x",)] in _classes({("b", "c"): 1, ("b",): 1, ("c",): 1, ("b.x",): 1, ("c.x",): 1}, set())
    # n and k both end as m, but stand side by side elsewhere: m is two fields
    got = _classes({("n", "m"): 1, ("k", "m"): 1, ("n",): 1, ("k",): 1}, {frozenset([("n",), ("k",)])})
    assert got == [[("k",), ("k", "m")], [("n",), ("n", "m")]]


def test_array_fields_do_not_crowd_out_columns(spark):
    wide = {"id": "1", "v": 1, "a": [{f"f{i}": i for i in range(60)}], "o": {"x": {"y": {"z": 2}}}}
    t = lines(spark, [wide])
    foot = footers(t, ["artifact", "stream", "file_name", "file_stamp"], "raw_line", shapes=True)
    got = consistent(t, changes(t), foot, ["file_name"], max_columns=4)
    assert set(got.columns) == {"file_name", "id", "v", "a", "o__x__y__z", "clashes"}
    with pytest.raises(ValueError):
        consistent(t, changes(t), foot, ["file_name"], max_columns=3)


def test_casts(spark):
    files = [
        [{"id": "1", "z": 1.5, "ok": True, "tag": "a", "list": [1, 2], "one": ["x"], "o": {"value": 1, "unit": "s"}}, {"id": "9", "z": None, "ok": None}],
        [{"id": "2", "z": "2.5", "ok": "false", "tag": ["b"], "list": [3], "one": ["y"], "o": {"value": 2, "unit": "s"}}],
        [{"id": "3", "z": [3.5], "ok": 1, "tag": {"value": "c", "shown": "c"}, "list": [], "one": []}],
        [{"id": "4", "z": {"value": 4.5, "shown": "4.5"}, "ok": [0], "tag": "7", "list": 5}],
    ]
    got = one_table(spark, lines(spark, *files))
    assert set(got.columns) == {"stream", "file_name", "id", "z", "ok", "tag", "list", "one", "o__value", "o__unit", "clashes"}
    types = dict(got.dtypes)
    assert (types["z"], types["ok"], types["tag"], types["list"], types["one"], types["o__value"]) == ("double", "boolean", "string", "string", "string", "double")
    rows = {r.id: (r.z, r.ok, r.tag, r.list, r.one) for r in got.collect()}
    assert rows == {"1": (1.5, True, "a", "[1, 2]", '["x"]'), "9": (None,) * 5, "2": (2.5, False, "b", "[3]", '["y"]'), "3": (3.5, True, "c", "[]", "[]"), "4": (4.5, False, "7", "5", None)}
    assert got.schema["z"].metadata["paths"] == ["z"] and got.filter("clashes IS NOT NULL").count() == 0


def test_opposite_renames_in_three_streams(spark):
    tables = [
        lines(spark, [{"id": "1", "z": 1}], [{"id": "1", "score": {"z": 1}}], [{"id": "1", "Z": 1}], stream="s"),
        lines(spark, [{"id": "1", "Z": 2}], [{"id": "1", "z": 2}], stream="t"),
        lines(spark, [{"id": "1", "score": {"z": 3}}], [{"id": "1", "z": {"value": 3, "shown": "3"}}], stream="u"),
    ]
    got = [one_table(spark, *ts) for ts in (tables, tables[::-1])]
    assert got[0].columns == got[1].columns and len(got[0].columns) == 5
    name = next(c for c in got[0].columns if c.lower().endswith("z"))
    for t in got:
        assert sorted(r[name] for r in t.collect()) == [1, 1, 1, 2, 2, 3, 3] and dict(t.dtypes)[name] == "double"
        assert set(t.schema[name].metadata["paths"]) == {"z", "Z", "score.z"}


def test_given_aliases(spark):
    # no record links the names, and where both stand in one file they stay apart
    t = lines(spark, [{"id": "1", "n": 1, "q": 4}]).unionByName(lines(spark, [{"id": "2", "m": 2, "q": 5, "r": 6}], stream="t"))
    foot = footers(t, ["artifact", "stream", "file_name", "file_stamp"], "raw_line", shapes=True)
    plain = consistent(t, changes(t), foot, ["stream"])
    assert {"n", "m", "q", "r"} <= set(plain.columns)
    got = consistent(t, changes(t), foot, ["stream"], aliases={"n": "m", "q": "r"})
    assert "n" not in got.columns and sorted(r.m for r in got.collect()) == [1, 2] and got.schema["m"].metadata["paths"] == ["m", "n"]
    assert sorted((r.q, r.r) for r in got.collect()) == [(4, None), (5, 6)]
