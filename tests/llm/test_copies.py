import json
import random

import pytest

from quarrylens.llm import copies as C
from quarrylens.llm.copies import components, copies, flat, merkle


def pairs(spark, rows, **kw):
    df = spark.createDataFrame(rows, "record_id bigint, generated_code string, first_id string")
    distinct, got = copies(df, **kw)
    return sorted(tuple(r) for r in got.collect()), sorted(tuple(r) for r in distinct.collect())


def test_formatting_case_order_and_nulls(spark):
    a, b = {"x": 1, "y": {"p": [1, {"u": 2, "v": "Ab-c"}], "q": None}}, {"y": {"q": None, "p": [1, {"v": "abc", "u": 2}]}, "x": 1}
    rows = [(1, "def f(x):\n  return x"), (2, "DEF F ( X ) : return_x"), (3, "def f(x): return y"), (4, None), (5, json.dumps(a, indent=2)), (6, json.dumps(b)), (7, json.dumps({**b, "x": 2})), (8, ""), (9, " -- "), (10, "def f(x):\n  return x"), (11, json.dumps({"x": 1, "y": {"p": [{"u": 2, "v": "abc"}, 1], "q": None}}))]
    got, distinct = pairs(spark, [(*r, "clash") for r in rows])
    assert got == [(1, 2), (1, 10), (5, 6), (8, 9)]
    assert distinct == [(1, 3), (3, 1), (5, 2), (7, 1), (8, 2), (11, 1)]


def test_links_over_third_records(spark):
    # a broken copy of one order of fields equals that order's text, and the orders are one object
    rows = [(3, '{"a": 1, "b": 2}'), (1, '{"a" 1 "b" 2'), (2, '{"b": 2, "a": 1}'), (4, "b2 a1")]
    assert pairs(spark, [(*r, "") for r in rows])[0] == [(1, 2), (1, 3), (1, 4)]


def test_hot_group_and_empty(spark):
    rows = [(i, "x = 1" + " " * (i % 7), "") for i in range(12_000)] + [(20_000, "y", "")]
    got, distinct = pairs(spark, rows, hot_share=0.01)
    assert len(got) == 11_999 and {f for f, _ in got} == {0} and distinct == [(0, 12_000), (20_000, 1)]
    assert pairs(spark, []) == ([], [])


def test_merkle():
    assert merkle("[1]") is None and merkle('{"a": 1') is None and merkle("{a}") is None and merkle("{}") is not None
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert merkle(deep) is not None
    rnd = random.Random(2)

    def shuffled(o):
        if isinstance(o, dict):
            items = [(k, shuffled(v)) for k, v in o.items()]
            rnd.shuffle(items)
            return dict(items)
        return [shuffled(x) for x in o] if isinstance(o, list) else o

    doc = {f"k{i}": {"l": [i, {"m": i, "n": [i]}], "t": f"T {i}"} for i in range(20)}
    assert all(merkle(json.dumps(shuffled(doc)))[0] == merkle(json.dumps(doc).upper().replace("NULL", "null"))[0] for _ in range(5))
    assert flat("Straße_1-É") == flat("STRASSE 1é")


def test_a_repeated_key(spark):
    # equal rows count once, another content under the key is a record of its own class
    rows = [(1, "a b", ""), (1, "a b", ""), (2, "ab", ""), (2, "c", ""), (3, "C!", ""), (4, "d", ""), (4, "D", "")]
    assert pairs(spark, rows) == ([(1, 2), (2, 3)], [(1, 2), (2, 2), (4, 1)])


@pytest.mark.parametrize("n", [2, 3, 40, 257])
def test_components(spark, n):
    rnd = random.Random(n)
    names = [f"{i:04d}".encode() for i in range(n)]
    order = rnd.sample(names, n)  # one long chain, and one that is a star
    edges = list(zip(order, order[1:])) + [(b"z9", b"z" + bytes([i])) for i in range(20)] + [(b"q", b"q")]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u binary, v binary")).collect()))
    want = {x: names[0] for x in names[1:]} | {b"z" + bytes([i]): b"z\0" for i in range(1, 20)} | {b"z9": b"z\0"}
    assert {bytes(k): bytes(v) for k, v in got.items()} == want


def test_a_long_chain_of_links(spark):
    # text i and i + 1 share a tree or a text in turn: a broken copy of each order of fields links to it by its letters
    a = ['{"a": 1, "b": 2, "c": 3}', '{"b": 2, "a": 1, "c": 3}', '{"c": 3, "b": 2, "a": 1}']
    rows = [(10 + i, t, "") for i, t in enumerate(a)] + [(20 + i, t.replace(":", " "), "") for i, t in enumerate(a)]
    assert pairs(spark, rows) == ([(10, x) for x in (11, 12, 20, 21, 22)], [(10, 6)])


@pytest.mark.parametrize("text, other", [("x y", "xz"), ('{"a": 1, "b": 2}', '{"b": 2, "a": 3}')])
def test_a_collision_is_an_error(spark, monkeypatch, text, other):
    # digests of eight bits: hundreds of contents must collide
    rows = [(i, f"{text} {i}" if text[0] == "x" else text.replace("1", str(i)), "") for i in range(600)]
    src = C._h

    def short(*parts):
        return src(*parts)[:1]

    monkeypatch.setattr(C, "_h", short)
    with pytest.raises(Exception, match="digest collision"):
        pairs(spark, rows)


def test_one_object_in_very_many_orders(spark):
    # one tree under thousands of texts, more than a task should gather; a hub of the graph of texts
    rnd = random.Random(1)
    fields = [f'"f{i}": {i}' for i in range(9)]
    rows = [(i, "{" + ", ".join(rnd.sample(fields, 9)) + "}", "") for i in range(10_500)]
    got, distinct = pairs(spark, rows)
    assert [f for f, _ in got] == [0] * 10_499 and distinct == [(0, 10_500)]
