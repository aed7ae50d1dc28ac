import ast
import json
import random
import tomllib
import warnings
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import syntax
from quarrylens.llm.lalr import Grammar, ParseError, Tables, parse

warnings.simplefilter("ignore")


def strict(text):
    def no(x):
        raise ValueError(x)

    return json.loads(text, parse_constant=no)


EXACT = {"python": ast.parse, "json": strict, "toml": tomllib.loads, "xml": ET.fromstring}


def exact(text, language):
    try:
        EXACT[language](text)
        return True
    except (SyntaxError, ValueError):
        return False


PYTHON = r'''
@dec(1, *a, k=2, **b)
async def f[T: int, *U, **V](a, /, b: int = 1, *c: *U, d, e=2, **k) -> list[T]:
    async with x as y, (z) as (p, q): pass
    with (open(a) as b, open(c),): pass
    with (a, b): pass
    async for i, *j in g(): await i
    else: pass
    return (yield), lambda *, x, y=1: x
class A(B, metaclass=C, *d): x: int = 1; y: "s"; (z): t
try: pass
except* (E, F) as g: raise X from Y
else: pass
finally: pass
match x, *y:
    case {"a": 1, **r} | [1, *_, 2.5+3j] if z: pass
    case A.b(c, d=-1) as e: pass
    case (1,) | "s" "t" | None: pass
    case _: pass
match = case = type = 1
type X[T] = int
print(f"{a!r:>{w}.{p}}{b=}{{}} {'q' if x else f'{y}'}" rf'\d{x}' "z")
a[1:2, ::3, *b, c:=1] = d = *e, f = {**g, 'h': 1, **i}, {*j, 1}, [k async for k in l if m if n]
x = 0x_ff + 1_0.5e-3j if not a is not b not in c else ~-d ** -e @ f
del a, (b.c, [d[0]]), e
global g; nonlocal h
x <<= yield
for a, in [b for c, in d]: pass
from . import (a as b, c,)
from ...d.e import *
assert x, y
if (n := 10) > 5: pass
elif 1: pass
else:
	pass
'''


def test_every_construct_parses():
    ast.parse(PYTHON)
    assert syntax.first_error(PYTHON, "python") is None


BAD_PYTHON = ["f(", "x = = 1", "def f(a=1, b): pass", "f(a=1, b)", "f(**a, *b)", "f(x for x in y, 1)", "1 = x", "f() += 1", "[a, b]: int", "(a, b) += 1", "for f() in x: pass", "del f()", "x != 0or y", "f'{a!x}'", "f'{a! r}'", "f'{a!rr}'", "with a as f(): pass", "x = (*a)", "{**a for a in b}", "if x:\npass", "  x", "if x:\n    a\n  b", "x = 'a", 'x = """a', "f'{'", "f'{a'", "f'}'", "b'é'", "'\\x1'", "012", "1_", "0x", "1a", "a ? b", "print x", "return = 1", "x\\", "a; ;b", "import a.b as c.d", "from a import", "lambda x=1, y: 0", "def f(*): pass", "def f(a, *, **k): pass", "try: pass", "async x", "else: pass", "match x:\n    pass\n    case 1: pass", "(a as b)", "x: int: y", "a := 1", "\0", "x = \ufeff1"]


@pytest.mark.parametrize("text", BAD_PYTHON)
def test_python_errors(text):
    assert not exact(text, "python") and syntax.first_error(text, "python") is not None


GOOD = {
    "json": ['{"a": [1, -0.5e+3, true, null, "\\u00e9\\n"], "b": {}}', " [] ", "1", '"x"', '{"a":1,"a":2}'],
    "toml": ['a = 1\n[b.c]\nd.e = "x"\n[[f]]\ng = [1, [2, 3],\n]\n[f.h]\n', "x = 2024-01-02T03:04:05.6+01:00 # c\r\ny = 1979-05-27\nz = 07:32:00", "a = '''\nx'y'''''\nb = {c = 1, d.e = 2}", "a = 0xff\nb = -inf\nc = 1_000.5e3", "", '"k e" = """\\\n  x"""', "[a]\n[a.b]\n", "[a.b]\n[a]\n"],
    "xml": ['<?xml version="1.0" encoding="utf-8"?>\n<!-- c --><a x="1" y=\'&lt;\'><b/>t &amp; &#xe9;<![CDATA[<&]]><?p q?></a>\n', '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>', '<x:a xmlns:x="u" x:b="1"/>'],
}
BAD = {
    "json": ["", "{", "[1,]", '{"a" 1}', "01", "NaN", "'a'", '"\n"', '"\\x"', "{} {}", "[1 2]", "tru", "+1", "1.", "\ufeff1"],
    "toml": ["a", "a = ", "a = 1 b = 2", "a = 1\na = 2", "[a]\n[a]", "a.b = 1\na = 2", "[a]\nb = 1\n[a.b]", "a = {b = 1,}", "a = {b = 1}\na.c = 2", "a = 01", "a = 1__0", 'a = "x', 'a = "\\z"', "a = 2024-13-01", "[[a]]\n[a]", "[a", "a = [1, 2", "a = 'x\ny'", "= 1", "a = tru", "[a]\nb.c = 1\n[a.b]\n", "a = +0x1"],
    "xml": ["", "<a>", "<a></b>", "<a><b></a></b>", "<a/><b/>", "<a x=1/>", "<a x='1' x='2'/>", "<a>&</a>", "<a>&x;</a>", "<a>]]></a>", "<a b='<'/>", "text", "<a>\x01</a>", "<!-- a -- b --><a/>", " <?xml version='1.0'?><a/>", "<a:b/>", "<1/>", "<a><!-- </a>", "<a b='1'c='2'/>", "<a>&#0;</a>"],
}


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    assert exact(text, language) and syntax.first_error(text, language) is None


@pytest.mark.parametrize("language, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_invalid(language, text):
    assert not exact(text, language) and syntax.first_error(text, language) is not None


def test_damaged_files_get_the_verdict_of_the_exact_parsers(spark, sf):
    rnd = random.Random(5)
    files = [r for t in ("samples", "negative_corpus") for r in syntax.source_files(spark.read.parquet(f"{sf}/{t}.parquet")).collect()]
    bits = ["(", ")", "[", "}", ":", ",", "=", '"', "'", "\\", "#", "\n", "\t", " ", "<", "&", "*", "f'{", " if ", "=1", "\n  "]
    for r in files:
        if r.source and r.grammar:
            for _ in range(4):
                i = rnd.randrange(len(r.source))
                j = i + rnd.choice([0, 1, 1, 3, 15, 10_000])
                text = r.source[:i] + rnd.choice(bits) * rnd.choice([0, 1]) + r.source[j:]
                assert (syntax.first_error(text, r.grammar) is None) == exact(text, r.grammar), (r.grammar, text)


def test_place_of_the_error():
    assert syntax.first_error("x = 1\ny = )\n", "python")[:2] == (2, 5)
    assert syntax.first_error('{"a": 1,\n "b" 2}', "json")[:2] == (2, 6)


def test_table(spark):
    rows = [(1, "r", "python", "a.py", "x = 1", "file", None), (2, "r", None, "b.PY", "x = (", "file", None), (3, None, "json", "c.json", None, "file", None), (4, "r", "python", "d.txt", "x", "file", None), (5, "r", "python", None, "x", None, None), (6, "r", "python", "e.py", "    return 1\n", "completion", "def f():\n"), (7, "r", "python", "e.py", "    return 1\n", "completion", None), (8, "r", "json", "f.json", "", "file", None), (9, "r", "python", "g.py", "x = [\n" + "1,\n" * 30_000 + "]", "file", None)]
    df = spark.createDataFrame(rows, "record_id bigint, repo string, language string, file_path string, generated_code string, code_form string, prompt string").withColumn("error", F.lit("clash"))
    got = {r.record_id: r for r in syntax.check_files(syntax.source_files(df)).collect()}
    assert {k: r.parses for k, r in got.items()} == {1: True, 2: False, 3: None, 4: None, 5: None, 6: True, 7: False, 8: False, 9: True}
    assert (got[3].error, got[4].error, got[7].error_line) == ("no source", "no grammar", 1)
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in syntax.invalid_rates(syntax.check_files(syntax.source_files(df))).collect()}
    assert rates == {("r", "python"): (5, 2), ("r", "json"): (1, 1)}
    assert syntax.check_files(syntax.source_files(df.limit(0))).count() == 0
    clash = syntax.check_files(syntax.source_files(df).withColumn("error", F.lit("old")))
    assert clash.columns.count("error") == 1 and clash.filter("record_id = 1").first().error is None


def test_conflicts_and_streams_without_end():
    with pytest.raises(ValueError):
        Tables(Grammar("s: s 'a' s | 'b'"))
    t = Tables(Grammar("%left 'a'\ns: s 'a' s | 'b'"))
    assert parse(t, [("b", 0, 1), ("a", 1, 0), ("b", 2, 1), ("$end", 3, 0)], {}) == 0
    with pytest.raises(ParseError):
        parse(t, [("b", 0, 1)], {})
