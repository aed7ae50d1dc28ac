import ast
import itertools
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.code import blocks, texts
from quarrylens.code.rules import NEGATIVE, POSITIVE, RULES, apply_rule, variants
from quarrylens.plans import code_queries
from quarrylens.streaming import closing


def shape(code):
    return [(b.node_type, b.block_type, b.depth, b.parent_id) for b in blocks.statement_blocks(code)]


def test_blocks():
    assert shape("x = 1") == [("expression_statement", "simple", 0, None)]
    assert shape("if a:\n    for x in y:\n        print(x)") == [("if_statement", "compound", 0, None), ("for_statement", "compound", 1, 0), ("expression_statement", "simple", 2, 1)]
    assert shape("") == [] and shape(None) == [] and shape("def (") == []
    elif_ = "if a:\n    x = 1\nelif b:\n    y = 2\nelse:\n    if c:\n        z = 3\n"
    assert [d for _, _, d, _ in shape(elif_)] == [0, 1, 1, 1, 2]
    assert shape("    pass")[0][0] == "pass_statement" and blocks.statement_blocks("    pass")[0].start_line == 1
    assert len(blocks.statement_blocks("x = 1\n" * 3000)) == 3000


def test_entropy_units():
    assert blocks.entropy_units("pass") == 3571 and blocks.entropy_units("  \n") == 0


@pytest.mark.parametrize(
    "tree, total, chosen",
    [([(0, None, 1), (1, 0, 0), (2, 0, 0)], 1, [0]), ([(0, None, 0), (1, 0, 1), (2, 0, 1)], 2, [1, 2]), ([(0, None, 0), (1, 0, 0), (2, 1, 1)], 1, [2]), ([(0, None, 1), (1, 0, 1)], 1, [1]), ([], 0, [])],
)
def test_tree_selection(tree, total, chosen):
    assert blocks.select_tree(tree) == (total, chosen)


CASES = {
    "explicit_default_print": ("print(x)", "print(x, flush=False)"),
    "explicit_default_range": ("range(n)", "range(0, n)"),
    "explicit_default_open": ("open(p)", "open(p, closefd=True)"),
    "explicit_default_sorted": ("sorted(x)", "sorted(x, reverse=False)"),
    "explicit_default_min_max": ("min(x)", "min(x, key=None)"),
    "explicit_default_zip": ("zip(a, b)", "zip(a, b, strict=False)"),
    "explicit_default_random_seed": ("random.seed(1)", "random.seed(1, version=2)"),
    "explicit_default_html_escape": ("html.escape(s)", "html.escape(s, quote=True)"),
    "explicit_default_round": ("round(x)", "round(x, ndigits=None)"),
    "explicit_default_json_dump": ("json.dumps(x)", "json.dumps(x, indent=None)"),
    "library_alias_replace": ("np.sum(x)", "numpy.sum(x)"),
    "third_party_func_replace": ("max(x)", "np.max(x)"),
    "list_init": ("x = []", "x = list()"),
    "dict_init": ("x = dict()", "x = {}"),
    "type_check": ("isinstance(x, int)", "type(x) == int"),
    "string_format": ("'%s' % x", "'{}'.format(x)"),
    "loop_convert": ("for i in range(n):\n    f(i)", "i = 0\nwhile i < n:\n    f(i)\n    i += 1"),
    "iteration_convert": ("for x in xs:\n    f(x)", "for _i in range(len(xs)):\n    x = xs[_i]\n    f(x)"),
    "comprehension_convert": ("[f(x) for x in xs]", "list(map(lambda x: f(x), xs))"),
    "branch_flip": ("if c:\n    a()\nelse:\n    b()", "if not c:\n    b()\nelse:\n    a()"),
    "operand_swap": ("a + b", "b + a"),
    "comparison_flip": ("a < b", "b > a"),
    "unary_simplify": ("not not x", "x"),
    "demorgan": ("a and b", "not (not a or not b)"),
    "arithmetic_associativity": ("a * (b + c)", "a * b + a * c"),
    "variable_rename": ("my_name = 1", "myName = 1"),
    "name_obfuscation": ("def get_x(): pass", "def fetch_x(): pass"),
    "fix_spacing": ("x=a+b", "x = a + b"),
    "fix_comment_symbols": ("## note\nx = 1", "# note\nx = 1"),
    "neg_min_max_flip": ("min(x)", "max(x)"),
    "neg_any_all_flip": ("any(x)", "all(x)"),
    "neg_sorted_reverse": ("sorted(x)", "sorted(x, reverse=True)"),
    "neg_open_mode": ("open(p, 'r')", "open(p, 'w')"),
    "neg_extend_append": ("a.append(x)", "a.extend(x)"),
    "neg_starts_ends": ("s.startswith(p)", "s.endswith(p)"),
    "neg_ceil_floor": ("math.ceil(x)", "math.floor(x)"),
    "neg_off_by_one": ("range(n)", "range(n - 1)"),
    "neg_break_continue": ("while x:\n    break", "while x:\n    continue"),
    "neg_if_else_body_swap": ("if c:\n    a()\nelse:\n    b()", "if c:\n    b()\nelse:\n    a()"),
    "neg_membership": ("a in b", "a not in b"),
    "neg_yield_return": ("def f():\n    yield 1", "def f():\n    return 1"),
    "neg_eq_neq": ("a == b", "a != b"),
    "neg_arithmetic_op": ("a + b", "a - b"),
    "neg_and_or": ("a and b", "a or b"),
    "neg_bounds_narrow": ("a <= b", "a < b"),
    "neg_aug_assign": ("a += 1", "a = 1"),
    "neg_shift_flip": ("a << b", "a >> b"),
    "neg_scope_var": ("i = j", "j = i"),
    "neg_slice_step": ("x[::-1]", "x[::1]"),
    "neg_dict_view": ("d.keys()", "d.values()"),
    "neg_exception_swallow": ("try:\n    f()\nexcept E:\n    raise", "try:\n    f()\nexcept E:\n    pass"),
    "neg_sys_exit": ("sys.exit(0)", "sys.exit(1)"),
}


def test_all_rules_have_a_case():
    assert len(POSITIVE) == 29 and len(NEGATIVE) == 23 and set(CASES) == set(RULES)


@pytest.mark.parametrize("rule", sorted(CASES))
def test_rule(rule):
    before, after = CASES[rule]
    assert apply_rule(rule, before) == after
    ast.parse(after)
    assert apply_rule(rule, "def (") is None and apply_rule(rule, "pass") is None


def test_rules_on_other_letters():
    assert apply_rule("operand_swap", "é = 'ü' + b") == "é = b + 'ü'"
    assert apply_rule("neg_eq_neq", "x = 'ß' == y\r\nz = 1") == "x = 'ß' != y\r\nz = 1"


def test_variants():
    got = list(variants("x = [] + y", longest=2, most=3))
    assert [n for n, _, _ in got] == [0, 1, 2] and all(len(set(r)) == len(r) for _, r, _ in got)
    assert list(variants("pass")) == []


def test_normal_form_and_perturbations():
    assert texts.normal_form("x=1 # c") == texts.normal_form("x = 1") and texts.normal_form(" def ( ") == "def (" and texts.normal_form(None) != "x"
    code = "def f(a):\n    b = a\n    return b\n"
    assert "b_renamed" in texts.rename_local(code) and texts.light_rewrite(code).count("__value") == 2 and "    b = a\n" in texts.light_rewrite(code)
    assert texts.add_comment(texts.add_comment(code)) == texts.add_comment(code) and texts.add_comment(" ") == " "
    assert all(f("def (") .endswith("def (") for f in texts.PERTURBATIONS.values())


def test_spans_and_tokens():
    code = "import os\n@dec\ndef é(a: int) -> str:\n    return 'ü'\n"
    assert [(x, code[a:b]) for x, a, b in texts.excluded_spans(code)] == [("import_statement", "import os"), ("decorator", "@dec"), ("function_signature", "def é(a: int) -> str:")]
    safe = {t: s for _, t, _, _, s in texts.tokens_of(code)}
    assert safe["return"] and not safe["import"] and not safe["dec"]


def test_greedy_match():
    blocks_ = [(0, "a", 1, 1), (1, "a", 2, 2), (2, "b", 3, 3)]
    assert texts.match_events([(0, "a"), (1, " a"), (2, "a"), (3, "c")], blocks_, "a\na\nb") == [(0, 0), (1, 1), (2, None), (3, None)]


def test_closing_batch_and_stream(spark, tmp_path):
    code = ["x = 1", "\n", "if x", ":\n", "    y = 2\n", "z"]
    rows = [("d", i, t, i == len(code) - 1) for i, t in enumerate(code)]
    df = spark.createDataFrame(rows, "doc_id string, pos int, token string, last boolean")
    batch = sorted((r.node_type, r.at_end) for r in closing.close_batch(df).collect())
    assert batch == [("expression_statement", False), ("expression_statement", False), ("expression_statement", True), ("if_statement", False)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = closing.close_statements(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("closed").outputMode("append").start()
    try:
        until = time.time() + 60
        while spark.table("closed").count() < len(batch) and time.time() < until:  # timeouts keep it running
            time.sleep(0.3)
        assert sorted((r.node_type, r.at_end) for r in spark.table("closed").collect()) == batch
    finally:
        q.stop()


def test_resumable_ingest(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "id string, v int")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = closing.ingest_new(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / f"ck{time.time()}"), ["id"])
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_long_source():
    code = "\n".join(f"v{i} = [{i}] + v{i - 1}" for i in range(1, 400))
    assert apply_rule("operand_swap", code).count("+") == 399
    assert isinstance(pd.Series(texts.excluded_spans("x" * 100_000)), pd.Series)


def test_token_features():
    got = {t: (kind, parent, body, safe) for _, t, kind, parent, _, body, safe in texts.token_features("import os\ndef f(a):\n    return a + 12\n") if t.strip()}
    assert got["12"] == ("constant", "bin_op", True, True) and got["return"] == ("return", "function_def", True, True)
    assert got["import"] == ("import", "module", False, False) and got["def"][2:] == (False, False)
    assert list(texts.token_features(None)) == [] and list(texts.token_features("def (")) == []
    assert ("NAME", "x") in texts.leaf_tokens("x = 1") and texts.leaf_tokens("'") == []


def test_embedding(spark):
    import numpy as np
    from quarrylens.operators.embed import HashEmbedder, embed

    df = spark.createDataFrame([(1, "abc", 0), (2, None, 0), (3, "", 0), (4, "abc", 0)], "k int, t string, embedding int")
    got = {r.k: r.embedding for r in embed(df, "t", HashEmbedder(8)).collect()}
    assert got[1] == got[4] and got[2] is None and len(got[3]) == 8 and abs(np.linalg.norm(got[1]) - 1) < 1e-5
    assert embed(df.limit(0), "t", HashEmbedder(8)).count() == 0


@pytest.mark.parametrize("mode", ["positive", "negative"])
def test_variants_are_all_ordered_choices(mode):
    code = "def get_x(a, b):\n    x = []\n    for i in range(3):\n        if a < b and i == 1:\n            x.append(a + b)\n    print(x)\n    return x\n"
    names = [n for n in (POSITIVE if mode == "positive" else NEGATIVE) if apply_rule(n, code) is not None]
    want = []
    for length in (1, 2, 3):
        for chosen in itertools.permutations(names, length):
            now = code
            for n in chosen:
                now = now and apply_rule(n, now)
            if now is not None:
                want.append((list(chosen), now))
    got = list(variants(code, mode, longest=3, most=10**6))
    assert len(names) > 3 and [(r, t) for _, r, t in got] == want and [n for n, _, _ in got] == list(range(len(want)))
    assert [(r, t) for _, r, t in variants(code, mode, 3, 50)] == want[:50]


def test_variants_are_registered_with_the_full_limits(spark, sf):
    got = code_queries.QUERIES["code_variants"](spark, sf).groupBy("sample_type").agg(F.max(F.size("rules_applied")).alias("n"), F.max("variant_id").alias("most")).collect()
    assert {r.sample_type: r.n > 2 and 20 <= r.most < 1000 for r in got} == {"positive": True, "negative": True}


def test_triplets_of_few_and_of_equal_texts(spark):
    # 40 groups, of which a third have one text: each has a triplet, never with its own text
    rows = [(str(i), "same" if i % 3 == 0 else f"t{i}", f"p{i}") for i in range(40)]
    make = lambda r: spark.createDataFrame(r, "g string, x string, positive string")
    got = texts.triplets(make(rows), "g", "x").collect()
    assert sorted(r.positive for r in got) == sorted(p for _, _, p in rows) and all(r.anchor != r.negative for r in got)
    assert sorted(r.negative for r in texts.triplets(make(rows[:2]), "g", "x").collect()) == ["same", "t1"]
    assert texts.triplets(make(rows[:1]), "g", "x").count() == 0 and texts.triplets(make([]), "g", "x").count() == 0


def test_sources_that_do_not_parse_keep_their_prefix(spark):
    cut = "import os\ndef f(a):\n    b = a\n    return (b +\n"
    text = {"whole": "x = 1\n", "cut": cut, "body": "    y = 2\n    return (", "fault": "a = 1\nb = = 2\nc = 3\n", "open": "x = 1\ntry:\n    y = 2\n", "none": "def (", "null": None}
    df = spark.createDataFrame(list(text.items()), "k string, code string")
    got = {r.k: (r.parse_status, r.n_lines, r.n_parsed) for r in blocks.parse_status(df, "k", "code").collect()}
    assert got == {"whole": ("complete", 1, 1), "cut": ("prefix", 4, 3), "body": ("prefix", 2, 1), "fault": ("prefix", 3, 1), "open": ("prefix", 3, 1), "none": ("none", 1, 0), "null": ("null", 0, 0)}
    rows = sorted((r.k, r.block_id, r.source, r.parse_status) for r in blocks.explode_blocks(df, "k", "code").collect())
    assert [r[1:] for r in rows if r[0] == "cut"] == [(0, "import os", "prefix"), (1, "def f(a):\n    b = a", "prefix"), (2, "b = a", "prefix")]
    assert {r[0] for r in rows} == {"whole", "cut", "body", "fault", "open"} == {r.k for r in blocks.contracts(df, "k", "code").collect()} == {r.k for r in texts.explode_features(df, "k", "code").collect()}


def test_perturbations_keep_what_the_code_does():
    code = "def f(a, *, k=1):\n    # note\n    total = a + k; é = 'é' + str(total)\n    def g(x):\n        return total + x\n    if a: return (g(a),\n            total)\n    return [y for y in range(total)], é\n"
    for change in (texts.rename_local, texts.light_rewrite, texts.reformat, texts.add_comment):
        new = change(code)
        assert new != code
        for a in (0, 3):
            got = []
            for text in (code, new):
                space = {}
                exec(text, space)
                got.append(space["f"](a, k=2))
            assert got[0] == got[1]
    assert texts.rename_local(code).count("total_renamed") == 5 and "# note" in texts.rename_local(code)
    assert texts.light_rewrite(code).count("return __value") == 3
    # a parameter, a name an inner scope binds too, a global or an import are no local variable of the function alone
    for same in ("def f(b):\n    b = 1\n", "def f():\n    b = 1\n    g = lambda b: b\n    g = 2\n    return g\n", "def f():\n    global b\n    b = 1\n", "def f():\n    import b\n    b = 1\n", "x = 1\n", "def ("):
        assert "b_renamed" not in texts.rename_local(same)
    assert texts.rename_local("def f():\n    b = 1\n    b_renamed = 2\n    return b + b_renamed\n").count("b_renamed_") == 2


def test_closing_parses_only_what_is_open():
    import random

    from quarrylens.code.blocks import statement_blocks
    from quarrylens.streaming.closing import Closer

    class Naive(Closer):  # parses the whole prefix at each line end
        def feed(self, token):
            self.text += token
            return self._new(statement_blocks(self.text[: self.text.rfind("\n") + 1])) if "\n" in token else []

    rnd = random.Random(8)
    parts = ["x = 1\n", "if x:\n    y = 2\n", "else:\n    y = 3\n", "def f(a):\n    return a\n", "@dec\nclass C:\n    z = 1\n\n    def m(self):\n        pass\n", "'''é\nb'''\n", "a = (1,\n  2)\n", "for i in x: print(i)\n", "try:\n    a()\nexcept E:\n    pass\n", "\n", "# c\n", "x = 1; y = 2\n"]
    for _ in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25)))
        a, b = Closer(), Naive()
        said = lambda ks: [(k.node_type, k.text, k.start_line, k.end_line, k.block_id) for k in ks]
        for t in text.splitlines(keepends=True):
            assert said(a.feed(t)) == said(b.feed(t))
        assert said(a.flush()) == said(b.flush())
    long = Closer()
    for n in range(3000):
        long.feed(f"v{n} = {n}\n")
    assert len(long.text) < 100 and len(long.emitted) < 5


def test_hard_negatives(spark):
    rows = [(g, f"code {g}", f"pos {g} {i}") for g in range(40) for i in range(50)]
    anchors = spark.createDataFrame(rows, "g int, code string, positive string")
    hard = spark.createDataFrame([(g, f"neg {g} {i}") for g in range(0, 40, 2) for i in range(7)], "g int, negative string")
    got = sorted(map(tuple, texts.triplets(anchors, "g", "code", hard, 0.5).collect()))
    assert len(got) == len(rows) and got == sorted(map(tuple, texts.triplets(anchors, "g", "code", hard, 0.5).collect()))
    for anchor, _, negative, kind in got:
        assert negative.startswith("neg " + anchor.split()[1] + " ") if kind == "hard" else negative.startswith("code") and negative != anchor
    share = sum(k == "hard" for *_, k in got) / (len(rows) / 2)
    assert 0.4 < share < 0.6 and len({n for *_, n, k in got if k == "hard"}) > 130
    assert {r.kind for r in texts.triplets(anchors, "g", "code", hard, 0.0).collect()} == {"other"}
    one = texts.triplets(anchors.filter("g = 0"), "g", "code", hard, 1.0).collect()
    assert len(one) == 50 and {r.kind for r in one} == {"hard"}


def test_lexical_replay_counts_first_sights(spark):
    import hashlib

    code = "import os\na = b\na = b\na = b\nc = a\n"
    df = spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "import os")], "k int, code string")
    got = {r.k: (r.num_positions_scored, r.num_green_hits) for r in texts.lexical_replay(df, "k", "code", "s").collect()}
    bucket = lambda t: int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") % 1024
    toks = [(bucket(t), safe) for _, t, _, _, safe in texts.tokens_of(code)]
    grams = {tuple(b for b, _ in toks[max(0, i - 3) : i + 1]) for i, (_, safe) in enumerate(toks) if safe}
    green = sum(hashlib.sha256(f"s:{','.join(map(str, g))}".encode()).digest()[0] & 1 for g in grams)
    assert got == {1: (len(grams), green)} and len(grams) < sum(s for _, s in toks)


def test_every_rewriting_of_stored_code_parses(sf):
    import ast

    import duckdb

    from quarrylens.code.rules import RULES, apply_rule

    rows = duckdb.sql(f"SELECT coalesce(CASE WHEN code_form = 'completion' THEN prompt END, '') || generated_code FROM '{sf}/samples.parquet' WHERE generated_code IS NOT NULL AND file_path LIKE '%.py'").fetchall()
    got = [(x, y) for (x,) in rows for r in RULES if (y := apply_rule(r, x)) is not None]
    assert len(got) > 200
    for x, y in got:
        assert x != y and ast.parse(y)


def _permuted(code, mode, longest, most):
    # as the rule engine does it: each choice from the source on, cut at the cap
    names = [n for n in (POSITIVE if mode == "positive" else NEGATIVE) if apply_rule(n, code) is not None]
    out = []
    for length in range(1, min(len(names), longest) + 1):
        for chosen in itertools.permutations(names, length):
            now = code
            for n in chosen:
                now = now and apply_rule(n, now)
            if now is not None:
                out.append((list(chosen), now))
            if len(out) == most:
                return out
    return out


_CUT = [
    "import os\n\n\n@dec(1 + 2)\ndef get_x(a_b, cD=[]):\n    # a_b\n    if a_b < cD and a_b:\n    \tx_y = a_b + 1\n    for i_j in range(a_b):\n        ## note\n        print(i_j, sorted([]))\n    else:\n        pass\n    return x_y\n# end\nif __name__ == '__main__':\n    print(get_x(1 + 2) == 3)\n",
    "class A(b_c):\n    @p\n    def get_it(self): return max(x for x in self) + 1\n    def make_it(self): \\\n        return {} == [] + 'get_it'\n",
    "x_y = 1; z = x_y + 2\nfor aB in z: print(aB)\nwith open(x_y) as f:\n    s = '''\n## no\n''' + str(x_y + 1)\n  # odd\ny = not not s",
    "try:\n    a = [] + b\nexcept E:\n    if a == b:\n        raise\n    elif a <= b and c in d:\n        a += [1]\nwhile a != b:\n    break\n",
    "def é(ü_a):\r\n    yield 'ß' == ü_a + 1\r\n    if ü_a <= 2:\r\n        d.keys().append(min(1, 2))\r\n    else:\r\n        exit(0)\r\n",
    "i = j\nj += k[::-1]\nif i == j and k:\n    print(i + j)",
]


@pytest.mark.parametrize("code", _CUT)
def test_counts_of_variants_are_those_of_whole_sources(code):
    from quarrylens.code.rules import count_variants

    for mode in ("positive", "negative"):
        for longest, most in ((3, 10**6), (4, 150)):
            want = _permuted(code, mode, longest, most)
            assert [(r, t) for _, r, t in variants(code, mode, longest, most)] == want
            assert count_variants(code, mode, longest, most) == len(want)
        assert count_variants("def (", mode) == count_variants("pass", mode) == 0


def test_variants_parse_little_more_than_what_changes(monkeypatch):
    from quarrylens.code import tree
    from quarrylens.code.rules import count_variants

    fixed = "".join(f"def f{i}(a):\n    return call(a, {i})\n\n\n" for i in range(50))
    code = fixed + "my_name = 1\nprint([] + b)\nif a < b and c:\n    x=1\nfor i in range(3):\n    {} == dict()\n"
    assert tree.source(code) is not None
    read, parse = [], tree.ast.parse
    monkeypatch.setattr(tree.ast, "parse", lambda t: read.append(len(t)) or parse(t))
    assert count_variants(code) == 1000 and sum(read) < 15 * len(code)


def test_transform_totals_take_only_counts_from_python(spark, tmp_path):
    def write(name, codes, first):
        spark.createDataFrame([(first + i, "t", "a.py", "file", None, c) for i, c in enumerate(codes)], "record_id bigint, id string, file_path string, code_form string, prompt string, generated_code string").write.parquet(str(tmp_path / f"{name}.parquet"))

    codes = ["x = [] + y", "x = [] + y", "a == b", "pass", "def (", None]
    write("samples", codes, 0)
    write("negative_corpus", ["x = [] + y"], 10)
    q = code_queries.QUERIES["code_transform_totals"](spark, str(tmp_path))
    each = {m: [len(list(variants(c, m))) for c in [*codes, codes[0]] if c] for m in ("positive", "negative")}
    assert {tuple(r) for r in q.collect()} == {(m, 6, sum(n > 0 for n in ns), sum(ns)) for m, ns in each.items()}
    assert "transformed_source" not in q._jdf.queryExecution().toString()


def test_variants_leave_python_as_different_texts(spark):
    code = "x = [] + y\nprint(a < b and c)\n"
    wide = f"# {'é' * 6_000_000}\nx = [] + f(y)\nprint(1)\n"
    df = spark.createDataFrame([(1, code), (2, code), (3, None), (4, "pass"), (5, wide)], "k int, code string")
    modes = ("positive", "negative")
    got = texts.explode_variants(df.filter("k < 5"), "k", "code", *modes)
    want = [(k, n, r, t, m) for k in (1, 2) for m in modes for n, r, t in variants(code, m)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500
    lists = texts._variant_lists(df, ["k"], "code", modes, 5, 1000).selectExpr("k", "size(texts) AS n_texts", "size(choices) AS n", "first").collect()
    assert sum(r.n for r in lists if r.k < 5) == len(want) > 8 * sum(r.n_texts for r in lists if r.k < 5)
    # a source of long texts has several rows
    at = [r for r in lists if r.k == 5 and r.n_texts * 6_000_000 < 2**26]
    assert len(at) > 1
    ids = texts.explode_variants(df.filter("k = 5"), "k", "code").select("variant_id", F.length("transformed_source").alias("n")).collect()
    assert sorted((r.variant_id, r.n) for r in ids) == [(n, len(t)) for n, _, t in variants(wide)]


def test_triplets_of_sources_are_those_of_their_variants(spark):
    codes = [f"a = [] + b{i}\nprint(a < {i} and a == b{i})\n" for i in range(12)] + ["x = [] + y", "x = [] + y", "print(z)", "a == b", "pass", "def (", None]
    df = spark.createDataFrame(list(enumerate(codes)), "k int, code string")
    v = lambda m, n: texts.explode_variants(df, "k", "code", m).select("k", F.col("transformed_source").alias(n))
    want = texts.triplets(df.join(v("positive", "positive"), "k"), "k", "code", v("negative", "negative")).collect()
    q = texts.triplets_of_sources(df, "k", "code")
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, want)) and {r.kind for r in want} == {"hard", "other"}
    assert {r.kind for r in texts.triplets_of_sources(df, "k", "code", 0.0).collect()} == {"other"}
    one = texts.triplets_of_sources(df.filter("k = 0"), "k", "code", 1.0).collect()
    assert {r.kind for r in one} == {"hard"} and len(one) == len(list(variants(codes[0])))
    assert texts.triplets_of_sources(df.filter("k > 14"), "k", "code").count() == 0
    # what is made of a source is neither shuffled nor joined
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan.partition("MapInArrow")[0] for x in ("Join", "Window", "Repartition", "Aggregate"))


def test_triplets_of_sources_move_each_source_once(spark, monkeypatch):
    # one text of many rows, others of one or two, and some without variants, over fewer and more rows than there are ranges
    codes = ["a = [] + b\n"] * 90 + [f"x{i % 70} = [] + y\n" for i in range(90)] + [f"z{i}\n" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(codes)), "k int, code string")
    v = lambda m, n: texts.explode_variants(df, "k", "code", m).select("k", F.col("transformed_source").alias(n))
    want = texts.triplets(df.join(v("positive", "positive"), "k"), "k", "code", v("negative", "negative")).collect()
    monkeypatch.setattr(texts, "materialize", None)  # no source goes to the shared folder
    q = texts.triplets_of_sources(df, "k", "code")
    assert q._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, want)) and len({r.anchor for r in want}) == 71
    assert texts.triplets_of_sources(df.filter("k >= 180"), "k", "code").count() == 0
    assert {r.kind for r in texts.triplets_of_sources(df.filter("k < 90"), "k", "code").collect()} == {r.kind for r in want if r.anchor == codes[0]} - {"other"}


def test_first_texts_of_ranges_are_found_wherever_they_are(spark):
    from quarrylens.code.rules import fits_any

    codes = [f"x{i} = [] + y\n" if i % 5 == 0 else f"z{i}\n" for i in range(400)]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    h = F.xxhash64(F.lit(3), "code")
    fit = sorted((r.h, r.code) for r in df.select(h.alias("h"), "code").collect() if fits_any(r.code))
    starts = sorted([((i << 28) - (1 << 31)) << 32 for i in range(16)] + [fit[7][0], fit[7][0] + 1])
    want = sorted({next(x for x in fit if x[0] >= a) for a in starts if fit[-1][0] >= a})
    for rows in (0, 1, 8, 64):
        assert texts._firsts(df, "code", h, starts, 16, 400, rows) == want
