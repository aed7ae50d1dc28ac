"""Statement blocks of Python sources: extraction, contracts, node entropy, tree selection."""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.code.tree import Source, recovered, source
from quarrylens.session import spread

# The statement types and their names.
SIMPLE = {
    ast.Expr: "expression_statement", ast.Assign: "expression_statement", ast.AugAssign: "expression_statement", ast.AnnAssign: "expression_statement",
    ast.Return: "return_statement", ast.Assert: "assert_statement", ast.Import: "import_statement", ast.ImportFrom: "import_from_statement", ast.Pass: "pass_statement",
    ast.Break: "break_statement", ast.Continue: "continue_statement", ast.Raise: "raise_statement", ast.Delete: "delete_statement", ast.Global: "global_statement", ast.Nonlocal: "nonlocal_statement",
}
COMPOUND = {
    ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition", ast.If: "if_statement", ast.For: "for_statement",
    ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.Try: "try_statement", ast.TryStar: "try_statement", ast.With: "with_statement", ast.AsyncWith: "with_statement", ast.Match: "match_statement",
}


@dataclass
class Block:
    block_id: int
    block_type: str
    node_type: str
    text: str
    start_line: int
    end_line: int
    depth: int
    parent_id: int | None
    last_child: int  # descendants are block_id + 1 .. last_child


def statement_blocks(text: str | None, recover: bool = False) -> list[Block]:
    """All statements in preorder; clauses (elif, else, except, case) and decorators are no level of their own.

    A text that goes on an indented body, as a completion does, is read as one. A null text or one that
    does not parse has none, or with ``recover`` those of its longest line prefix that parses.
    """
    s = source(text) if text is not None else None
    out: list[Block] = []
    shift = 0
    if recover:
        s, shift, _ = recovered(text)
    elif s is None and text is not None and text[:1] in " \t\n":
        s, shift = source("if 1:\n" + text), 1
    if s is None:
        return out

    def inner(n: ast.AST):
        for field in ("body", "handlers", "cases", "orelse", "finalbody"):
            for x in getattr(n, field, None) or []:
                if isinstance(x, (ast.ExceptHandler, ast.match_case)):
                    yield from x.body
                elif isinstance(x, ast.If) and isinstance(n, ast.If) and field == "orelse" and s.text.startswith("elif", s.span(x)[0]):
                    yield from inner(x)
                else:
                    yield x

    def visit(n: ast.stmt, depth: int, parent: int | None) -> None:
        kind = SIMPLE.get(type(n)) or COMPOUND.get(type(n))
        if kind is None:
            return
        a, b = s.span(n)
        me = Block(len(out), "simple" if type(n) in SIMPLE else "compound", kind, s.text[a:b], n.lineno - shift, n.end_lineno - shift, depth, parent, 0)
        out.append(me)
        if me.block_type == "compound":
            for x in inner(n):
                visit(x, depth + 1, me.block_id)
        me.last_child = len(out) - 1

    for n in [*s.tree.body[0].body, *s.tree.body[1:]] if shift else s.tree.body:
        visit(n, 0, None)
    return out


# Entropy of syntax node types in bits; types not listed here or below have 0.1.
ENTROPY = {
    "boolean_operator": 0.959, "for_statement": 0.7095, "function_definition": 0.504, "comparison_operator": 0.4944, "identifier": 0.4909,
    "conditional_expression": 0.4487, "if_statement": 0.4348, "while_statement": 0.4266, "binary_operator": 0.4026, "default_parameter": 0.3584,
    "module": 0.3571, "comment": 0.3333, "call": 0.3198, "block": 0.3116, "dictionary_comprehension": 0.3062, "elif_clause": 0.2992,
    "assignment": 0.2971, "expression_statement": 0.2817, "parenthesized_expression": 0.2809, "list_comprehension": 0.2779, "argument_list": 0.2251,
    "slice": 0.2214, "if_clause": 0.1979, "string_content": 0.1949, "generator_expression": 0.1901, "else_clause": 0.168, "float": 0.1672,
    "for_in_clause": 0.1556, "return_statement": 0.1539, "integer": 0.1522, "not_operator": 0.1496, "subscript": 0.1225, "tuple": 0.1105,
    "augmented_assignment": 0.107, "set_comprehension": 0.1048, "string": 0.0881, "expression_list": 0.0749, "attribute": 0.0688, "list": 0.0569,
    "set": 0.0467, "parameters": 0.0451, "unary_operator": 0.0375, "class_definition": 0.0317, "pattern_list": 0.0259, "keyword_argument": 0.0187,
    "string_start": 0.017, "pair": 0.0145, "string_end": 0.0133, "import_from_statement": 0.008, "dotted_name": 0.0077, "lambda": 0.0716,
    "yield": 0.1138,
}
# Node types and tokens of entropy 0.
SILENT = frozenset([
    "=", "def", ":", "(", ")", ",", ".", "class", "return", "[", "]", "if", "<", "and", "in", ">", "for", "+", "+=", "!=", "while", "-", "==", "%",
    "//", "true", "false", "else", ">=", "import", "import_statement", "/", "*", "list_splat", "lambda_parameters", "or", ";", "<=",
    "break_statement", "break", "elif", "**", "-=", "from", "not", "^", "as", "aliased_import", "\\", "*=", "not_in", "{", "}", "&", "|", "<<",
    "~", "continue", "continue_statement", "<<=", "/=", "tuple_pattern", ">>", "|=", "is", "none", "line_continuation", "dictionary",
    "except_clause", "except", "try_statement", "try", "escape_sequence", ">>=", "//=", "%=", "pass_statement", "pass", "del", "delete_statement",
    "is_not",
])
UNKNOWN = 0.1


def node_types(text: str) -> list[str]:
    """The concrete syntax node types of a statement's source, from the abstract tree, punctuation of entropy 0 left out."""
    s = Source(text)
    out = ["module"]
    add = out.append

    def brackets(n: ast.expr, parent: ast.AST | None) -> int:
        """How many pairs of brackets enclose the node and nothing else."""
        a, b = s.span(n)
        k = 0
        while True:
            x, y = a - 1, b
            while x >= 0 and text[x] in " \t\n\\":
                x -= 1
            while y < len(text) and text[y] in " \t\n\\":
                y += 1
            if x < 0 or y >= len(text) or text[x] != "(" or text[y] != ")":
                break
            k, a, b = k + 1, x, y + 1
        if k and isinstance(parent, ast.Call) and n is not parent.func and len(parent.args) + len(parent.keywords) == 1:
            k -= 1
        return k

    def target(n: ast.expr) -> None:
        if isinstance(n, ast.Tuple):
            add("tuple_pattern" if s.of(n).startswith("(") else "pattern_list")
            for e in n.elts:
                target(e)
        elif isinstance(n, ast.List):
            add("list_pattern")
            for e in n.elts:
                target(e)
        elif isinstance(n, ast.Starred):
            add("list_splat_pattern")
            target(n.value)
        else:
            visit(n)

    def generators(gs, parent) -> None:
        for g in gs:
            add("for_in_clause")
            if g.is_async:
                add("async")
            target(g.target)
            visit(g.iter)
            for i in g.ifs:
                add("if_clause")
                visit(i)

    def parameters(a: ast.arguments, name: str) -> None:
        plain = [*a.posonlyargs, *a.args]
        if name == "parameters" or plain or a.vararg or a.kwonlyargs or a.kwarg:
            add(name)
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        for p, d in [*zip(plain, defaults), *zip(a.kwonlyargs, a.kw_defaults)]:
            if p.annotation is not None:
                add("typed_default_parameter" if d is not None else "typed_parameter")
            elif d is not None:
                add("default_parameter")
            add("identifier")
            if p.annotation is not None:
                add("type")
                visit(p.annotation)
            if d is not None:
                visit(d)
        for p, kind in ((a.vararg, "list_splat_pattern"), (a.kwarg, "dictionary_splat_pattern")):
            if p is not None:
                if p.annotation is not None:
                    add("typed_parameter")
                add(kind)
                add("identifier")
                if p.annotation is not None:
                    add("type")
                    visit(p.annotation)
        if a.posonlyargs:
            add("positional_separator")
        if a.kwonlyargs and a.vararg is None:
            add("keyword_separator")

    def string(n: ast.expr) -> None:
        raw = s.of(n)
        try:
            toks = [t for t in tokenize.generate_tokens(io.StringIO("(" + raw + ")").readline)]
        except (tokenize.TokenError, IndentationError, SyntaxError):
            toks = []
        plain = [t.string for t in toks if t.type == tokenize.STRING]
        starts = sum(t.type == getattr(tokenize, "FSTRING_START", -1) for t in toks)
        if len(plain) + starts > 1:
            add("concatenated_string")
        for p in plain:
            out.extend(["string", "string_start", "string_end"])
            if len(re.sub(r"^[A-Za-z]*", "", p)) > (6 if p.endswith(('"""', "'''")) and len(p) >= 6 else 2):
                add("string_content")
        for _ in range(starts):
            out.extend(["string", "string_start", "string_end"])
        for t in toks:
            if t.type == getattr(tokenize, "FSTRING_MIDDLE", -1) and t.string:
                add("string_content")
        if isinstance(n, ast.JoinedStr):
            for v in n.values:
                if isinstance(v, ast.FormattedValue):
                    add("interpolation")
                    visit(v.value)
                    if v.conversion != -1:
                        add("type_conversion")
                    if v.format_spec is not None:
                        add("format_specifier")

    def visit(n: ast.AST, parent: ast.AST | None = None) -> None:
        if isinstance(n, ast.expr):
            fixed = isinstance(n, (ast.Tuple, ast.GeneratorExp))
            k = brackets(n, parent) if not isinstance(n, ast.Starred) else 0
            if fixed and isinstance(n, ast.GeneratorExp):
                k = brackets(n, None)
            out.extend(["parenthesized_expression"] * k)
        kind = type(n)
        if kind is ast.Name:
            add("identifier")
        elif kind is ast.Constant:
            v = n.value
            if isinstance(v, (str, bytes)):
                string(n)
            elif v is Ellipsis:
                add("ellipsis")
            elif isinstance(v, bool) or v is None:
                add("none" if v is None else str(v).lower())
            else:
                add("integer" if isinstance(v, int) or s.of(n)[-1] in "jJ" and "." not in s.of(n) else "float")
        elif kind is ast.JoinedStr:
            string(n)
        elif kind is ast.Attribute:
            add("attribute")
            visit(n.value)
            add("identifier")
        elif kind is ast.Call:
            add("call")
            visit(n.func)
            if len(n.args) == 1 and not n.keywords and isinstance(n.args[0], ast.GeneratorExp) and s.span(n.args[0])[1] == s.span(n)[1]:
                add("generator_expression")
                visit(n.args[0].elt)
                generators(n.args[0].generators, n)
                return
            add("argument_list")
            for a in n.args:
                visit(a, n)
            for w in n.keywords:
                add("keyword_argument" if w.arg else "dictionary_splat")
                if w.arg:
                    add("identifier")
                visit(w.value)
        elif kind is ast.Starred:
            add("list_splat")
            visit(n.value)
        elif kind is ast.Subscript:
            add("subscript")
            visit(n.value)
            parts = n.slice.elts if isinstance(n.slice, ast.Tuple) and not s.of(n.slice).startswith("(") else [n.slice]
            for p in parts:
                visit(p)
        elif kind is ast.Slice:
            add("slice")
            for p in (n.lower, n.upper, n.step):
                if p is not None:
                    visit(p)
        elif kind is ast.BinOp:
            add("binary_operator")
            if isinstance(n.op, ast.MatMult):
                add("@")
            visit(n.left)
            visit(n.right)
        elif kind is ast.UnaryOp:
            add("not_operator" if isinstance(n.op, ast.Not) else "unary_operator")
            visit(n.operand)
        elif kind is ast.BoolOp:
            out.extend(["boolean_operator"] * (len(n.values) - 1))
            for v in n.values:
                visit(v)
        elif kind is ast.Compare:
            add("comparison_operator")
            for v in (n.left, *n.comparators):
                visit(v)
        elif kind is ast.IfExp:
            add("conditional_expression")
            for v in (n.body, n.test, n.orelse):
                visit(v)
        elif kind is ast.Lambda:
            out.extend(["lambda", "lambda"])
            parameters(n.args, "lambda_parameters")
            visit(n.body)
        elif kind in (ast.List, ast.Set):
            add("list" if kind is ast.List else "set")
            for e in n.elts:
                visit(e)
        elif kind is ast.Tuple:
            if s.of(n).startswith("(") and s.of(n).endswith(")"):
                add("tuple")
            else:
                add("expression_list")
            for e in n.elts:
                visit(e)
        elif kind is ast.Dict:
            add("dictionary")
            for k, v in zip(n.keys, n.values):
                add("pair" if k is not None else "dictionary_splat")
                if k is not None:
                    visit(k)
                visit(v)
        elif kind in (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp):
            add({ast.ListComp: "list_comprehension", ast.SetComp: "set_comprehension", ast.GeneratorExp: "generator_expression", ast.DictComp: "dictionary_comprehension"}[kind])
            if kind is ast.DictComp:
                add("pair")
                visit(n.key)
                visit(n.value)
            else:
                visit(n.elt)
            generators(n.generators, n)
        elif kind in (ast.Yield, ast.YieldFrom):
            out.extend(["yield", "yield"])
            if n.value is not None:
                visit(n.value)
        elif kind is ast.Await:
            out.extend(["await", "await"])
            visit(n.value)
        elif kind is ast.NamedExpr:
            out.extend(["named_expression", ":="])
            visit(n.target)
            visit(n.value)
        elif kind is ast.Assign:
            out.extend(["expression_statement", *["assignment"] * len(n.targets)])
            for t in n.targets:
                target(t)
            visit(n.value)
        elif kind is ast.AugAssign:
            out.extend(["expression_statement", "augmented_assignment"])
            visit(n.target)
            visit(n.value)
        elif kind is ast.AnnAssign:
            out.extend(["expression_statement", "assignment", "type"])
            visit(n.target)
            visit(n.annotation)
            if n.value is not None:
                visit(n.value)
        elif kind in (ast.Import, ast.ImportFrom):
            add(SIMPLE[kind])
            names = [a.name for a in n.names] + ([n.module] if kind is ast.ImportFrom and n.module else [])
            if kind is ast.ImportFrom and n.level:
                out.extend(["relative_import", "import_prefix"])
            for a in n.names:
                if a.asname:
                    out.extend(["aliased_import", "identifier"])
            for name in names:
                if name == "*":
                    add("wildcard_import")
                else:
                    out.extend(["dotted_name", *["identifier"] * (name.count(".") + 1)])
        elif kind in SIMPLE:
            add(SIMPLE[kind])
            if kind in (ast.Global, ast.Nonlocal):
                out.extend(["identifier"] * len(n.names))
            for child in ast.iter_child_nodes(n):
                visit(child)
            if kind in (ast.Assert, ast.Raise, ast.Global, ast.Nonlocal):
                add(SIMPLE[kind].split("_")[0])
        else:
            add(COMPOUND.get(kind, kind.__name__))
            for child in ast.iter_child_nodes(n):
                visit(child)

    for st in s.tree.body:
        visit(st)
    try:
        out.extend("comment" for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT)
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def entropy_units(text: str) -> int:
    """Ten thousandths of a bit, half to even; 0 for a blank text. Counts node types as a concrete syntax tree has them."""
    if not text.strip():
        return 0
    try:
        kinds = node_types(text)
    except (SyntaxError, ValueError):
        # return, yield and the like do not stand alone everywhere; a body does
        return 0
    return max(0, round(sum(0.0 if k in SILENT else ENTROPY.get(k, UNKNOWN) for k in kinds) * 10000))


def explode_blocks(df: DataFrame, key: str, code: str) -> DataFrame:
    """``(key, block_id, block_type, node_type, source, start_line, end_line, depth, parent_id, last_child, parse_status)``: every statement of each source, or of its longest line prefix that parses."""
    kt = df.schema[key].dataType.simpleString()
    cols = [key, "block_id", "block_type", "node_type", "source", "start_line", "end_line", "depth", "parent_id", "last_child", "parse_status"]

    def run(batches):
        for pdf in batches:
            rows = [(k, b.block_id, b.block_type, b.node_type, b.text, b.start_line, b.end_line, b.depth, b.parent_id, b.last_child, recovered(t)[2]) for k, t in zip(pdf[key], pdf[code]) for b in statement_blocks(t, True)]
            yield pd.DataFrame(rows, columns=cols).astype({"parent_id": "Int32"})

    return spread(df.select(key, code)).mapInPandas(run, f"`{key}` {kt}, block_id int, block_type string, node_type string, source string, start_line int, end_line int, depth int, parent_id int, last_child int, parse_status string")


def parse_status(df: DataFrame, key: str, code: str) -> DataFrame:
    """``(key, parse_status, n_lines, n_parsed)``: one row a source, with how many of its lines the blocks come from."""
    kt = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[code]):
                s, shift, status = recovered(t)
                count = lambda x: len(re.findall(r"\r\n|\r|\n", x)) + (x[-1:] not in ("", "\r", "\n"))
                rows.append((k, status, count(t or ""), count(s.text) - shift if s is not None else 0))
            yield pd.DataFrame(rows, columns=[key, "parse_status", "n_lines", "n_parsed"])

    return spread(df.select(key, code)).mapInPandas(run, f"`{key}` {kt}, parse_status string, n_lines int, n_parsed int")


def contracts(df: DataFrame, key: str, code: str, text: bool = False) -> DataFrame:
    """``(key, ordinal, block_id, node_type, parent_node_type, block_text_hash, start_line, end_line, entropy_units, parse_status)`` of simple statements.

    All blocks of a source are in one call, so parents are looked up there and nothing is shuffled. With ``text``
    the statement's ``source`` stands in place of its hash and entropy.
    """
    kt = df.schema[key].dataType.simpleString()
    cols = [key, "ordinal", "block_id", "node_type", "parent_node_type", *(["source"] if text else ["block_text_hash"]), "start_line", "end_line", *([] if text else ["entropy_units"]), "parse_status"]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[code]):
                blocks = statement_blocks(t, True)
                for n, b in enumerate(x for x in blocks if x.block_type == "simple"):
                    parent = "module" if b.parent_id is None else blocks[b.parent_id].node_type
                    said = (b.text,) if text else (hashlib.sha256(b.text.encode()).hexdigest(),)
                    units = () if text else (entropy_units(b.text),)
                    rows.append((k, n, str(b.block_id), b.node_type, parent, *said, b.start_line, b.end_line, *units, recovered(t)[2]))
            yield pd.DataFrame(rows, columns=cols)

    types = {"ordinal": "int", "start_line": "int", "end_line": "int", "entropy_units": "int"}
    return spread(df.select(key, code)).mapInPandas(run, ", ".join(f"`{c}` {kt if c == key else types.get(c, 'string')}" for c in cols))


def with_gamma(contracts_: DataFrame, units: str, anchors: list, d: int) -> DataFrame:
    """``contracts_`` with gamma_target, k and gamma_effective by a schedule over entropy, quantised for d planes; 0 where the entropy is null."""
    from quarrylens.functions.marks import quantize, schedule

    target, k, effective = quantize(schedule(F.col(units), anchors), F.lit(d))
    there = F.col(units).isNotNull()
    return contracts_.withColumns({"gamma_target": F.when(there, target).otherwise(F.lit(0.0)), "k": F.when(there, k).otherwise(F.lit(0)), "gamma_effective": F.when(there, effective).otherwise(F.lit(0.0))})


def select_tree(blocks: list[tuple[int, int | None, float]]) -> tuple[float, list[int]]:
    """Best total and the chosen blocks, given (id, parent, score): a block or its children's best, children on a tie, leaves themselves."""
    kids: dict[int | None, list[int]] = {}
    for i, p, _ in blocks:
        kids.setdefault(p, []).append(i)
    score = {i: x for i, _, x in blocks}
    best: dict[int, float] = {}
    own: dict[int, bool] = {}
    for i, _, _ in sorted(blocks, key=lambda b: -b[0]):  # children have greater ids
        below = sum(best[k] for k in kids.get(i, []))
        own[i] = not kids.get(i) or score[i] > below
        best[i] = score[i] if own[i] else below
    chosen, todo = [], list(kids.get(None, []))
    while todo:
        i = todo.pop()
        if own[i]:
            chosen.append(i)
        else:
            todo += kids[i]
    return sum(best[i] for i in kids.get(None, [])), sorted(chosen)


def select_blocks(df: DataFrame, key: str, block: str = "block_id", parent: str = "parent_id", score: str = "score") -> DataFrame:
    """``(key, total, selected)`` for each source; a group is the blocks of one source."""
    got = df.groupBy(key).agg(F.collect_list(F.struct(F.col(block).alias("i"), F.col(parent).alias("p"), F.col(score).cast("double").alias("s"))).alias("b"))
    kt = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, *select_tree([(int(x["i"]), None if x["p"] is None or x["p"] != x["p"] else int(x["p"]), float(x["s"])) for x in b])) for k, b in zip(pdf[key], pdf["b"])]
            yield pd.DataFrame(rows, columns=[key, "total", "selected"])

    return got.mapInPandas(run, f"`{key}` {kt}, total double, selected array<int>")


def hit(signature: Column, valid: Column) -> Column:
    return F.array_contains(valid, signature)
