"""Python 3.13, from the language reference, as an LALR(1) grammar over a token stream.

Expressions carry small flags through the parse, so that what may stand left of ``=``, ``+=``, ``for ... in``,
after ``as`` and after ``del`` is checked where the rule is reduced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from quarrylens.llm.lalr import END, ParseError

# What an expression is: fit as assignment target, as single target (name, attribute, subscript), for del;
# a starred item, a list with a comma, an item with "as" that only a with statement may hold.
TARGET, SINGLE, DELETE, STAR, COMMA, AS = 1, 2, 4, 8, 16, 32

GRAMMAR = r"""
%left 'or'
%left 'and'
%right 'not'
%left '|'
%left '^'
%left '&'
%left '<<' '>>'
%left '+' '-'
%left '*' '/' '//' '%' '@'
%right UNARY
%right '**'

file: stmts
stmts: | stmts stmt
stmt: line | compound
line: small NEWLINE | small ';' NEWLINE
small: simple | small ';' simple
simple: exprs | exprs '=' assigned @assign
| exprs augop rhs @augmented
| exprs ':' expr @annotated
| exprs ':' expr '=' rhs @annotated
| yield_ | 'pass' | 'break' | 'continue' | 'return' | 'return' exprs | 'raise' | 'raise' expr | 'raise' expr 'from' expr
| 'global' names | 'nonlocal' names | 'del' del_list @delete
| 'del' del_list ',' @delete
| 'assert' expr | 'assert' expr ',' expr
| 'import' modules | 'from' origin 'import' imported
| SOFT_TYPE NAME typarams '=' expr
augop: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='
assigned: rhs | exprs '=' assigned @assign
rhs: exprs | yield_
yield_: 'yield' | 'yield' exprs | 'yield' 'from' expr
names: NAME | names ',' NAME
del_list: bin | del_list ',' bin @join
modules: module | modules ',' module
module: dotted | dotted 'as' NAME
dotted: NAME | dotted '.' NAME
origin: dotted | dots | dots dotted
dots: '.' | '...' | dots '.' | dots '...'
imported: '*' | aliases | '(' aliases ')' | '(' aliases ',' ')'
aliases: alias | aliases ',' alias
alias: NAME | NAME 'as' NAME

compound: if_ | while_ | for_ | try_ | with_ | def_ | class_ | match_ | decorators def_ | decorators class_ | 'async' def_ | decorators 'async' def_ | 'async' for_ | 'async' with_
block: line | NEWLINE INDENT stmt stmts DEDENT
if_: 'if' named ':' block elifs
elifs: | 'else' ':' block | 'elif' named ':' block elifs
while_: 'while' named ':' block orelse
orelse: | 'else' ':' block
for_: 'for' targets 'in' exprs ':' block orelse @for
targets: target_list | target_list ',' @tuple
target_list: target | target_list ',' target @join
target: bin | '*' bin @starred
try_: 'try' ':' block 'finally' ':' block | 'try' ':' block excepts orelse | 'try' ':' block excepts orelse 'finally' ':' block | 'try' ':' block groups orelse | 'try' ':' block groups orelse 'finally' ':' block
excepts: except_ | excepts except_
except_: 'except' ':' block | 'except' expr ':' block | 'except' expr 'as' NAME ':' block
groups: group | groups group
group: 'except' '*' expr ':' block | 'except' '*' expr 'as' NAME ':' block
with_: 'with' withs ':' block
withs: withitem | withs ',' withitem
withitem: expr | expr 'as' target @as_target
def_: 'def' NAME typarams '(' params ')' ':' block @def
| 'def' NAME typarams '(' params ')' '->' expr ':' block @def
decorators: decorator | decorators decorator
decorator: '@' named NEWLINE
class_: 'class' NAME typarams ':' block | 'class' NAME typarams '(' args ')' ':' block
typarams: | '[' typaram_list ']' | '[' typaram_list ',' ']'
typaram_list: typaram | typaram_list ',' typaram
typaram: NAME bound | NAME bound '=' expr | '*' NAME | '*' NAME '=' expr | '*' NAME '=' '*' bin | '**' NAME | '**' NAME '=' expr
bound: | ':' expr
params: @none
| param_list | param_list ',' @first
param_list: param | param_list ',' param @concat
param: NAME @p_plain
| NAME ':' expr @p_plain
| NAME '=' expr @p_default
| NAME ':' expr '=' expr @p_default
| '/' @p_slash
| '*' @p_star
| '*' NAME @p_args
| '*' NAME ':' expr @p_args
| '*' NAME ':' '*' bin @p_args
| '**' NAME @p_kwargs
| '**' NAME ':' expr @p_kwargs
lparams: @none
| lparam_list | lparam_list ',' @first
lparam_list: lparam | lparam_list ',' lparam @concat
lparam: NAME @p_plain
| NAME '=' expr @p_default
| '/' @p_slash
| '*' @p_star
| '*' NAME @p_args
| '**' NAME @p_kwargs

match_: SOFT_MATCH elem_list ':' NEWLINE INDENT cases DEDENT | SOFT_MATCH elem_list ',' ':' NEWLINE INDENT cases DEDENT
cases: case | cases case
case: SOFT_CASE patterns guard ':' block
guard: | 'if' named
patterns: pattern | open_sequence
open_sequence: maybe_star ',' | maybe_star ',' maybe_stars
maybe_stars: maybe_star | maybe_star ',' | maybe_star ',' maybe_stars
maybe_star: pattern | '*' NAME
pattern: or_pattern | or_pattern 'as' NAME
or_pattern: closed | or_pattern '|' closed
closed: literal | NAME | value | '(' pattern ')' | '(' ')' | '(' open_sequence ')' | '[' ']' | '[' maybe_stars ']' | '{' '}' | '{' keyed '}' | '{' keyed ',' '}' | callee '(' ')' | callee '(' class_args ')' | callee '(' class_args ',' ')'
callee: NAME | value
value: NAME '.' NAME | value '.' NAME
literal: number | strs_plain | bytess | 'None' | 'True' | 'False'
number: signed | signed '+' NUMBER | signed '-' NUMBER
signed: NUMBER | '-' NUMBER
strs_plain: STRING | strs_plain STRING
keyed: key_item | keyed ',' key_item
key_item: literal ':' pattern | value ':' pattern | '**' NAME
class_args: class_arg | class_args ',' class_arg @class_args
class_arg: pattern @c_pos
| NAME '=' pattern @c_key

exprs: item_list | item_list ',' @tuple
item_list: item | item_list ',' item @join
item: expr | '*' bin @starred
named: NAME ':=' expr | expr
expr: any | any 'if' any 'else' expr | 'lambda' lparams ':' expr @lambda
any: comp | any 'or' any | any 'and' any | 'not' any
comp: bin | comp cmp bin
cmp: '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
bin: primary | 'await' primary | bin '|' bin | bin '^' bin | bin '&' bin | bin '<<' bin | bin '>>' bin | bin '+' bin | bin '-' bin | bin '*' bin | bin '/' bin | bin '//' bin | bin '%' bin | bin '@' bin | bin '**' bin | '-' bin %prec UNARY | '+' bin %prec UNARY | '~' bin %prec UNARY
primary: atom | primary '.' NAME @member
| primary '(' args ')' | primary '[' slices ']' @member
args: @none
| arg_list @args
| arg_list ',' @args
| named comp_for
arg_list: arg | arg_list ',' arg @concat
arg: named @a_pos
| '*' expr @a_star
| '**' expr @a_double
| NAME '=' expr @a_key
slices: slice_list | slice_list ','
slice_list: slice | slice_list ',' slice
slice: named | '*' bin | part ':' part | part ':' part ':' part
part: | expr
atom: NAME @name
| NUMBER | strings | 'None' | 'True' | 'False' | '...'
| '(' ')' @empty
| '(' yield_ ')' | '(' elem_list ')' @paren
| '(' elem_list ',' ')' @paren_tuple
| '(' named comp_for ')'
| '[' ']' @empty
| '[' elem_list ']' @list
| '[' elem_list ',' ']' @list
| '[' named comp_for ']'
| '{' '}' | '{' pairs '}' | '{' pairs ',' '}' | '{' expr ':' expr comp_for '}'
| '{' elem_list '}' @set
| '{' elem_list ',' '}' @set
| '{' named comp_for '}'
elem_list: elem | elem_list ',' elem @join
elem: named | '*' bin @starred
| expr 'as' target @as_elem
pairs: pair | pairs ',' pair
pair: expr ':' expr | '**' bin
strings: strs | bytess
strs: str | strs str
str: STRING | FSTART fparts FEND
bytess: BYTES | bytess BYTES
fparts: | fparts FMIDDLE | fparts field
field: 'f{' fexpr conversion 'f}' | 'f{' fexpr conversion 'f:' fparts 'f}'
fexpr: rhs | rhs '='
conversion: | '!' NAME
comp_for: for_clause | comp_for for_clause | comp_for 'if' any
for_clause: 'for' targets 'in' any @comp_for
| 'async' 'for' targets 'in' any @comp_for_async
"""


def _need(ok, at: int, what: str) -> int:
    if not ok:
        raise ParseError(at, what)
    return 0


def _params(kinds: str, at: int) -> int:
    """p name, d with default, / and *, a *name, k **name; commas are left out."""
    _need(kinds.count("/") <= 1 and sum(c in "*a" for c in kinds) <= 1, at, "parameters: / or * twice")
    _need("k" not in kinds[:-1], at, "parameters: nothing may follow **")
    star = next((i for i, c in enumerate(kinds) if c in "*a"), len(kinds))
    slash = kinds.find("/")
    _need(slash != 0 and slash < star, at, "parameters: / is out of place")
    _need(star == len(kinds) or kinds[star] == "a" or kinds[star + 1 : star + 2] in ("p", "d"), at, "parameters: a name must follow the bare *")
    _need("dp" not in kinds[:star].replace("/", ""), at, "parameters: one without default follows one with default")
    return 0


def _pieces_as(v: int, at: int) -> int:
    _need(not v & AS, at, "'as' is out of place")
    return v


def _join(v, at, below, la) -> int:
    a, b = v[0], v[2]
    return (a & b & (TARGET | DELETE)) | COMMA | ((a | b) & AS)


def _paren(v, at, below, la) -> int:
    x = v[1]
    if x & AS:
        return _need(below == "with" and la == ":", at, "'as' is out of place")
    _need(not x & STAR, at, "a starred item needs a list")
    return x & (TARGET | DELETE) if x & COMMA else x


def _paren_tuple(v, at, below, la) -> int:
    if v[1] & AS:
        return _need(below == "with" and la == ":", at, "'as' is out of place")
    return v[1] & (TARGET | DELETE)


_ARGS = re.compile(r"[ps]*[ks]*[kd]*\Z")

ACTIONS = {
    "none": lambda v, at, below, la: "",
    "first": lambda v, at, below, la: v[0],
    "concat": lambda v, at, below, la: v[0] + v[2],
    "name": lambda v, at, below, la: TARGET | SINGLE | DELETE,
    "member": lambda v, at, below, la: TARGET | SINGLE | DELETE,
    "empty": lambda v, at, below, la: TARGET | DELETE,
    "starred": lambda v, at, below, la: (v[1] & TARGET) | STAR,
    "tuple": lambda v, at, below, la: v[0] & (TARGET | DELETE) | COMMA,
    "join": _join,
    "paren": _paren,
    "paren_tuple": _paren_tuple,
    "list": lambda v, at, below, la: _pieces_as(v[1], at) & (TARGET | DELETE),
    "set": lambda v, at, below, la: _pieces_as(v[1], at) & 0,
    "as_elem": lambda v, at, below, la: _need(v[2] & TARGET, at, "cannot assign to this after 'as'") | AS,
    "as_target": lambda v, at, below, la: _need(v[2] & TARGET, at, "cannot assign to this after 'as'"),
    "assign": lambda v, at, below, la: _need(v[0] & TARGET, at, "cannot assign to this"),
    "augmented": lambda v, at, below, la: _need(v[0] & SINGLE, at, "cannot assign to this with an operator"),
    "annotated": lambda v, at, below, la: _need(v[0] & SINGLE, at, "cannot annotate this"),
    "delete": lambda v, at, below, la: _need(v[1] & DELETE, at, "cannot delete this"),
    "for": lambda v, at, below, la: _need(v[1] & TARGET, at, "cannot loop into this"),
    "comp_for": lambda v, at, below, la: _need(v[1] & TARGET, at, "cannot loop into this"),
    "comp_for_async": lambda v, at, below, la: _need(v[2] & TARGET, at, "cannot loop into this"),
    "def": lambda v, at, below, la: _params(v[4], at),
    "lambda": lambda v, at, below, la: _params(v[1], at),
    "args": lambda v, at, below, la: _need(_ARGS.match(v[0]), at, "arguments are out of order"),
    "class_args": lambda v, at, below, la: v[0] + v[2] if not (v[0][-1] == "k" and v[2] == "p") else _need(False, at, "a positional pattern follows one with a name"),
} | {f"p_{n}": (lambda v, at, below, la, k=k: k) for n, k in (("plain", "p"), ("default", "d"), ("slash", "/"), ("star", "*"), ("args", "a"), ("kwargs", "k"))} | {
    f"a_{n}": (lambda v, at, below, la, k=k: k) for n, k in (("pos", "p"), ("star", "s"), ("double", "d"), ("key", "k"))
} | {"c_pos": lambda v, at, below, la: "p", "c_key": lambda v, at, below, la: "k"}

# The hard keywords.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)

_TOKEN = re.compile(
    r"""(?P<name>[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*)
|(?P<number>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+
   |(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?
   |\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]?)
|(?P<newline>\n)
|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|[-+*/%@&|^~<>()\[\]{},:;.=!])
|(?P<quote>['"])
|(?P<comment>\#[^\n]*)
|(?P<join>\\\n)""",
    re.X,
)
_SPACE = re.compile(r"[ \t\f]*")
_PREFIX = re.compile(r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])\Z")
_BODY = {q: re.compile(r"(?:[^\\\n%s]|\\[\s\S])*%s" % (q, q)) for q in "'\""} | {q * 3: re.compile(r"(?:[^\\%s]|\\[\s\S]|%s(?!%s))*%s" % (q, q, q * 2, q * 3)) for q in "'\""}
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})?|u([0-9a-fA-F]{4})?|U([0-9a-fA-F]{8})?|N(\{[^}\n]*\})?|[\s\S])")
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b|[^\w]|\Z")
_CONVERSION = re.compile(r"[sra](?!\w)")
_OPEN = {"(": ")", "[": "]", "{": "}"}


def _escapes(body: str, is_bytes: bool, at: int) -> None:
    for m in _ESCAPE.finditer(body):
        k = m.group()[1:2]
        if k == "x" and m[1] is None:
            raise ParseError(at + m.start(), "truncated \\x escape")
        if is_bytes or k not in "uUN":
            continue
        if m["u" == k and 2 or "U" == k and 3 or 4] is None:
            raise ParseError(at + m.start(), "malformed unicode escape")
        if k == "U" and int(m[3], 16) > 0x10FFFF:
            raise ParseError(at + m.start(), "no such character")
        if k == "N":
            try:
                unicodedata.lookup(m[4][1:-1])
            except KeyError:
                raise ParseError(at + m.start(), "unknown character name") from None


def tokens(src: str) -> Iterator[tuple[str, int, object]]:
    """The token stream, with soft keywords told apart by what a whole line can be."""
    if "\0" in src:
        raise ParseError(src.index("\0"), "null character")
    if "\r" in src:
        src = src.replace("\r\n", "\n").replace("\r", "\n")
    return _soft(list(_lex(src if src.endswith("\n") else src + "\n")))


def _soft(toks: list) -> Iterator[tuple[str, int, object]]:
    start, n = True, len(toks)
    blocks: list[bool] = []  # for each open indentation: does a match statement own it
    owner = False
    for i, t in enumerate(toks):
        kind = t[0]
        if kind == "INDENT":
            blocks.append(owner)
            owner = False
        elif kind == "DEDENT":
            blocks.pop()
        elif start and kind == "NAME":
            if t[2] == "match":
                j, depth = i + 1, 0
                while j < n and toks[j][0] != "NEWLINE":
                    j += 1
                if toks[j - 1][0] == ":" and j + 2 < n and toks[j + 1][0] == "INDENT" and toks[j + 2][2] == "case" and j - 1 > i + 1:
                    kind, owner = "SOFT_MATCH", True
            elif t[2] == "case" and blocks and blocks[-1]:
                kind = "SOFT_CASE"
            elif t[2] == "type" and toks[i + 1][0] == "NAME":
                kind = "SOFT_TYPE"
        start = kind in ("NEWLINE", "INDENT", "DEDENT", ";")
        yield kind, t[1], 0


def _lex(src: str) -> Iterator[tuple[str, int, object]]:
    pos, end = 0, len(src)
    indents = [(0, 0)]
    stack: list[tuple[str, int]] = []  # open brackets and f-strings
    line_start, has_tokens = True, False
    match, space = _TOKEN.match, _SPACE.match
    while True:
        if line_start and not stack:
            line_start = False
            col = alt = first = 0
            while pos < end and (src[pos] in " \t\f" or src.startswith("\\\n", pos)):
                c = src[pos]
                if c == "\\":
                    # blanks before a continuation are the line's indentation, if there are any
                    first, pos = first or col, pos + 2
                    continue
                col, alt = (0, 0) if c == "\f" else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (col + 1, alt + 1)
                pos += 1
            if first:
                col = alt = first
            if pos < end and src[pos] not in "#\n":
                have = indents[-1]
                if col == have[0]:
                    if alt != have[1]:
                        raise ParseError(pos, "inconsistent use of tabs and spaces")
                elif col > have[0]:
                    if alt <= have[1]:
                        raise ParseError(pos, "inconsistent use of tabs and spaces")
                    if len(indents) >= 100:
                        raise ParseError(pos, "too many levels of indentation")
                    indents.append((col, alt))
                    yield "INDENT", pos, None
                else:
                    while col < indents[-1][0]:
                        indents.pop()
                        yield "DEDENT", pos, None
                    if col != indents[-1][0]:
                        raise ParseError(pos, "unindent matches no outer level")
                    if alt != indents[-1][1]:
                        raise ParseError(pos, "inconsistent use of tabs and spaces")
        pos = space(src, pos).end()
        if pos >= end:
            break
        m = match(src, pos)
        if m is None:
            raise ParseError(pos, f"invalid character {src[pos]!r}")
        kind, text, at = m.lastgroup, m.group(), pos
        pos = m.end()
        if kind == "name":
            if pos < end and src[pos] in "'\"" and _PREFIX.match(text):
                has_tokens = True
                pos, toks = yield from _string(src, pos, text.lower(), at, stack)
                continue
            if not text.isascii():
                if not text.isidentifier():
                    raise ParseError(at, "invalid character in a name")
                text = unicodedata.normalize("NFKC", text)
            has_tokens = True
            yield (text, at, None) if text in KEYWORDS else ("NAME", at, text)
        elif kind == "op":
            has_tokens = True
            top = stack[-1] if stack else None
            if top and top[0] == "f" and text in ("}", ":", ":=", "!", "!=", "=", "=="):
                quote, raw, spec = top[1]
                if text == "}":
                    stack.pop()
                    yield "f}", at, None
                    pos = yield from _fstring(src, pos, quote, raw, stack, at, spec)
                    continue
                if text == "!" and not _CONVERSION.match(src, pos):
                    raise ParseError(at, "! must be followed by s, r or a")
                if text in (":", ":="):
                    pos = at + 1
                    yield "f:", at, None
                    stack[-1] = ("f", (quote, raw, spec))
                    pos = yield from _fstring(src, pos, quote, raw, stack, at, spec + 1)
                    continue
            if text in _OPEN:
                stack.append((text, at))
                if len(stack) > 200:
                    raise ParseError(at, "too many nested parentheses")
            elif text in ")]}":
                if not top or top[0] == "f" or _OPEN[top[0]] != text:
                    raise ParseError(at, f"unmatched {text!r}")
                stack.pop()
            yield text, at, None
        elif kind == "number":
            has_tokens = True
            if text[0] == "0" and len(text) > 1 and text.replace("_", "").isdigit() and text.strip("0_"):
                raise ParseError(at, "leading zeros in a number")
            if not _AFTER_NUMBER.match(src, pos) or (text == "0" and src[pos : pos + 1] in tuple("oOxXbB")):
                raise ParseError(at, "invalid number")
            yield "NUMBER", at, None
        elif kind == "newline":
            if stack:
                if any(s[0] == "f" and len(s[1][0]) == 1 and s[1][2] for s in stack):
                    raise ParseError(at, "unterminated f-string")
                continue
            if has_tokens:
                yield "NEWLINE", at, None
            has_tokens, line_start = False, True
        elif kind == "quote":
            has_tokens = True
            pos, _ = yield from _string(src, at, "", at, stack)
        elif kind == "join":
            if pos >= end:
                raise ParseError(at, "nothing follows the line continuation")
    if stack:
        raise ParseError(stack[-1][1] if isinstance(stack[-1][1], int) else end, "a bracket or f-string was never closed")
    if has_tokens:
        yield "NEWLINE", end, None
    for _ in indents[1:]:
        yield "DEDENT", end, None
    yield END, end, None


def _string(src: str, pos: int, prefix: str, at: int, stack: list):
    q = src[pos]
    quote = q * 3 if src.startswith(q * 3, pos) else q
    pos += len(quote)
    if "f" in prefix:
        yield "FSTART", at, None
        return (yield from _fstring(src, pos, quote, "r" in prefix, stack, at, 0)), None
    m = _BODY[quote].match(src, pos)
    if m is None:
        raise ParseError(at, "unterminated string")
    body = m.group()[: -len(quote)]
    if "b" in prefix and not body.isascii():
        raise ParseError(at, "bytes hold ASCII only")
    if "r" not in prefix and "\\" in body:
        _escapes(body, "b" in prefix, pos)
    yield ("BYTES" if "b" in prefix else "STRING"), at, None
    return m.end(), None


def _fstring(src: str, pos: int, quote: str, raw: bool, stack: list, at: int, spec: int):
    """The literal part from ``pos``: up to the next field, or the end of the string or of the format spec."""
    end, n = len(src), len(quote)
    begin = pos
    while True:
        if pos >= end:
            raise ParseError(at, "unterminated f-string")
        c = src[pos]
        if c == "\\":
            if not raw and src.startswith("\\N{", pos):
                stop = src.find("}", pos)
                if stop < 0:
                    raise ParseError(pos, "malformed character name")
                pos = stop + 1
            else:
                # a brace after a backslash still opens a field
                pos += 1 if src[pos + 1 : pos + 2] in "{}" else 2
        elif c == "{":
            if src.startswith("{{", pos) and not spec:
                pos += 2
                continue
            if pos > begin:
                if not raw:
                    _escapes(src[begin:pos], False, begin)
                yield "FMIDDLE", begin, None
            yield "f{", pos, None
            stack.append(("f", (quote, raw, spec)))
            if len(stack) > 150:
                raise ParseError(pos, "f-string fields nested too deeply")
            return pos + 1
        elif c == "}":
            if spec:
                if pos > begin:
                    yield "FMIDDLE", begin, None
                _, (quote, raw, outer) = stack.pop()
                yield "f}", pos, None
                return (yield from _fstring(src, pos + 1, quote, raw, stack, at, outer))
            if not src.startswith("}}", pos):
                raise ParseError(pos, "single } in an f-string")
            pos += 2
        elif src.startswith(quote, pos):
            if spec:
                raise ParseError(pos, "unterminated field in an f-string")
            if pos > begin:
                if not raw:
                    _escapes(src[begin:pos], False, begin)
                yield "FMIDDLE", begin, None
            yield "FEND", pos, None
            return pos + n
        elif c == "\n" and n == 1:
            raise ParseError(at, "unterminated f-string")
        else:
            pos += 1
