"""TOML 1.0, with the rule that no key is defined twice."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

from quarrylens.llm.lalr import END, ParseError

GRAMMAR = r"""
file: lines
lines: @start
| lines NEWLINE @first
| lines expression NEWLINE @line
expression: key '=' value @pair
| '[' key ']' @table
| '[[' key ']]' @tables
key: SIMPLE @key
| key '.' SIMPLE @longer
value: SCALAR | array | inline
array: '[' gap ']' @other
| '[' gap values gap ']' @other
| '[' gap values gap ',' gap ']' @other
values: value @other
| values gap ',' gap value @other
gap: | gap NEWLINE
inline: '{' '}' @empty_inline
| '{' pairs '}' @inline
pairs: key '=' value @pairs
| pairs ',' key '=' value @more_pairs
"""


class _Node:
    """A table of the document. kind: implied, header, dotted, inline, list or leaf."""

    __slots__ = ("kind", "kids")

    def __init__(self, kind: str):
        self.kind, self.kids = kind, {}


class _Doc:
    def __init__(self):
        self.root = self.at = _Node("header")

    def header(self, key: list[str], many: bool, at: int) -> None:
        node = self.root
        for k in key[:-1]:
            node = node.kids.setdefault(k, _Node("implied"))
            if node.kind == "list":
                node = node.kids["last"]
            elif node.kind in ("inline", "leaf"):
                raise ParseError(at, f"{k} is no table")
        last = key[-1]
        have = node.kids.get(last)
        if many:
            if have is None:
                have = node.kids[last] = _Node("list")
            elif have.kind != "list":
                raise ParseError(at, f"{last} is defined twice")
            self.at = have.kids["last"] = _Node("header")
        elif have is None:
            self.at = node.kids[last] = _Node("header")
        elif have.kind == "implied":
            have.kind = "header"
            self.at = have
        else:
            raise ParseError(at, f"{last} is defined twice")

    def pair(self, node: _Node, key: list[str], value, at: int) -> None:
        for k in key[:-1]:
            below = node.kids.get(k)
            if below is None:
                below = node.kids[k] = _Node("dotted")
            elif below.kind == "implied":
                below.kind = "dotted"
            elif below.kind != "dotted":
                raise ParseError(at, f"{k} is defined elsewhere")
            node = below
        if key[-1] in node.kids:
            raise ParseError(at, f"{key[-1]} is defined twice")
        node.kids[key[-1]] = value if isinstance(value, _Node) else _Node("leaf")


def _start(v, at, below, la):
    return _Doc()


def _line(v, at, below, la):
    doc, (what, key, value), where = v[0], v[1], at
    if what == "pair":
        doc.pair(doc.at, key, value, where)
    else:
        doc.header(key, what == "tables", where)
    return doc


def _inline(v, at, below, la):
    doc, node = _Doc(), _Node("inline")
    for key, value in v[1]:
        doc.pair(node, key, value, at)
    return node


ACTIONS = {
    "start": _start,
    "first": lambda v, at, below, la: v[0],
    "line": _line,
    "pair": lambda v, at, below, la: ("pair", v[0], v[2]),
    "table": lambda v, at, below, la: ("table", v[1], None),
    "tables": lambda v, at, below, la: ("tables", v[1], None),
    "key": lambda v, at, below, la: [v[0]],
    "longer": lambda v, at, below, la: v[0] + [v[2]],
    "other": lambda v, at, below, la: None,
    "empty_inline": lambda v, at, below, la: _Node("inline"),
    "inline": _inline,
    "pairs": lambda v, at, below, la: [(v[0], v[2])],
    "more_pairs": lambda v, at, below, la: v[0] + [(v[2], v[4])],
}

_SPACE = re.compile(r"[ \t]*(?:#[^\n\x00-\x08\x0b-\x1f\x7f]*)?")
_CTRL = r"\x00-\x08\x0a-\x1f\x7f"
_CTRL_ML = r"\x00-\x08\x0b-\x1f\x7f"
_ESC = r"\\(?:[btnfr\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
_BASIC = re.compile(rf'"((?:[^"\\{_CTRL}]|{_ESC})*)"')
_LITERAL = re.compile(rf"'([^'{_CTRL}]*)'")
_ML_BASIC = re.compile(rf'"""((?:[^"\\{_CTRL_ML}]|{_ESC}|\\[ \t]*\n[ \t\n]*|"(?!""))*)"""("{{0,2}})')
_ML_LITERAL = re.compile(rf"'''((?:[^'{_CTRL_ML}]|'(?!''))*)'''('{{0,2}})")
_BARE = re.compile(r"[A-Za-z0-9_-]+")
_NUMBER = re.compile(r"[+-]?(?:0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|(?:inf|nan)|(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?)")
_DATE = re.compile(r"(?:(\d{4})-(\d\d)-(\d\d))?(?:(?(1)[Tt ])(\d\d):(\d\d):(\d\d)(?:\.\d+)?)?(?:(?<=\d)([Zz]|[+-]\d\d:\d\d))?")
_VALUE_END = re.compile(r"[ \t\n,\]}#]|\Z")


def _unescape(body: str, at: int) -> str:
    def one(m):
        k = m.group()[1]
        if k in "uU":
            n = int(m.group()[2:], 16)
            if n > 0x10FFFF or 0xD800 <= n < 0xE000:
                raise ParseError(at, "escape of no character")
            return chr(n)
        return {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r"}.get(k, k)

    return re.sub(_ESC, one, body) if "\\" in body else body


def _quoted(src: str, pos: int, multi: bool) -> tuple[str, int]:
    q = src[pos]
    if multi and src.startswith(q * 3, pos):
        m = (_ML_BASIC if q == '"' else _ML_LITERAL).match(src, pos)
    else:
        m = (_BASIC if q == '"' else _LITERAL).match(src, pos)
    if m is None:
        raise ParseError(pos, "unterminated or malformed string")
    return (_unescape(m[1], pos) if q == '"' else m[1]), m.end()


def _scalar(src: str, pos: int) -> int:
    """The end of the number, date or boolean at ``pos``."""
    m = _DATE.match(src, pos)
    if m and m.end() > pos and _VALUE_END.match(src, m.end()):
        y, mo, d, h, mi, s, off = m.groups()
        if (y or h) and not (off and not (y and h)):
            try:
                if y:
                    datetime.date(int(y), int(mo), int(d))
                if h:
                    datetime.time(int(h), int(mi), int(s))
                if off and off not in "Zz" and not (int(off[1:3]) < 24 and int(off[4:]) < 60):
                    raise ValueError
            except ValueError:
                raise ParseError(pos, "no such date or time") from None
            return m.end()
    for word in ("true", "false"):
        if src.startswith(word, pos) and _VALUE_END.match(src, pos + len(word)):
            return pos + len(word)
    m = _NUMBER.match(src, pos)
    if m and _VALUE_END.match(src, m.end()) and not (m.group()[0] in "+-" and m.group()[1:2] == "0" and m.group()[2:3] in ("x", "o", "b")):
        return m.end()
    raise ParseError(pos, "invalid value")


def tokens(src: str) -> Iterator[tuple[str, int, object]]:
    src = src.replace("\r\n", "\n")
    if not src.endswith("\n"):
        src += "\n"
    pos, end = 0, len(src)
    stack: list[str] = []
    want_key, start, header = True, True, False
    while True:
        pos = _SPACE.match(src, pos).end()
        if pos >= end:
            break
        c, at = src[pos], pos
        if c == "\n":
            pos += 1
            yield "NEWLINE", at, None
            if not stack:
                want_key = start = True
                header = False
            elif stack[-1] == "{":
                raise ParseError(at, "a line end in an inline table")
            continue
        if start and c == "[":
            double = src.startswith("[[", pos)
            pos += 1 + double
            header = True
            yield "[[" if double else "[", at, None
        elif header and c == "]":
            double = src.startswith("]]", pos)
            pos += 1 + double
            header, want_key = False, False
            yield "]]" if double else "]", at, None
        elif c in "[{":
            stack.append(c)
            pos += 1
            want_key = c == "{"
            yield c, at, None
        elif c in "]}":
            if not stack or {"[": "]", "{": "}"}[stack.pop()] != c:
                raise ParseError(at, f"unmatched {c}")
            pos += 1
            want_key = False
            yield c, at, None
        elif c == ",":
            pos += 1
            want_key = bool(stack) and stack[-1] == "{"
            yield c, at, None
        elif c == "=":
            pos += 1
            want_key = False
            yield c, at, None
        elif want_key and c == ".":
            pos += 1
            yield c, at, None
        elif c in "\"'":
            text, pos = _quoted(src, pos, not want_key)
            yield ("SIMPLE", at, text) if want_key else ("SCALAR", at, None)
        elif want_key:
            m = _BARE.match(src, pos)
            if m is None:
                raise ParseError(at, f"unexpected character {c!r}")
            pos = m.end()
            yield "SIMPLE", at, m.group()
        else:
            pos = _scalar(src, pos)
            yield "SCALAR", at, None
        start = False
    if stack:
        raise ParseError(end, "an array or inline table was never closed")
    yield END, end, None
