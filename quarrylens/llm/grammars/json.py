"""Strict JSON (RFC 8259)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from quarrylens.llm.lalr import END, ParseError

GRAMMAR = r"""
file: value
value: object | array | STRING | NUMBER | 'true' | 'false' | 'null'
object: '{' '}' | '{' members '}'
members: member | members ',' member
member: STRING ':' value
array: '[' ']' | '[' items ']'
items: value | items ',' value
"""

ACTIONS: dict = {}

_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.+-]))|(?P<word>true|false|null)(?!\w)|(?P<op>[{}\[\],:])|(?P<end>\Z))')


def lexemes(src: str) -> Iterator[tuple[str, int, object]]:
    """``(terminal, place, raw text)``."""
    pos, match = 0, _TOKEN.match
    while True:
        m = match(src, pos)
        if m is None:
            pos += len(src[pos:]) - len(src[pos:].lstrip(" \t\n\r"))
            raise ParseError(pos, "unterminated or malformed string" if src[pos : pos + 1] == '"' else f"unexpected character {src[pos : pos + 1]!r}")
        kind = m.lastgroup
        text = m[kind]
        at, pos = m.start(kind), m.end()
        if kind == "end":
            yield END, at, None
            return
        yield {"string": "STRING", "number": "NUMBER"}.get(kind, text), at, text


def tokens(src: str) -> Iterator[tuple[str, int, object]]:
    return lexemes(src)
