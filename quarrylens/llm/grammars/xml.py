"""Well-formed XML 1.0 with namespaces: tags match, attributes are unique, entities and prefixes are known."""

from __future__ import annotations

import re
from collections.abc import Iterator

from quarrylens.llm.lalr import END, ParseError

GRAMMAR = r"""
file: prolog element misc @document
prolog: declaration misc | declaration misc DOCTYPE misc
declaration: | DECLARATION
misc: | misc COMMENT | misc PI | misc SPACE
element: EMPTY @empty
| OPEN content CLOSE @element
content: @none
| content piece
piece: element | TEXT | SPACE | CDATA | COMMENT | PI
"""

_S = r"[ \t\n]"
_START = r":A-Z_a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c\u200d\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
_NAME = rf"[{_START}][{_START}\-.0-9\u00b7\u0300-\u036f\u203f\u2040]*"
_ATTR = re.compile(rf"{_S}+({_NAME}){_S}*={_S}*(\"[^<\"]*\"|'[^<']*')")
_TAG = re.compile(rf"<({_NAME})")
_TAG_END = re.compile(rf"{_S}*(/?)>")
_CLOSE = re.compile(rf"</({_NAME}){_S}*>")
_COMMENT = re.compile(r"<!--((?:[^-]|-[^-])*)-->")
_PI = re.compile(rf"<\?({_NAME})(?:{_S}+((?:[^?]|\?(?!>))*))?\?>")
_DECL = re.compile(rf"<\?xml{_S}+version{_S}*={_S}*(?:\"1\.[0-9]+\"|'1\.[0-9]+')(?:{_S}+encoding{_S}*={_S}*(?:\"[A-Za-z][\w.\-]*\"|'[A-Za-z][\w.\-]*'))?(?:{_S}+standalone{_S}*={_S}*(?:\"(?:yes|no)\"|'(?:yes|no)'))?{_S}*\?>")
_DOCTYPE = re.compile(rf"<!DOCTYPE{_S}+({_NAME})(?:{_S}+(?:SYSTEM{_S}+(?:\"[^\"]*\"|'[^']*')|PUBLIC{_S}+(?:\"[^\"]*\"|'[^']*'){_S}+(?:\"[^\"]*\"|'[^']*')))?{_S}*(\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\]{_S}*)?>")
_ENTITY = re.compile(rf"<!ENTITY{_S}+({_NAME}){_S}")
_REF = re.compile(rf"&(?:#([0-9]+)|#x([0-9a-fA-F]+)|({_NAME}));")
_BAD = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_KNOWN = {"amp", "lt", "gt", "apos", "quot"}  # fixed values: the predefined entities


def _close(v, at, below, la):
    (name, _), (end, where) = v[0], v[2]
    if name != end:
        raise ParseError(where, f"</{end}> closes <{name}>")
    return v[0]


ACTIONS = {"none": lambda v, at, below, la: 0, "document": lambda v, at, below, la: 0, "empty": lambda v, at, below, la: v[0], "element": _close}


def _refs(text: str, at: int, known: set[str]) -> None:
    pos = text.find("&")
    while pos >= 0:
        m = _REF.match(text, pos)
        if m is None:
            raise ParseError(at + pos, "a bare &")
        dec, hexa, name = m.groups()
        if name is not None:
            if name not in known:
                raise ParseError(at + pos, f"unknown entity {name}")
        else:
            n = int(dec) if dec else int(hexa, 16)
            if n > 0x10FFFF or (n < 0xD800 or n > 0xDFFF) and _BAD.match(chr(n)) or 0xD800 <= n <= 0xDFFF:
                raise ParseError(at + pos, "reference to no character")
        pos = text.find("&", m.end())


def tokens(src: str) -> Iterator[tuple[str, int, object]]:
    src = src.replace("\r\n", "\n").replace("\r", "\n")
    bad = _BAD.search(src)
    limit = bad.start() if bad else len(src)
    for tok in _lex(src):
        if tok[1] >= limit and bad:
            break
        yield tok
    if bad:
        raise ParseError(limit, f"character {src[limit]!r} is not allowed")


def _lex(src: str) -> Iterator[tuple[str, int, object]]:
    pos, end = 0, len(src)
    known = set(_KNOWN)
    spaces: list[dict] = [{"xml": 1, "xmlns": 1}]
    if src.startswith("\ufeff"):
        pos = 1
    if src.startswith("<?xml", pos) and src[pos + 5 : pos + 6] in (" ", "\t", "\n"):
        m = _DECL.match(src, pos)
        if m is None:
            raise ParseError(pos, "malformed XML declaration")
        yield "DECLARATION", pos, None
        pos = m.end()
    while pos < end:
        at = pos
        if src[pos] != "<":
            pos = src.find("<", at)
            pos = end if pos < 0 else pos
            text = src[at:pos]
            if "]]>" in text:
                raise ParseError(at + text.index("]]>"), "]]> in text")
            if "&" in text:
                _refs(text, at, known)
            yield ("TEXT" if text.strip(" \t\n") else "SPACE"), at, None
            continue
        two = src[pos + 1 : pos + 2]
        if two == "/":
            m = _CLOSE.match(src, pos)
            if m is None:
                raise ParseError(at, "malformed end tag")
            if len(spaces) > 1:
                spaces.pop()
            yield "CLOSE", at, (m[1], at)
        elif two == "?":
            m = _PI.match(src, pos)
            if m is None or m[1].lower() == "xml":
                raise ParseError(at, "malformed processing instruction")
            yield "PI", at, None
        elif src.startswith("<!--", pos):
            m = _COMMENT.match(src, pos)
            if m is None:
                raise ParseError(at, "unterminated comment or -- in it")
            yield "COMMENT", at, None
        elif src.startswith("<![CDATA[", pos):
            stop = src.find("]]>", pos)
            if stop < 0:
                raise ParseError(at, "unterminated CDATA section")
            yield "CDATA", at, None
            pos = stop + 3
            continue
        elif src.startswith("<!DOCTYPE", pos):
            m = _DOCTYPE.match(src, pos)
            if m is None:
                raise ParseError(at, "malformed DOCTYPE")
            known |= set(_ENTITY.findall(m[2] or ""))
            yield "DOCTYPE", at, None
        else:
            m = _TAG.match(src, pos)
            if m is None:
                raise ParseError(at, "a bare < or malformed tag")
            name, pos = m[1], m.end()
            attrs: list[str] = []
            scope = spaces[-1]
            while a := _ATTR.match(src, pos):
                if a[1] in attrs:
                    raise ParseError(a.start(1), f"attribute {a[1]} is given twice")
                attrs.append(a[1])
                if "&" in a[2]:
                    _refs(a[2], a.start(2), known)
                if a[1].startswith("xmlns:"):
                    if len(a[2]) == 2:
                        raise ParseError(a.start(1), "a prefix must not be undeclared")
                    scope = scope | {a[1][6:]: 1}
                pos = a.end()
            m = _TAG_END.match(src, pos)
            if m is None:
                raise ParseError(pos, f"malformed tag <{name}")
            for n in (name, *attrs):
                prefix, colon, local = n.partition(":")
                if colon and (prefix not in scope or not local or ":" in local or not prefix):
                    raise ParseError(at, f"unknown prefix in {n}")
            if m[1]:
                yield "EMPTY", at, (name, at)
            else:
                spaces.append(scope)
                yield "OPEN", at, (name, at)
        pos = m.end()
    yield END, end, None
