"""Python sources with their syntax tree and places in characters."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable
from functools import cached_property, lru_cache

_LINE_END = re.compile(r"\r\n|\r|\n")  # as the parser counts lines

_TEXT_ONLY = {"ctx", "op", "ops", "id", "attr", "arg", "kind", "type_comment", "lineno", "level", "module", "asname", "conversion", "simple", "is_async"}
_HOLDS: dict[type, tuple[str, ...]] = {}  # the fields of a class that may hold nodes


def _holds(kind: type) -> tuple[str, ...]:
    no = _TEXT_ONLY | ({"value"} if kind is ast.Constant else {"names"} if kind in (ast.Global, ast.Nonlocal) else set())
    return _HOLDS.setdefault(kind, tuple(f for f in kind._fields if f not in no))


class Source:
    """A text that parses, with character spans for its nodes (the parser counts bytes)."""

    def __init__(self, text: str):
        self.text = text
        self.tree = ast.parse(text)
        self._of_kind: dict[tuple, list[ast.AST]] = {}

    @cached_property
    def _ends(self) -> list[tuple[int, int]]:
        return [m.span() for m in _LINE_END.finditer(self.text)]

    @cached_property
    def starts(self) -> list[int]:
        return [0, *(b for _, b in self._ends)]

    @cached_property
    def lines(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.starts, [*(a for a, _ in self._ends), len(self.text)])]

    def at(self, line: int, col: int) -> int:
        row = self.lines[line - 1]
        if not row.isascii():
            col = len(row.encode()[:col].decode(errors="ignore"))
        return self.starts[line - 1] + col

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def of(self, node: ast.AST) -> str:
        a, b = self.span(node)
        return self.text[a:b]

    def walk(self, *kinds: type) -> list[ast.AST]:
        """All nodes of these kinds, from the top down; the tree is walked once, however many rules ask."""
        got = self._of_kind.get(kinds)
        if got is None:
            plain = len(kinds) == 1 and not kinds[0].__subclasses__()
            got = self._of_kind[kinds] = self._by_type.get(kinds[0], []) if plain else [n for n in self._nodes if isinstance(n, kinds)]
        return got

    @cached_property
    def _by_type(self) -> dict[type, list[ast.AST]]:
        out: dict[type, list[ast.AST]] = {}
        for n in self._nodes:
            out.setdefault(type(n), []).append(n)
        return out

    @cached_property
    def _nodes(self) -> list[ast.AST]:
        """As ``ast.walk`` gives them, but operators and contexts, which have no place."""
        out = [self.tree]
        for n in out:  # grows on the way
            have = n.__dict__
            kind = n.__class__
            for f in _HOLDS[kind] if kind in _HOLDS else _holds(kind):
                x = have.get(f)
                if x.__class__ is list:
                    out += [c for c in x if isinstance(c, ast.AST)]
                elif isinstance(x, ast.AST):
                    out.append(x)
        return out

    def body_text(self, body: list[ast.stmt]) -> tuple[int, int]:
        """The span of whole lines of a block's statements, or of the statements on a line with the colon."""
        a, b = self.at(body[0].lineno, 0), self.span(body[-1])[1]
        first = min([body[0].lineno, *(d.lineno for d in getattr(body[0], "decorator_list", []))])
        a = self.at(first, 0)
        if self.text[a : self.span(body[0])[0]].strip():
            a = self.span(body[0])[0]
        return a, b


def edited(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """The text with the edits made from the right; of edits that overlap the outer one, then the first, is made."""
    chosen: list[tuple[int, int, str]] = []
    for a, b, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if not chosen or a >= chosen[-1][1] and (a, b) != chosen[-1][:2]:
            chosen.append((a, b, new))
    for a, b, new in reversed(chosen):
        text = text[:a] + new + text[b:]
    return text


@lru_cache(maxsize=512)
def source(text: str) -> Source | None:
    """The parsed text, or None where it does not parse."""
    try:
        return Source(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@lru_cache(maxsize=512)
def recovered(text: str | None) -> tuple[Source | None, int, str]:
    """(source, lines put before it, parse status) of the longest line prefix that parses.

    Status is complete, prefix, none where not a statement parses, or null. A text that goes on an indented
    body, as a completion does, is read as one, under a line of its own; of two prefixes the longer one counts.
    """
    if text is None:
        return None, 0, "null"
    shifts = (0, 1) if text[:1] in (" ", "\t", "\n") else (0,)
    for shift in shifts:
        if (s := source("if 1:\n" * shift + text)) is not None:
            return s, shift, "complete"
    best: tuple[int, Source | None, int] = (0, None, 0)
    for shift in shifts:
        whole = "if 1:\n" * shift + text
        ends = [m.end() for m in _LINE_END.finditer(whole)]
        n = len(ends) + (not ends or ends[-1] < len(whole))
        while n - shift > best[0]:
            part = whole[: ends[n - 1]] if n <= len(ends) else whole
            try:
                s = Source(part)
            except SyntaxError as e:
                # the fault stays in each prefix that holds its line
                n = min(n - 1, e.lineno or n)
            except (ValueError, RecursionError, MemoryError):
                n -= 1
            else:
                if s.tree.body:
                    best = (n - shift, s, shift)
                break
    return best[1], best[2], "prefix" if best[1] is not None else "none"
