"""What a damaged token may have said: lattices over its bytes, with wildcards for bytes that were lost.

A channel is a pair (charset the bytes were read in, charset they were written in). A token's characters are turned
back into the bytes they were read from; U+FFFD gives a byte that may be any. Over these bytes there is an edge for
each character of the charset of writing that may begin there, and an edge that keeps the character as it stands, so
that sound and damaged characters may share a run. The path of the likeliest characters is taken.
A lost byte whose character is a letter stays open, with the letters it may be, for the search over words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

LOST = "�"
NBSP = "\xa0"
# Tokens that hold something beyond ASCII.
TOKEN = re.compile(r"(?<![^ \t\n\r\f\v])[\x00-\x08\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^ \t\n\r\f\v]*")
_IDEO = "぀-ヿ㐀-䶿一-鿿가-힣"
# Words: ideographs and syllables one by one, runs of other letters and lost ones, other symbols beyond ASCII one by one.
WORD = re.compile(rf"[A-Za-z]++(?![^\x00-\x7f])|[{_IDEO}]|(?:[^\W\d_{_IDEO}]|{LOST})+|[^\x00-\x7f]")
LOST_WORD = re.compile(rf"[^\W\d_]*(?:{LOST}+[^\W\d_]*)+")
# A Latin letter beside a Cyrillic one, two beside a Greek one (formulas have one).
_MIXED = re.compile(r"[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]|[A-Za-zÀ-ɏ]{2}[Ͱ-Ͽ]|[Ͱ-Ͽ][A-Za-zÀ-ɏ]{2}")
_PRINTED = re.compile(r"[\x20-\x7e\n\t]*\Z")
_RUN = re.compile(rf"[^\x00-\x7f{LOST}]+")

# Charsets in which UTF-8 was read, and (read as, written in) of charsets of one byte a character.
# The windows charsets take the controls U+0080 to U+009F as bytes too, so that windows-1252 covers Latin-1.
UTF8_READ = [
    "windows-1252", "mac-roman", "cp437", "cp850", "windows-1251", "windows-1250", "iso-8859-15", "cp866", "koi8-r",
    "iso-8859-2", "iso-8859-5", "iso-8859-7", "iso-8859-9", "windows-1253", "windows-1254",
]
BYTE_READ = [
    ("windows-1252", "windows-1251"), ("windows-1252", "koi8-r"), ("windows-1252", "cp866"), ("windows-1251", "koi8-r"),
    ("koi8-r", "windows-1251"), ("windows-1251", "cp866"), ("cp866", "windows-1251"), ("windows-1251", "windows-1252"),
    ("cp437", "windows-1252"), ("cp850", "windows-1252"), ("mac-roman", "windows-1252"), ("windows-1252", "mac-roman"),
    ("windows-1252", "cp437"), ("windows-1252", "cp850"), ("windows-1252", "iso-8859-2"), ("windows-1252", "windows-1250"),
    ("windows-1252", "iso-8859-5"), ("windows-1252", "iso-8859-7"), ("windows-1252", "windows-1253"),
    ("windows-1252", "iso-8859-9"), ("windows-1250", "windows-1252"),
]
WIDE_READ = ["gb18030", "big5", "shift_jis", "euc-kr"]  # written in these, read as windows-1252
LOST_READ = ["windows-1252", "windows-1250", "windows-1251"]  # written in these, read as UTF-8 or ASCII, all beyond ASCII lost


class Charset:
    """A charset of one byte a character."""

    def __init__(self, name: str):
        self.name = name
        self.char: list[str | None] = []
        self.holes: set[int] = set()
        for b in range(256):
            try:
                c = bytes([b]).decode(name)
            except UnicodeDecodeError:
                self.holes.add(b)
                c = None
            self.char.append(c)
        self.byte = {c: b for b, c in enumerate(self.char) if c is not None}
        if name.startswith("windows"):
            self.byte = {chr(b): b for b in range(0x80, 0xA0)} | self.byte
        self.high = frozenset(c for c, b in self.byte.items() if b > 127)

    def some(self, a: int, b: int) -> str:
        """The characters of bytes a to b - 1, for a class of a pattern."""
        return "".join(re.escape(c) for c, x in self.byte.items() if a <= x < b)

    def letters(self) -> str:
        return "".join(c for c in self.char[128:] if c is not None and c.isalpha())


@lru_cache(None)
def charset(name: str) -> Charset:
    return Charset(name)


class Chars:
    """The corpus's character counts as log probabilities, and which characters fit bytes with wildcards."""

    def __init__(self, logs: dict[str, float], floor: float, sure: float):
        self.logs, self.floor, self.sure = logs, floor, sure

    def score(self, s: str) -> float:
        get, floor = self.logs.get, self.floor
        return sum([get(c, floor) for c in s])

    @cached_property
    def _fits(self) -> dict[str, dict[tuple, list[str]]]:
        return {}

    def fits(self, written: str, pattern: tuple[int, ...]) -> list[str]:
        """The corpus's characters whose bytes in ``written`` match the pattern; -1 stands for any byte."""
        index = self._fits.get(written)
        if index is None:
            index = self._fits[written] = {}
            for c in self.logs:
                if c <= "\x7f" or c == LOST:
                    continue
                try:
                    b = c.encode(written)
                except UnicodeEncodeError:
                    continue
                for mask in range(1, (1 << len(b)) - 1):
                    index.setdefault(tuple(-1 if mask >> i & 1 else x for i, x in enumerate(b)), []).append(c)
        return index.get(pattern, [])

    def settle(self, allowed: list[str]) -> tuple[str, str]:
        """(character, class) of a lost character: a letter stays open, another is taken if it has the share ``sure`` of all that fit."""
        best = max(allowed, key=lambda c: (self.logs[c], c))
        if best.isalpha() and not re.match(f"[{_IDEO}]", best):
            return LOST, "".join(sorted(c for c in allowed if c.isalpha()))
        total = sum(math.exp(self.logs[c] - self.logs[best]) for c in allowed)
        return (best if total * self.sure <= 1 else LOST), ""


def _sequence(b: bytes, written: str) -> str | None:
    try:
        return b.decode(written)
    except UnicodeDecodeError:
        return None


def best_path(text: str, to_bytes: Callable[[str], bytes | None], written: str, chars: Chars, holes: set[int]) -> tuple[str, list[str]]:
    """The likeliest reading of ``text``: (restored, the class of each lost character left open in it).

    ``to_bytes`` gives a character's bytes, None where it cannot have been read from any.
    """
    data: list[int] = []
    keep: dict[int, tuple[int, str]] = {}  # byte place -> (place after the character, character)
    ends: set[int] = set()
    for c in text:
        at = len(data)
        b = (-1,) if c == LOST else to_bytes(c)
        data += b if b else [-2]
        keep[at] = (len(data), c)
        ends.add(len(data))
    n = len(data)
    utf8 = written == "utf-8"
    none = (float("-inf"), 0, "", None)
    best: list[tuple] = [none] * (n + 1)
    best[0] = (0.0, -1, "", None)
    for i in range(n):
        s = best[i][0]
        if s == float("-inf"):
            continue
        if i in keep:
            j, c = keep[i]
            t = s + (chars.logs.get(c, chars.floor) if c != LOST else chars.floor - 8)
            if t > best[j][0]:
                best[j] = (t, i, c, None)
        x = data[i]
        if x == -2 or 0 <= x < 128:
            continue
        for k in (2, 3, 4) if utf8 else (2,):
            part = data[i : i + k]
            if len(part) < k or -2 in part:
                break
            if utf8:
                if x >= 0 and k != (2 if 0xC2 <= x < 0xE0 else 3 if 0xE0 <= x < 0xF0 else 4 if 0xF0 <= x < 0xF5 else 0):
                    continue
                if any(0 <= y < 128 or y > 191 for y in part[1:]):
                    break
            if -1 not in part:
                c = _sequence(bytes(part), written)
                if c is not None and len(c) == 1 and not (ord(c) < 32 or 0x7F <= ord(c) < 0xA0 and not utf8):
                    t = s + chars.logs.get(c, chars.floor)
                    if t > best[i + k][0]:
                        best[i + k] = (t, i, c, None)
                continue
            if all(y == -1 for y in part):
                continue
            allowed = chars.fits(written, tuple(part))
            price = 0.0
            if holes and allowed:
                exact = [c for c in allowed if all(y != -1 or z in holes for y, z in zip(part, c.encode(written)))]
                allowed, price = (exact, 0.0) if exact else (allowed, 4.0)
            if allowed:
                t = s + max(chars.logs[c] for c in allowed) - price
                if t > best[i + k][0]:
                    best[i + k] = (t, i, *chars.settle(allowed))
    out, classes, at = [], [], n
    while at > 0:
        _, back, c, cls = best[at]
        out.append(c)
        if c == LOST:
            classes.append(cls or "")
        at = back
    return "".join(reversed(out)), classes[::-1]


class Utf8As:
    """UTF-8 read as a charset of one byte a character."""

    def __init__(self, read: str):
        self.name, self.set = f"utf-8 as {read}", charset(read)
        of = self.set.some
        cont = f"[{of(0x80, 0xC0)}{LOST}]"
        self.leads = frozenset(c for c in self.set.char[0xC2:0xF5] if c is not None)
        self.find = re.compile(f"[{of(0xC2, 0xE0)}]{cont}|[{of(0xE0, 0xF0)}]{cont}{{2}}|[{of(0xF0, 0xF5)}]{cont}{{3}}")
        self.region = re.compile(f"[{of(0x80, 0x100)}{LOST}]+")
        self.blank = 0xA0 if self.set.char[0xA0] == NBSP else None

    def undo(self, token: str, high: frozenset, chars: Chars) -> tuple[str, list[str]] | None:
        if high.isdisjoint(self.leads) or not self.find.search(token):
            return None
        classes: list[str] = []
        byte = self.set.byte

        def region(m: re.Match) -> str:
            s = m.group()
            if LOST not in s:
                whole = _sequence(bytes([byte[c] for c in s]), "utf-8")
                if whole is not None:
                    return whole
            t, cls = best_path(s, lambda c: (byte[c],), "utf-8", chars, self.set.holes)
            classes.extend(cls)
            return t

        return self.region.sub(region, token), classes


class BytesAs:
    """A charset of one byte a character read as another one."""

    def __init__(self, read: str, written: str):
        self.name, self.set = f"{written} as {read}", charset(read)
        w = charset(written)
        self.table = {ord(c): w.char[b] for c, b in self.set.byte.items() if b > 127 and w.char[b] is not None}
        self.gains: dict[str, float] = {}
        self.open = "".join(c for b in sorted(self.set.holes) if (c := w.char[b]) is not None and c.isalpha())

    def undo(self, token: str, high: frozenset, chars: Chars) -> tuple[str, list[str]] | None:
        if high.isdisjoint(self.set.high) or any(c.isalpha() and ord(c) not in self.table for c in high):
            return None
        gains, gain = self.gains, 0.0
        for c in token:
            if c > "\x7f":
                g = gains.get(c)
                if g is None:
                    g = gains[c] = chars.score(self.table.get(ord(c), c)) - chars.score(c)
                gain += g
        if gain <= 0:
            return None
        t = token.translate(self.table)
        if any(0x7F <= ord(c) < 0xA0 for c in t):
            return None
        return t, [self.open] * t.count(LOST)


class WideAs:
    """A charset of two bytes a character read as windows-1252; bytes of ASCII may be part of its characters."""

    def __init__(self, written: str):
        self.name, self.written, self.set = f"{written} as windows-1252", written, charset("windows-1252")

    def undo(self, token: str, high: frozenset, chars: Chars) -> tuple[str, list[str]] | None:
        if high.isdisjoint(self.set.high):
            return None
        byte = self.set.byte
        if LOST not in token and high <= self.set.high:
            t = _sequence(bytes([byte[c] for c in token]), self.written)
            return None if t is None else (t, [])
        return best_path(token, lambda c: (byte[c],) if c in byte else None, self.written, chars, self.set.holes)


class Utf8AsWide:
    """UTF-8 read as GB 18030, where a character has two bytes or four."""

    name = "utf-8 as gb18030"

    def undo(self, token: str, high: frozenset, chars: Chars) -> tuple[str, list[str]] | None:
        if not any(c > "Ѐ" and c != LOST for c in high):
            return None
        classes: list[str] = []

        def region(m: re.Match) -> str:
            s = m.group()
            if LOST not in s:
                whole = _sequence(s.encode("gb18030"), "utf-8")
                if whole is not None:
                    return whole
                # one character of three or more UTF-8 bytes at least must be there to be undone
                if not _UTF8_BYTES.search(s.encode("gb18030")):
                    return s
            t, cls = best_path(s, lambda c: c.encode("gb18030"), "utf-8", chars, set())
            classes.extend(cls)
            return t

        return _BEYOND.sub(region, token), classes


_BEYOND = re.compile(r"[^\x00-\x7f]+")
_UTF8_BYTES = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]){3}")


class Utf8As16:
    """ASCII read as UTF-16, two characters in one."""

    def __init__(self, order: str):
        self.name, self.order = f"utf-8 as utf-16-{order}", f"utf-16-{order}"

    def undo(self, token: str, high: frozenset, chars: Chars) -> tuple[str, list[str]] | None:
        if not any(" " < c < "缀" for c in high):
            return None

        def run(m: re.Match) -> str:
            try:
                b = m.group().encode(self.order)
            except UnicodeEncodeError:
                return m.group()
            t = b.decode("latin-1")
            # short runs must be words, since a single ideograph may fall on two printed characters
            good = _PRINTED.match(t) and (len(t) >= 12 or sum(c.isalpha() or c == " " for c in t) >= 0.75 * len(t))
            return t if good else m.group()

        return _RUN.sub(run, token), []


UTF8 = [Utf8As(r) for r in UTF8_READ]
CHANNELS = [*UTF8, Utf8AsWide(), *(BytesAs(r, w) for r, w in BYTE_READ), *(WideAs(w) for w in WIDE_READ), Utf8As16("le"), Utf8As16("be")]
_TIMES = {1: "", 2: " twice", 3: " three times", 4: " four times"}
RANK = {ch.name + t: n for n, (t, ch) in enumerate((t, ch) for t in _TIMES.values() for ch in CHANNELS)}


def candidates(token: str, chars: Chars, channels: list = CHANNELS) -> Iterator[tuple[str, str, list[str]]]:
    """(channel, restored, classes of its lost characters) of each way in which the token may have been damaged.

    UTF-8 may have been misread up to four times in one charset. A restoration does not make a word of two
    alphabets where there was none, and its characters are likelier than the token's.
    """
    high = frozenset(c for c in token if c > "\x7f")
    if not high - {LOST}:
        return
    mixed, mine = _MIXED.search(token), chars.score(token)
    for ch in channels:
        said, at, set_, times = token, mine, high, 0
        while True:
            got = ch.undo(said, set_, chars)
            if got is None or got[0] == said or (not mixed and _MIXED.search(got[0])):
                break
            said, classes = got
            here = chars.score(said)
            if here <= at:
                break
            at, times = here, times + 1
            yield ch.name + _TIMES[times], said, classes
            set_ = frozenset(c for c in said if c > "\x7f")
            if ch not in UTF8 or times == 4 or any(classes) or not set_:
                break


_ELISION = re.compile(rf"(?<![^\W\d_])([^\W\d_]{{1,2}}){LOST}(?={LOST}|[^\W\d_])")
_ELIDED = re.compile(rf"(?<![^\W\d_])([^\W\d_]{{1,2}}){LOST}{{3}}(?=(?:{LOST}{{2}})+[^{LOST}]|[^\W\d_])")
_GAP = re.compile(f"{LOST}+")


def lost_candidates(token: str) -> Iterator[tuple[str, str, list[str]]]:
    """(channel, the token with one U+FFFD a lost letter, their classes) for tokens that lost characters.

    Each U+FFFD stands for one byte of a charset of one byte a character, for one byte of UTF-8, of which two
    make a letter, or for one character. A lost apostrophe after one or two letters is tried as well.
    """
    n = token.count(LOST)
    short = _ELISION.sub("\\1’", token, count=1)
    for name in LOST_READ:
        cls = charset(name).letters()
        yield f"{name} as utf-8", token, [cls] * n
        if short != token:
            yield f"{name} as utf-8", short, [cls] * (n - 1)
    yield "lost characters", token, [""] * n
    if short != token:
        yield "lost characters", short, [""] * (n - 1)
    # the apostrophe has three bytes
    two = _ELIDED.sub("\\1’", token)
    if two != token or any(len(g) % 2 == 0 for g in _GAP.findall(token)):
        two = _GAP.sub(lambda m: LOST * (len(m.group()) // 2 if len(m.group()) % 2 == 0 else len(m.group())), two)
        yield "utf-8 as ascii", two, [""] * two.count(LOST)


def masks(word: str, classes: list[str]) -> tuple[list[str], str]:
    """(lookup keys, pattern) of a word with lost letters; classes: the letters each may be, '' for any beyond ASCII.

    A word that kept an ASCII letter is looked up by its ASCII letters, another by its length and the longer of what
    stands before the first and after the last lost letter. No key: nothing is left to look up.
    """
    it = iter(classes)
    pattern = "".join((f"[{c}]" if (c := next(it)) else r"[^\x00-\x7f]") if x == LOST else re.escape(x) for x in word)
    if re.search("[A-Za-z]", word):
        return ["a:" + re.sub(r"[^\x00-\x7f]+", LOST, word)], pattern
    before, after = word[: word.index(LOST)], word[word.rindex(LOST) + 1 :]
    if not before and not after:
        return [], pattern
    return [f"p:{len(word)}:{before}" if len(before) >= len(after) else f"s:{len(word)}:{after}"], pattern
