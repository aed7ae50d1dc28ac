"""Evaluation texts inside a corpus: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

A window of words walks through its own words: at each step the current word is written down and one random
bit of it, fixed for that step, tells whether the walk moves on. The written strings of two windows at a
small edit distance differ in few places (Chakraborty, Goldenberg, Koucky 2016), so sampled places of the
string, taken together as one key, collide often; repetitions with other bits and places raise the chance.
Equal windows always write the same string and always collide, so for passages without edits recall is 1
with one repetition. Candidates are verified by the edit distance of the words themselves.

The items' windows are the small side: their keys go to every task if their size, which is measured, is
below a bound, and documents are not shuffled at all. Above it the keys of both sides meet in a join.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.skew import hot_keys, join_unique
from quarrylens.session import materialize, spread

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, case folded."""
    return WORD.findall(text.casefold())


class Walk:
    """Keys of word windows. edits: the edit distance up to which windows are to be found."""

    def __init__(self, window: int, edits: int, repetitions: int, places: int, seed: int = 11):
        self.window, self.edits, self.repetitions = window, edits, repetitions
        self.steps = 3 * window
        each = [np.random.default_rng([seed, r]) for r in range(repetitions)]
        self.salts = np.array([rng.integers(1, 2**63, dtype=np.uint64) for rng in each], dtype=np.uint64)
        # places early in the walk, which few windows have left by then
        self.places = [set(rng.choice(2 * window, size=min(places, 2 * window), replace=False).tolist()) for rng in each]

    def only(self, rep: int) -> Walk:
        one = object.__new__(Walk)
        one.__dict__ = self.__dict__ | {"repetitions": 1, "salts": self.salts[rep : rep + 1], "places": self.places[rep : rep + 1]}
        return one

    def keys(self, toks: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each repetition the key of the window at each start; toks: a 64-bit hash of each word."""
        out = []
        last = starts + self.window
        padded = np.append(toks, np.uint64(0))
        for salt, places in zip(self.salts, self.places):
            sym = (padded ^ salt) * np.uint64(0x9E3779B97F4A7C15)
            sym ^= sym >> np.uint64(29)
            sym[-1] = 0
            p, key = starts.copy(), np.zeros(len(starts), dtype=np.uint64)
            for step in range(max(places) + 1):
                at = np.where(p < last, p, len(toks))
                s = sym[at]
                if step in places:
                    key = (key ^ s) * np.uint64(0xFF51AFD7ED558CCD)
                    key ^= key >> np.uint64(32)
                p += ((s >> np.uint64(step % 61 + 1)) & np.uint64(1)).astype(np.int64)
            out.append(key)
        return out


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two word lists, or most + 1 if it is larger; only a band of the table is filled."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    big = most + 1
    row = [j if j <= most else big for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [big] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, big)
        if min(new) > most:
            return big
        row = new
    return min(row[-1], big)


class _Hasher(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        return h


_HASH = _Hasher()


def _lay_out(lists: list[list[str]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all lists in a row, window starts, list number of each start)."""
    h = _HASH
    toks = np.array([h[w] for ws in lists for w in ws], dtype=np.uint64)
    sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    fits = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(lists)), fits)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(fits) - fits, fits) + begin[owner]
    return toks, starts, owner


class _Index:
    """The keys of all item windows, for one task."""

    def __init__(self, walk: Walk, items: list[tuple[int, list[str]]]):
        self.walk = walk
        self.ids = [i for i, _ in items]
        self.words = [w for _, ws in items for w in ws]
        toks, self.starts, self.owner = _lay_out([ws for _, ws in items], walk.window)
        self.sets: dict[int, frozenset[str]] = {}
        self.sorted = []
        for key in walk.keys(toks, self.starts):
            order = np.argsort(key, kind="stable")
            self.sorted.append((key[order], order))

    def only(self, rep: int) -> _Index:
        """The same index with one of its repetitions."""
        one = object.__new__(_Index)
        one.__dict__ = self.__dict__ | {"walk": self.walk.only(rep), "sorted": self.sorted[rep : rep + 1]}
        return one

    def said(self, start: int) -> frozenset[str]:
        """The words of the item window that begins at ``start``."""
        got = self.sets.get(start)
        if got is None:
            got = self.sets[start] = frozenset(self.words[start : start + self.walk.window])
        return got

    def find(self, lists: list[list[str]], edits: int | None = None) -> dict[tuple[int, int], int]:
        """(list number, item id) -> least edit distance, verified."""
        walk, w = self.walk, self.walk.window
        edits = walk.edits if edits is None else edits
        toks, starts, owner = _lay_out(lists, w)
        found: dict[tuple[int, int], int] = {}
        if not len(starts) or not len(self.starts):
            return found
        flat = [x for ws in lists for x in ws]
        tried: set[tuple[int, int]] = set()
        for key, (keys, order) in zip(walk.keys(toks, starts), self.sorted):
            lo = np.searchsorted(keys, key, "left")
            hit = np.flatnonzero((lo < len(keys)) & (keys[np.minimum(lo, len(keys) - 1)] == key))
            hi = np.searchsorted(keys, key[hit], "right")
            for at, a, b in zip(hit.tolist(), lo[hit].tolist(), hi.tolist()):
                s, doc = int(starts[at]), int(owner[at])
                mine = None
                for k in order[a:b].tolist():
                    pair = (doc, self.ids[self.owner[k]])
                    if found.get(pair) == 0 or (edits and (at, k) in tried):
                        continue
                    if edits:
                        tried.add((at, k))
                    if mine is None:
                        mine = flat[s : s + w]
                        have = set(mine)
                    t = int(self.starts[k])
                    # an edit takes one word away at most, so no more of the item's words may be absent
                    if edits and len(self.said(t) - have) > edits:
                        continue
                    d = edit_distance(mine, self.words[t : t + w], edits)
                    if d <= edits and d < found.get(pair, d + 1):
                        found[pair] = d
        return found


def edited(ws: list[str], edits: int, rng: np.random.Generator) -> list[str]:
    """The words after ``edits`` edits at random places: words changed, left out or put in alike."""
    out = list(ws)
    for n, what in enumerate(rng.integers(0, 3, edits).tolist()):
        at = int(rng.integers(0, len(out)))
        out[at : at + (what != 1)] = [] if what == 2 and len(out) > 1 else [f"new{n}"]
    return out


def measured_recall(walk: Walk, edits: int, trials: int = 400, seed: int = 5) -> list[float]:
    """The share that the first 1, 2, ... repetitions find of passages with ``edits`` edits in other text.

    Passages count that have a window at most ``edits`` edits away; a word put in or left out also moves a word over
    the window's end, so not all have.
    """
    rng = np.random.default_rng(seed)
    w, said, docs = walk.window, [], []
    while len(said) < trials:
        t = len(docs)
        ws = [f"{t}.{j}" for j in range(w)]
        doc = [f"{t}:a{j}" for j in range(w)] + edited(ws, int(rng.integers(1, edits + 1)), rng) + [f"{t}:b{j}" for j in range(w)]
        if min(edit_distance(doc[s : s + w], ws, edits) for s in range(w - edits, w + edits + 1)) == edits:
            said.append(ws)
            docs.append(doc)
    out, found, index = [], set(), _Index(walk, list(enumerate(said)))
    for rep in range(walk.repetitions):
        one = index.only(rep)
        found |= {d for (d, i) in one.find(docs, edits) if d == i}
        out.append(len(found) / trials)
    return out


@lru_cache(maxsize=None)
def repetitions_for(window: int, edits: int, places: int, target: float, most: int = 64) -> int:
    """The least number of repetitions whose measured recall of windows with ``edits`` edits reaches ``target``."""
    got = measured_recall(Walk(window, edits, most, places), edits)
    need = next((n for n, r in enumerate(got, 1) if r >= target), None)
    if need is None:
        raise ValueError(f"{most} repetitions find {got[-1]:.3f} of windows of {window} words with {edits} edits; take fewer places or a lower target")
    return need


def leaks(docs: DataFrame, items: DataFrame, window: int = 12, edits: int = 0, target_recall: float = 0.97, places: int | None = None, broadcast_bytes: int = 16 << 20, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``(doc_key, item_key, edits)``: documents and items with windows of ``window`` words at most ``edits`` edits apart.

    ``edits`` is the least number found. With edits = 0 the result is exact: all pairs that share ``window``
    consecutive words. With edits > 0 candidates come from several keys of ``places`` places each, as many as reach
    ``target_recall`` on windows with ``edits`` edits (measured once on random words, ``repetitions_for``; windows
    with fewer edits are found more often), and every pair returned is verified. Texts are
    read whole. Null texts and texts of fewer words give no row; repeated rows give one; an empty corpus or
    no items give an empty table. Other columns of either table do not matter.

    ``broadcast_bytes`` bounds what is sent to every task. It is held against the measured size of the items'
    text, and items beyond it take a join on the keys instead, with the same result.
    """
    places = places or (8 if edits == 0 else 4)
    repetitions = 1 if edits == 0 else repetitions_for(window, edits, places, target_recall)
    walk = Walk(window, edits, repetitions, places)
    docs = docs.filter(F.col(text).isNotNull()).select(doc_key, text)
    items = items.filter(F.col(text).isNotNull()).select(item_key, text)
    size = items.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    dt, it = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{doc_key}` {dt}, `{item_key}` {it}, edits int"
    if size <= broadcast_bytes:
        rows = [(r[item_key], words(r[text])) for r in items.collect()]
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches):
            index = _Index(walk, sent.value)
            for pdf in batches:
                ids = pdf[doc_key].tolist()
                got = index.find([words(t) for t in pdf[text]])
                yield pd.DataFrame([(ids[d], i, e) for (d, i), e in got.items()], columns=[doc_key, item_key, "edits"])

        found = spread(docs).mapInPandas(run, schema)
    else:
        found = _joined(docs, items, walk, doc_key, item_key, text, dt, it)
    return found.groupBy(doc_key, item_key).agg(F.min("edits").alias("edits"))


def _joined(docs, items, walk: Walk, doc_key: str, item_key: str, text: str, dt: str, it: str) -> DataFrame:
    """The same over a join of keys, for items that are too large to send to every task."""

    def windows(key: str, kt: str, df: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                lists = [words(t) for t in pdf[text]]
                flat = [x for ws in lists for x in ws]
                toks, starts, owner = _lay_out(lists, walk.window)
                ids = pdf[key].to_numpy()[owner]
                said = [" ".join(flat[s : s + walk.window]) for s in starts.tolist()]
                for n, k in enumerate(walk.keys(toks, starts) if len(starts) else []):
                    yield pd.DataFrame({"rep": np.int32(n), "k": k.view(np.int64), key: ids, "w": said})

        return spread(df).mapInPandas(run, f"rep int, k bigint, `{key}` {kt}, w string").distinct()

    # Distinct windows are matched and verified once, however many texts hold them.
    d, i = materialize(windows(doc_key, dt, docs)), windows(item_key, it, items)
    pairs = d.select("rep", "k", F.col("w").alias("dw")).distinct().join(i.select("rep", "k", F.col("w").alias("iw")).distinct(), ["rep", "k"]).select("dw", "iw").distinct()
    if walk.edits == 0:
        pairs = pairs.filter("dw = iw").withColumn("edits", F.lit(0))
    else:

        def verify(batches):
            for pdf in batches:
                both = [(a.split(" "), b.split(" ")) for a, b in zip(pdf.dw, pdf.iw)]
                e = [edit_distance(a, b, walk.edits) if len(set(b) - set(a)) <= walk.edits else walk.edits + 1 for a, b in both]
                yield pdf.assign(edits=pd.Series(e, dtype="int32", index=pdf.index)).query(f"edits <= {walk.edits}")

        pairs = pairs.mapInPandas(verify, "dw string, iw string, edits int")
    by_item = pairs.join(i.select(item_key, F.col("w").alias("iw")).distinct(), "iw").groupBy(F.col("dw").alias("w"), item_key).agg(F.min("edits").alias("edits"))
    by_doc = d.select(doc_key, "w").distinct()
    # a window that many documents share is split over parts
    often = by_doc.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(often, "w", "n", by_doc.count())
    return join_unique(by_doc, by_item, "w", hot, [doc_key]).select(doc_key, item_key, "edits")
