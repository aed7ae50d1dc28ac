"""Text read in the wrong encoding: noisy-channel decoding under corpus word frequencies.

Every token of a text that is not ASCII opens a lattice (``llm/lattice.py``): the token as it stands, and what its
bytes give for each channel of a table, with wildcards for lost bytes. Words with wildcards meet the corpus words
that fit. Viterbi search picks each text's path: words score by their corpus frequency, a change into a damaged
state has a price and staying in it has none.

Frequencies are counted over the whole corpus. Only character counts, bounded by Unicode's code space, go to
every task; words meet their counts in a join. Tokens are decoded and scored once each and not at every place.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.llm.lattice import LOST, LOST_WORD, NBSP, RANK, TOKEN, UTF8, WORD, Chars, candidates, lost_candidates, masks
from quarrylens.operators.skew import hot_keys, join_unique
from quarrylens.session import materialize, spread


def _logs(counts: dict[str, int]) -> tuple[dict[str, float], float]:
    total = sum(counts.values()) or 1
    return {c: math.log(n / total) for c, n in counts.items()}, math.log(0.05 / total)


def _corpus_counts(docs: DataFrame, text: str) -> DataFrame:
    """``(what, x, n)``: how often each character (what = c) and word (w) occurs in all texts, combined within each task."""

    def run(batches):
        c = np.zeros(0x110000, dtype=np.int64)
        w: Counter = Counter()

        def words():
            return pd.DataFrame([("w", x, n) for x, n in w.items()], columns=["what", "x", "n"])

        for pdf in batches:
            for t in pdf[text]:
                points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if len(points):
                    few = np.bincount(points)
                    c[: len(few)] += few
                w.update(WORD.findall(t))
            if len(w) > 300_000:
                yield words()
                w.clear()
        yield words()
        yield pd.DataFrame([("c", chr(i), c[i]) for i in np.flatnonzero(c)], columns=["what", "x", "n"])

    return spread(docs.select(text)).mapInPandas(run, "what string, x string, n bigint").groupBy("what", "x").agg(F.sum("n").alias("n"))


_WORDS = "array<struct<w:string,lp:double,pat:string,keys:array<string>>>"


def damage(docs: DataFrame, key: str = "doc_id", text: str = "text", start_price: float = 6.0, token_price: float = 0.3, unclean: float = 8.0, sure: float = 0.75) -> DataFrame:
    """``(key, spans)`` of every document with damage; spans: array of (start, end, channel, restored).

    ``channel`` names the wrong reading, or ``lost`` for lost characters of which nothing is known, whose ``restored``
    is null. ``start_price`` is what entering a damaged state costs in the search, ``token_price`` what each
    further token costs, both in natural logs of a probability. Into the lattice go restorations whose
    characters are likelier than the token's own. Where they are so by ``unclean``, the token as it stands does
    not count towards the word frequencies, so that damage which recurs does not become a word. A word that
    is not in the corpus then is spelled out by its characters. A word with lost letters has the frequency of
    the likeliest corpus word that fits, and is filled where that word has at least the share ``sure`` of all that fit.

    Null, empty and ASCII texts have no damage. A repeated text under another key is judged again; rows
    repeated under one key are searched together and give one row. Whole texts are read.
    """
    docs = docs.filter(F.col(text).isNotNull()).select(key, text)
    kt = docs.schema[key].dataType.simpleString()
    beyond = docs.filter(F.octet_length(text) > F.char_length(text))
    # at most one row for each of Unicode's 1,114,112 code points
    counts = materialize(_corpus_counts(docs, text))
    sent = docs.sparkSession.sparkContext.broadcast((*_logs({r.x: r.n for r in counts.filter("what = 'c'").select("x", "n").collect()}), sure))
    cand = materialize(spread(beyond).mapInPandas(_lattices(sent, key, text, unclean), f"`{key}` {kt}, start int, end int, token string, ch string, alt int, said string, words {_WORDS}, bad boolean"))

    places = cand.filter("ch IS NULL").select(key, "start", "end", "token")
    # one row a token, channel and reading; tasks that met the same token made the same rows
    readings = materialize(cand.filter("ch IS NOT NULL").select("token", "ch", "alt", "said", "words", "bad").dropDuplicates(["token", "ch", "alt"]))
    often = materialize(places.groupBy("token").agg(F.count(F.lit(1)).alias("times")))
    doubted = readings.filter("bad").join(often, "token").select("times", F.explode("words").alias("x")).groupBy(F.col("x.w").alias("word")).agg(F.sum("times").alias("less"))
    counted = counts.filter("what = 'w'").select(F.col("x").alias("word"), "n").join(doubted, "word", "left").select("word", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).filter((F.col("n") > 0) & ~F.col("word").contains(LOST))
    counted = materialize(counted)
    n_words = counted.agg(F.sum("n").alias("n")).first().n or 1
    vlog, vfloor = math.log(n_words), math.log(0.5 / n_words)

    # lattice of whole words: each word's frequency, or that of the likeliest word that fits
    each = readings.select("token", "ch", "alt", F.posexplode("words").alias("at", "x")).select("token", "ch", "alt", "at", F.col("x.w").alias("word"), F.col("x.lp").alias("spelled"), F.col("x.pat").alias("pat"), F.col("x.keys").alias("keys"))
    hot = hot_keys(counted, "word", "n", n_words)
    whole = join_unique(each.filter("pat IS NULL"), counted, "word", hot, ["token", "ch", "alt"], how="left").select("token", "ch", "alt", "at", "spelled", "n", F.lit(None).cast("string").alias("fill"))
    torn = each.filter("pat IS NOT NULL").join(_fits(each, counted, sure), "pat", "left").select("token", "ch", "alt", "at", "spelled", "n", F.coalesce("fill", "word").alias("fill"))
    lp = F.when(F.col("n").isNotNull(), F.log("n") - vlog).otherwise(F.lit(vfloor) + F.col("spelled"))
    scored = whole.unionByName(torn).groupBy("token", "ch", "alt").agg(F.sum(lp).alias("lp"), F.array_sort(F.collect_list(F.when(F.col("fill").isNotNull(), F.struct("at", "fill")))).alias("fills"))
    # the best reading of each channel, by what it gains over the token as it stands
    of_token = W.partitionBy("token")
    best = scored.withColumn("gain", F.col("lp") - F.max(F.when(F.col("ch") == "", F.col("lp"))).over(of_token) - token_price).filter("gain > 0")
    gains = best.groupBy("token", "ch").agg(F.max("gain").alias("gain"), F.max_by(F.struct("alt", "fills"), F.struct("gain", -F.col("alt"))).alias("b")).select("token", "ch", "gain", "b.alt", "b.fills")
    nodes = gains.join(readings.select("token", "ch", "alt", "said"), ["token", "ch", "alt"]).groupBy("token").agg(F.collect_list(F.struct("ch", "gain", "said", "fills")).alias("nodes"))

    # a token that gains nothing on any channel has no part in the search: a channel goes on past it at no cost
    hot = hot_keys(often, "token", "times", cand.filter("ch IS NULL").count())
    found = join_unique(places, nodes, "token", hot, [key, "start"], how="left").filter(F.col("nodes").isNotNull() | F.col("token").contains(LOST))

    def read(tok: str, nodes) -> list:
        got = [(n["ch"], n["gain"], _filled(n["said"], n["fills"])) for n in (nodes if nodes is not None else [])]
        # a reading of lost letters that fills none says nothing
        return [x for x in got if x[0] in RANK or len(LOST_WORD.findall(x[2])) < len(LOST_WORD.findall(tok))]

    def search(batches):
        for pdf in batches:
            out = []
            for k, ps in zip(pdf[key], pdf["places"]):
                spans = viterbi([(p["start"], p["end"], p["token"], read(p["token"], p["nodes"])) for p in ps], start_price)
                if spans:
                    out.append((k, [{"start": s, "end": e, "channel": c, "restored": r} for s, e, c, r in spans]))
            yield pd.DataFrame(out, columns=[key, "spans"])

    # one group is the damaged-looking tokens of one document
    per_doc = found.groupBy(key).agg(F.collect_list(F.struct("start", "end", "token", "nodes")).alias("places"))
    return per_doc.mapInPandas(search, f"`{key}` {kt}, spans array<struct<start:int,end:int,channel:string,restored:string>>")


def _lattices(sent, key: str, text: str, unclean: float):
    """Two kinds of rows: a place (ch null) for each occurrence of a token with readings, and each token's readings, the first being itself (ch '')."""

    def words(t: str, classes: list[str], chars: Chars) -> list:
        out, it = [], iter(classes)
        for w in WORD.findall(t):
            lp, mine = chars.score(w), [next(it) for _ in range(w.count(LOST))] if classes else []
            keys, pat = masks(w, mine) if mine else (None, None)
            out.append({"w": w, "lp": lp, "pat": pat, "keys": keys})
        return out

    def readings(tok: str, blank: str, chars: Chars) -> list:
        fit, mine = list(candidates(tok, chars)), chars.score(tok)
        gains = [chars.score(t) - mine for _, t, _ in fit]
        fit = [(ch, t + blank, classes) for ch, t, classes in fit]
        if blank or tok[-1] in _LEADS and len(tok) > 1:
            mine += chars.score(" ")
            ends = [x for x in candidates(tok + NBSP, chars, _BLANK) if x[1][-1] != NBSP and chars.score(x[1]) > mine]
            gains += [chars.score(t) - mine for _, t, _ in ends]
            fit += ends
        if LOST in tok:
            fit += lost_candidates(tok)
        alts: Counter = Counter()
        out = [("", 0, tok + blank, words(tok, [], chars), max(gains, default=0.0) > unclean)] if fit else []
        for ch, t, classes in fit:
            # a lost character that is still there and open to nothing may be any letter
            out.append((ch, alts[ch], t, words(t, classes or [""] * t.count(LOST), chars), False))
            alts[ch] += 1
        return out

    def run(batches):
        chars = Chars(*sent.value)
        seen: dict[str, bool] = {}
        for pdf in batches:
            out, at = [], []
            for k, t in zip(pdf[key], pdf[text]):
                for m in TOKEN.finditer(t):
                    tok = m.group()
                    a, b = m.span()
                    # Two blanks: the first may have been a no-break space, the last byte of the character before it.
                    blank = " " if tok[-1] in _LEADS and t[b : b + 2].isspace() and t[b] == " " and b + 1 < len(t) else ""
                    some = seen.get(tok + blank)
                    if some is None:
                        got = readings(tok, blank, chars)
                        out += [(None, None, None, tok + blank, *g) for g in got]
                        if len(seen) > 50_000:
                            seen.clear()
                        some = seen[tok + blank] = bool(got)
                    if some or LOST in tok:
                        at.append((k, a, b + len(blank), tok + blank))
            df = pd.DataFrame(out, columns=[key, "start", "end", "token", "ch", "alt", "said", "words", "bad"])
            yield df.astype({"start": "Int32", "end": "Int32"})
            yield pd.DataFrame(at, columns=[key, "start", "end", "token"]).assign(ch=None, alt=pd.array([pd.NA] * len(at), "Int32"), said=None, words=None, bad=None)

    return run


# Channels in which a no-break space is a byte that may end a character, and the characters one of two bytes begins with.
_BLANK = [ch for ch in UTF8 if ch.blank]
_LEADS = frozenset(c for ch in _BLANK for c in ch.leads)


def _fits(each: DataFrame, counted: DataFrame, sure: float) -> DataFrame:
    """``(pat, n, fill)``: of each pattern the count of the likeliest corpus word that fits, and that word if it has the share ``sure``."""
    wanted = each.filter("pat IS NOT NULL").select("pat", F.explode("keys").alias("mask")).distinct()
    # Only keys of the kinds and lengths that are wanted are made of the corpus's words.
    words = counted.filter(F.octet_length("word") > F.char_length("word"))
    latin = F.col("word").rlike("[A-Za-z]")
    ascii_ = words.filter(latin).select("word", "n", F.concat(F.lit("a:"), F.regexp_replace("word", r"[^\x00-\x7f]+", LOST)).alias("mask"))
    ends = F.expr("flatten(transform(sequence(1, char_length(word) - 1), i -> array(concat('p:', char_length(word), ':', left(word, i)), concat('s:', char_length(word), ':', right(word, i)))))")
    other = words.filter(~latin & (F.char_length("word") > 1)).select("word", "n", F.explode(ends).alias("mask"))
    fit = ascii_.unionByName(other).join(wanted, "mask").filter(F.expr("rlike(word, concat('^(?:', pat, ')$'))"))
    got = fit.groupBy("pat").agg(F.max("n").alias("n"), F.sum("n").alias("all"), F.max_by("word", F.struct("n", "word")).alias("best"))
    return got.select("pat", "n", F.when(F.col("n") >= sure * F.col("all"), F.col("best")).alias("fill"))


def _filled(said: str, fills) -> str:
    """``said`` with the words of the numbers in ``fills`` replaced."""
    if fills is None or not len(fills):
        return said
    to = {int(f["at"]): f["fill"] for f in fills}
    at, out = 0, []
    for n, m in enumerate(WORD.finditer(said)):
        if n in to:
            out += [said[at : m.start()], to[n]]
            at = m.end()
    return "".join([*out, said[at:]])


def viterbi(places: list[tuple], start_price: float) -> list[tuple]:
    """The damaged spans (start, end, channel, restored) of the best path.

    places: (start, end, token, [(channel, gain over the token as it stands, restored)]). Where the path keeps a
    token that lost characters, its torn words come out as ``lost``, restored None.
    """
    rank = lambda x: (x[1][0], -RANK.get(x[0], -1 if x[0] == "" else len(RANK)))  # noqa: E731  # of equal paths the first channel
    # state: channel, '' for none -> (score, path)
    best: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    places = sorted({(a, b, t): ns for a, b, t, ns in places}.items())
    for (a, b, _), nodes in places:
        top = max(best.items(), key=rank)[1]
        # without a node for it here, a channel goes on with the token as it stands
        new = {ch: (s, path) for ch, (s, path) in best.items()} | {"": top}
        for ch, gain, said in nodes:
            stay = best.get(ch)
            s, path = max([(top[0] - start_price, top[1])] + ([stay] if stay else []), key=lambda x: x[0])
            if ch not in new or s + gain > new[ch][0]:
                new[ch] = (s + gain, ((a, b, ch, said), path))
        best = new
    path = max(best.items(), key=rank)[1][1]
    out = []
    while path:
        node, path = path
        out.append(node)
    done = {n[0] for n in out}
    for (a, _, t), _ in places:
        if a not in done:
            out += [(a + m.start(), a + m.end(), "lost", None) for m in LOST_WORD.finditer(t)]
    return sorted(out, key=lambda x: (x[0], x[1]))


def restore(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, channels, n_spans, n_unrestored, restored)``: the damaged texts with what could be restored put in.

    A span is unrestored while characters of it are lost or it holds what UTF-8 read as windows-1252 looks like.
    """
    kt = docs.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for k, t, ss in zip(pdf[key], pdf[text], pdf["spans"]):
                parts, at, missed = [], 0, 0
                for s in ss:
                    if s["start"] < at:
                        continue
                    said = t[s["start"] : s["end"]] if s["restored"] is None else s["restored"]
                    missed += LOST in said or UTF8[0].find.search(said) is not None
                    parts += [t[at : s["start"]], said]
                    at = s["end"]
                out.append((k, sorted({s["channel"] for s in ss}), len(ss), missed, "".join([*parts, t[at:]])))
            yield pd.DataFrame(out, columns=[key, "channels", "n_spans", "n_unrestored", "restored"])

    return docs.select(key, text).join(spans, key).mapInPandas(run, f"`{key}` {kt}, channels array<string>, n_spans int, n_unrestored int, restored string")
