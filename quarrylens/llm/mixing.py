"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time, 0 to 1. Its integral is the source's cumulative token
demand; inverting it turns the place of a document within its source, counted in tokens, into the document's
training position. The mix is range-sorted by that position.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.session import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, keep: list[str], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` and ``n_tokens`` of the whole text, by a public vocabulary that is a file on every executor."""

    def run(batches):
        enc = _encoding(tokenizer)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf[text]]
            yield pdf[keep].assign(n_tokens=pd.Series(n, dtype="int64"))

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"
    return spread(df.select(*keep, text)).mapInPandas(run, schema)


def plan(targets: list[tuple[str, float, int]], available: dict[str, int], budget: int | None = None) -> dict[str, float]:
    """source -> tokens to take: in proportion to the target shares, none above its cap.

    Without ``budget`` the mix is the largest in which every source that has tokens reaches its share (shares
    of sources without tokens are spread over the others in proportion). With one, a source whose share
    exceeds its cap gives all the cap allows and the others share the rest, so that their proportions hold.
    """
    cap = {s: max(m or 0, 0) * available.get(s, 0) for s, _, m in targets}
    share = {s: w for s, w, _ in targets if w and w > 0 and cap[s] > 0}
    total = sum(share.values())
    if not share:
        return {}
    if budget is None:
        size = min(cap[s] * total / w for s, w in share.items())
        return {s: min(cap[s], size * w / total) for s, w in share.items()}
    take: dict[str, float] = {}
    free, left = dict(share), float(budget)
    while free:
        total = sum(free.values())
        full = [s for s, w in free.items() if left * w / total >= cap[s]]
        if not full:
            take |= {s: left * w / total for s, w in free.items()}
            break
        for s in full:
            take[s] = cap[s]
            left -= cap[s]
            del free[s]
    return take


def ramps(targets: list[tuple[str, float, int]], tilt: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """The default curriculum: knots (time, weight) of each source, weights of integral 1.

    Sources that may be repeated more often, the scarce ones, grow linearly towards the end, the others
    shrink, by ``tilt`` of their weight at most; at every time the shares still add up to one.
    """
    total = sum(w for _, w, _ in targets) or 1
    mean = sum(w * (m or 0) for _, w, m in targets) / total
    most = max((abs((m or 0) - mean) for _, _, m in targets), default=0) or 1
    return {s: [(0.0, 1 - tilt * ((m or 0) - mean) / most), (1.0, 1 + tilt * ((m or 0) - mean) / most)] for s, _, m in targets}


def _segments(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(integral before, time, weight, slope) of each piece, scaled to an integral of 1 over time 0 to 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    if area <= 0 or any(w < 0 for _, w in knots) or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule needs knots from 0 to 1 and weights of 0 or more, some above 0")
    out, c = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 > t0:
            out.append((c, t0, w0 / area, (w1 - w0) / area / (t1 - t0)))
            c += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, schedules: dict[str, list[tuple[float, float]]] | None = None, seed: int = 7, tokenizer: str = TOKENIZER, max_sources: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``mix(position, doc_id, source, copy, n_tokens)``: the documents in training order, ``position`` from 0
    to 1, ``copy`` from 0. A source is used in whole passes in a seeded order and a last, partial one; a
    document is in if its middle lies before the source's demand, so a share is met to within one document.
    ``report``: each source of ``targets`` and, with null target, each other source: target and actual
    share, tokens available and used, documents used, most copies of one, and whether the cap stopped it.

    Null texts and documents of sources without target are left out; empty texts are documents of no tokens.
    Rows repeated under one doc_id are each used. Repeated sources in ``targets`` are an error.
    ``targets`` is read by the driver; its length is checked against ``max_sources``.
    """
    spark = docs.sparkSession
    want = [(r.source, r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").limit(max_sources + 1).collect() if r.source is not None]
    if len(want) > max_sources or len({s for s, _, _ in want}) < len(want):
        raise ValueError("targets: too many or repeated sources")
    sized = count_tokens(docs.filter(F.col("text").isNotNull()), ["doc_id", "source"], "text", tokenizer)
    sized = materialize(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
    names = spark.createDataFrame([(s,) for s, _, _ in want], "source string")
    # Each source in ranges of the hash order, so that no source is summed up in one task.
    n = sized.count()
    bits = min(20, max(0, math.ceil(math.log2(max(n, 1) / 10_000)) + 1)) if n > 10_000 else 0
    slot = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")
    listed = sized.join(F.broadcast(names), "source", "left_semi").withColumn("slot", slot)
    held = listed.groupBy("source", "slot").agg(F.sum("n_tokens").alias("held"))
    per = W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("held").over(per), F.lit(0)))
    # one row a source of targets, whose number was checked
    available = {r.source: r.n for r in held.groupBy("source").agg(F.sum("held").alias("n")).collect()}
    take = {s: x for s, x in plan(want, available, budget).items() if x > 0}
    curves = ramps(want) | (schedules or {})
    rows = [(s, float(x), int(available[s]), [dict(zip("ctwa", seg)) for seg in _segments(curves[s])]) for s, x in take.items()]
    demand = spark.createDataFrame(rows, "source string, demand double, available bigint, segs array<struct<c:double,t:double,w:double,a:double>>")
    run = W.partitionBy("source", "slot").orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = listed.join(held.select("source", "slot", "before"), ["source", "slot"]).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    passes = placed.join(F.broadcast(demand), "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("demand") / F.col("available")).cast("int") - 1, F.lit(0)))))
    middle = F.col("copy") * F.col("available") + F.col("at") + F.col("n_tokens") / 2
    used = passes.withColumn("u", middle / F.col("demand")).filter("u <= 1").withColumn("seg", F.expr("element_at(filter(segs, s -> s.c <= u), -1)"))
    r = F.col("u") - F.col("seg.c")
    root = F.sqrt(F.greatest(F.col("seg.w") * F.col("seg.w") + 2 * F.col("seg.a") * r, F.lit(0.0)))
    position = F.col("seg.t") + F.when(F.col("seg.w") + root > 0, 2 * r / (F.col("seg.w") + root)).otherwise(F.lit(0.0))
    out = used.select(F.least(position, F.lit(1.0)).alias("position"), "doc_id", "source", "copy", "n_tokens")
    ordered = out.repartitionByRange("position", "source", "doc_id", "copy").sortWithinPartitions("position", "source", "doc_id", "copy")

    got = out.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count(F.lit(1)).alias("documents_used"), (F.max("copy") + 1).alias("most_copies"))
    all_held = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"))
    goal = spark.createDataFrame([(s, float(w) if w is not None else None, m, bool(take.get(s, 0) >= (m or 0) * available.get(s, 0))) for s, w, m in want], "source string, target_share double, max_repeats int, capped boolean")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = goal.join(all_held, "source", "full").join(got, "source", "left")
    report = report.select("source", "target_share", "max_repeats", zero("tokens_available"), zero("tokens_used"), zero("documents_used"), zero("most_copies"), F.coalesce("capped", F.lit(False)).alias("capped"))
    # the report has a row a source, so its total is no large window
    total = F.sum("tokens_used").over(W.partitionBy(F.lit(0)))
    return ordered, report.withColumn("actual_share", F.when(total > 0, F.col("tokens_used") / total).otherwise(F.lit(0.0)))
