"""Rank metrics without cross joins: ROC, thresholds, retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.operators.cumulative import cumulative


def _scores(df: DataFrame, score: str, positive: str) -> DataFrame:
    pos = F.coalesce(F.col(positive), F.lit(False)).cast("long")
    got = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    return cumulative(got, [], "score", ["pos", "neg"])


def roc_auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """``(n_pos, n_neg, auc)``: the share of pairs in order, ties half; 0 where a side is empty. Null scores are left out, a null label is negative."""
    got = _scores(df, score, positive).agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
        F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2)).alias("won"),
    )
    both = F.col("n_pos").cast("double") * F.col("n_neg")
    return got.select("n_pos", "n_neg", F.when(both > 0, F.col("won") / F.when(both > 0, both)).otherwise(F.lit(0.0)).alias("auc"))


def tpr_at_fpr(df: DataFrame, score: str, positive: str, target: float) -> DataFrame:
    """``(tpr)``: the best share of positives with score >= t over thresholds t whose false positive share is within target."""
    s = _scores(df, score, positive)
    tpr = (F.col("total_pos") - F.col("before_pos")) / F.when(F.col("total_pos") > 0, F.col("total_pos"))
    fpr = (F.col("total_neg") - F.col("before_neg")) / F.when(F.col("total_neg") > 0, F.col("total_neg"))
    ok = (F.col("total_pos") > 0) & (F.col("total_neg") > 0) & (fpr <= target)
    return s.agg(F.coalesce(F.max(F.when(ok, tpr)), F.lit(0.0)).alias("tpr"))


def best_f1(df: DataFrame, score: str, positive: str, lo: float, hi: float, steps: int = 100, eps: float = 1e-8) -> DataFrame:
    """``(threshold, precision, recall, f1)``: the best of evenly spaced thresholds, the first of equal ones.

    Scores fall into the gaps between thresholds first, so every row is looked at once.
    """
    width = (hi - lo) / (steps - 1)
    inside = F.least(F.greatest((F.col(score) - F.lit(lo)) / F.lit(width) + F.lit(1e-9), F.lit(-1.0)), F.lit(steps - 1.0))
    slot = F.floor(inside).cast("int")
    pos = F.coalesce(F.col(positive), F.lit(False)).cast("long")
    g = df.filter(F.col(score).isNotNull()).groupBy(slot.alias("slot")).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    # steps + 1 rows from here on: slot -1 holds what no threshold lets through
    t = df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("slot"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = W.partitionBy(F.lit(0))
    down = all_.orderBy(F.desc("slot"))
    tall = t.join(g, "slot", "left").select(F.col("slot").alias("i"), zero(F.sum("pos").over(down)).alias("tp"), zero(F.sum("neg").over(down)).alias("fp"), zero(F.sum("pos").over(all_)).alias("p")).filter("i >= 0")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + eps), F.col("tp") / (F.col("p") + eps)
    tall = tall.select("i", (F.lit(lo) + F.col("i") * F.lit(width)).alias("threshold"), precision.alias("precision"), recall.alias("recall")).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))
    return tall.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("i"))).alias("b")).select("b.*")


def retrieval_ranks(queries: DataFrame, candidates: DataFrame, key: str, vec: str, truth: str, part_rows: int = 50_000, block: int = 4096, most_queries: int = 1_000_000) -> DataFrame:
    """``(key, truth, similarity, rank)``: the rank of each query's true candidate among all, by cosine; ties do not hurt.

    ``queries`` has key, vec and truth, the key of its candidate; ``candidates`` has key and vec. A stated query
    set against all rows: queries go out in parts of about ``part_rows``, each a pass over the candidates in
    which blocks of queries meet Arrow batches in matrix products; nothing is shuffled but one count a query.
    Queries whose candidate is missing, and null vectors, give no row. More than ``most_queries`` are an error,
    since a part at a time stands on the driver and every part is a pass.
    """
    queries = queries.select(key, truth, vec).filter(F.col(vec).isNotNull())
    candidates = candidates.select(key, vec).filter(F.col(vec).isNotNull())
    n = queries.count()
    if n > most_queries:
        raise ValueError(f"{n} queries; raise most_queries, each {part_rows} of which take a pass over the candidates")
    parts = max(1, -(-n // part_rows))
    out = None
    for p in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p).collect()
        got = _ranks(rows, candidates, key, vec, truth, block)
        out = got if out is None else out.unionByName(got)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _ranks(rows: list, candidates: DataFrame, key: str, vec: str, truth: str, block: int) -> DataFrame:
    spark = candidates.sparkSession
    kt = candidates.schema[key].dataType.simpleString()
    own_schema = f"`{key}` {kt}, `{truth}` {kt}, similarity double"
    if not rows:
        return spark.createDataFrame([], own_schema + ", rank bigint")
    sent = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], _unit(np.array([r[2] for r in rows], dtype=np.float64))))

    def own(batches):
        qk, tk, q = sent.value
        at: dict = {}
        for i, t in enumerate(tk):
            at.setdefault(t, []).append(i)
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf[vec]):
                for i in at.get(k, ()):
                    c = np.asarray(v, dtype=np.float64)
                    out.append((qk[i], tk[i], float(q[i] @ c / max(np.linalg.norm(c), 1e-300))))
            yield pd.DataFrame(out, columns=[key, truth, "similarity"])

    sims = candidates.mapInPandas(own, own_schema).collect()
    mine = {r[0]: r[2] for r in sims}
    base = spark.sparkContext.broadcast(np.array([mine.get(r[0], np.nan) for r in rows]))

    def count(batches):
        qk, _, q = sent.value
        above = np.zeros(len(qk), dtype=np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            c = _unit(np.stack(pdf[vec].to_numpy()).astype(np.float64))
            for a in range(0, len(qk), block):
                above[a : a + block] += (q[a : a + block] @ c.T > base.value[a : a + block, None] + 1e-12).sum(axis=1)
        yield pd.DataFrame({key: qk, "above": above})

    ranks = candidates.mapInPandas(count, f"`{key}` {kt}, above bigint").groupBy(key).agg((F.sum("above") + 1).alias("rank"))
    return spark.createDataFrame([tuple(r) for r in sims], own_schema).join(ranks, key)
