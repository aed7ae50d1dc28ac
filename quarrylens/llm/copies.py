"""Copies hidden by formatting: Merkle digests of normalised records, grouped and confirmed.

A record's content is the sequence of its letters and digits, case folded. If it is one JSON object it has a
tree digest as well: leaves are normalised raw lexemes, the children of an object are sorted by digest, those
of an array keep their order. Records are the same if either digest is, directly or over others.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.grammars.json import lexemes
from quarrylens.llm.lalr import ParseError, parse
from quarrylens.llm.syntax import tables
from quarrylens.operators.skew import hot_keys, join_unique
from quarrylens.session import materialize, spread

_OTHER = re.compile(r"[\W_]+")


def flat(text: str) -> str:
    """The letters and digits, case folded."""
    return _OTHER.sub("", text.casefold())


def _h(*parts: bytes) -> bytes:
    d = hashlib.blake2b(digest_size=16)
    for p in parts:
        d.update(len(p).to_bytes(4, "big"))
        d.update(p)
    return d.digest()


# A node is (digest, canonical form), the form being the whole content in canonical order.
def _node(tag: str, kids: list) -> tuple[bytes, str]:
    return _h(tag.encode(), *(k[0] for k in kids)), tag + "".join(f"<{k[1]}>" for k in kids)


def _leaf(raw: str) -> tuple[bytes, str]:
    f = flat(raw)
    return _h(b"leaf", f.encode("utf-8", "surrogatepass")), f


def merkle(text: str) -> tuple[bytes, str] | None:
    """(root digest, canonical form) of a text that is one strict JSON object, else None."""
    s = text.strip(" \t\n\r")
    if not (s.startswith("{") and s.endswith("}")):
        return None
    try:
        parse(tables("json"), lexemes(s), {})
        return _build(s)
    except ParseError:
        return None


def _build(s: str) -> tuple[bytes, str]:
    stack: list[tuple[str, list]] = []
    pending: list = []  # names of fields whose value is still to come
    for kind, _, raw in lexemes(s):
        if kind in "{[":
            stack.append((kind, []))
            continue
        if kind in (",", ":"):
            continue
        if kind == "$end":
            break
        if kind in "}]":
            tag, kids = stack.pop()
            node = _node(tag, sorted(kids) if tag == "{" else kids)
        else:
            node = _leaf(raw)
        if not stack:
            return node
        tag, kids = stack[-1]
        if tag == "[":
            kids.append(node)
        elif pending and pending[-1][0] == len(stack):
            name = pending.pop()[1]
            kids.append(_node(":", [name, node]))
        else:
            pending.append((len(stack), node))
    raise ParseError(0, "no object")


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, flat_digest, tree_digest)``; tree_digest is null where the text is not one JSON object. Null texts give no row."""
    kt = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            f = [_h(flat(t).encode("utf-8", "surrogatepass")) for t in pdf[text]]
            m = [merkle(t) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "flat_digest": f, "tree_digest": [x and x[0] for x in m]})

    return spread(df.filter(F.col(text).isNotNull()).select(key, text)).mapInPandas(run, f"`{key}` {kt}, flat_digest binary, tree_digest binary")


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` of every node that is not the least of its component, from edges ``(u, v)`` of distinct nodes.

    Large stars and small stars in turn (Kiveris et al. 2014): each node's neighbours move over to the least of them,
    so that rounds grow with the logarithm of a component's size and no component is gathered.
    """
    ends = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    edges = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, now = None, ends(edges)
    while before != now:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * now[0]).withColumn("m", F.least("u", "m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _with_least(large, now[0])
        edges = materialize(least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())
        before, now = now, ends(edges)
    return edges.select("u", F.col("v").alias("root"))


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` with ``m``, the least neighbour of u. A node with a large part of the edges is split over parts."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    # below the least size of a hot key none can be one
    hot = [bytes(x) for x in hot_keys(least, "u", "n", n)] if n > 10_000 else []
    return join_unique(edges, least.drop("n"), "u", hot, ["v"])


def copies(df: DataFrame, key: str = "record_id", text: str = "generated_code", hot_share: float = 0.005, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """The distinct contents and the further copies of each.

    ``distinct(key, n_copies)``: of each content the smallest key and the number of its records.
    ``pairs(first_id, copy_id)``: of each content with two or more, each further record. Null texts belong to
    neither; texts without letters and digits are one content. Repeated rows count once; a key repeated with
    another content is a record of each.

    Both results come from records confirmed on whole texts: those under one digest of letters and digits hold the
    same letters and digits, and those under one digest of trees the same canonical tree, so that contents
    linked over third records are confirmed link by link. The query fails rather than give a collision of 128 bits.

    Only records with copies have their texts read again. Digests above ``hot_share`` of all records, at most
    1 / hot_share of them, are split over ``salts`` parts, each with the first text; every other step pre-aggregates.
    """
    d = materialize(digests(df, key, text).distinct())
    flats = d.groupBy("flat_digest").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("head"))
    # Trees that several texts share link these; one record stands for each text of such a tree.
    trees = d.filter(F.col("tree_digest").isNotNull()).groupBy("tree_digest", "flat_digest").agg(F.min(key).alias(key))
    per_tree = trees.groupBy("tree_digest").agg(F.min("flat_digest").alias("m"), F.min_by(key, F.struct("flat_digest", key)).alias("first_key"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    many_texts = [bytes(x) for x in hot_keys(per_tree, "tree_digest", "texts", d.count(), hot_share)]
    trees = materialize(join_unique(trees, per_tree, "tree_digest", many_texts, ["flat_digest"], salts))
    roots = components(trees.select(F.col("flat_digest").alias("u"), F.col("m").alias("v"))).withColumnRenamed("u", "flat_digest")
    flats = materialize(flats.join(roots, "flat_digest", "left").withColumn("class", F.coalesce("root", "flat_digest")).drop("root"))
    groups = flats.groupBy("class").agg(F.sum("n").alias("n_all"), F.min("head").alias("first_id"))
    many = materialize(flats.join(groups.filter("n_all > 1"), "class").select("flat_digest", "n", "head", "first_id"))

    hot = [bytes(x) for x in hot_keys(many, "flat_digest", "n", d.count(), hot_share)]
    same = join_unique(d.select(key, "flat_digest"), many.filter("n > 1"), "flat_digest", hot, [key], salts)
    same = same.select(key, F.lit("flat").alias("kind"), F.col("flat_digest").alias("digest"), (F.col(key) == F.col("head")).alias("head"), "first_id", F.lit(True).alias("emit"))
    linked = trees.join(many.select("flat_digest", "n", "first_id"), "flat_digest")
    linked = linked.select(key, F.lit("tree").alias("kind"), F.col("tree_digest").alias("digest"), (F.col(key) == F.col("first_key")).alias("head"), "first_id", (F.col("n") == 1).alias("emit"))
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    # The first text of a hot digest goes to all parts, and comes out of one.
    parts = F.when(~is_hot, F.array(F.lit(0))).when(F.col("head"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")))
    todo = same.unionByName(linked).withColumn("part", F.explode(parts)).withColumn("emit", F.col("emit") & (~F.col("head") | (F.col("part") == 0)))
    at = ["kind", "digest", "part"]
    read = df.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__text")).join(todo, key)
    read = read.repartition(*at).sortWithinPartitions(*at, F.col("head").desc(), key)

    def check(batches):
        group, first = None, None
        for pdf in batches:
            out = []
            for k, kind, digest, part, f, emit, t in zip(pdf[key], pdf.kind, pdf.digest, pdf.part, pdf.first_id, pdf.emit, pdf.__text):
                if kind == "flat":
                    form = flat(t)
                    mine = _h(form.encode("utf-8", "surrogatepass"))
                else:
                    mine, form = merkle(t) or (None, None)
                if mine != bytes(digest):
                    continue  # another text of a repeated key
                if group != (kind, digest, part):
                    group, first = (kind, digest, part), form
                if form != first:
                    raise ValueError(f"digest collision in the group of {f}: {k}")
                if emit:
                    out.append((f, k))
            yield pd.DataFrame(out, columns=["first_id", "copy_id"])

    kt = df.schema[key].dataType.simpleString()
    confirmed = read.select(key, *at, "first_id", "emit", "__text").mapInPandas(check, f"first_id {kt}, copy_id {kt}").distinct()
    alone = groups.filter("n_all = 1").select(F.col("first_id").alias(key), F.lit(1).cast("long").alias("n_copies"))
    distinct = alone.unionByName(confirmed.groupBy(F.col("first_id").alias(key)).agg(F.count(F.lit(1)).alias("n_copies")))
    return distinct, confirmed.filter("first_id <> copy_id")
