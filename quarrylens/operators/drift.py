"""Schemas that drift between files: a catalogue of column lifespans, the changes, and one table of it all.

Two passes over the lines. The first writes each file's footer, the paths it holds and their JSON types,
combined within each Arrow batch, so that its shuffle follows the number of fields and files and not of
records. The catalogue (lag and islands over the files of a stream) and the candidates for a rename come
from footers alone. The second pass reads values, but only of files and paths that are candidates.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylens.session import materialize


def _strict(_: str):
    raise ValueError("no JSON constant")


def parse_object(line: str | None) -> dict | None:
    """The line's JSON object, or None where the line is not one (strict JSON)."""
    if line is None:
        return None
    try:
        o = json.loads(line, parse_constant=_strict)
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def kind(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else ""


def walk(o: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of all fields; fields of objects inside an array as ``array[].field``."""
    for k, v in o.items():
        path = prefix + k
        yield path, v
        if isinstance(v, dict):
            yield from walk(v, path + ".")
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, dict):
                    yield from walk(x, path + "[].")


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")


def wrapped(v) -> bool:
    """Is the value an object that says one plain value: {value: x}, and other fields only with the same text."""
    if not isinstance(v, dict) or isinstance(v.get("value"), (dict, list, type(None))):
        return False
    said = v["value"] if isinstance(v["value"], str) else json.dumps(v["value"])
    return all(x == said or x == v["value"] for x in v.values())


def shape(v) -> str:
    """What a value can be cast from: its type, texts of numbers and booleans and 0 and 1 being told apart; ``[x]`` for an array of one plain x."""
    if wrapped(v):
        return shape(v["value"])
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return "bit" if v in (0, 1) and isinstance(v, int) else "number"
    if isinstance(v, str):
        return "truth" if v in ("true", "false") else "digits" if _NUMBER.fullmatch(v) else "string"
    if isinstance(v, list) and len(v) == 1 and not isinstance(v[0], (dict, list, type(None))):
        return f"[{shape(v[0])}]"
    return kind(v)


def plain_walk(o: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(path, value) of all fields outside arrays, objects that say one plain value taken as that value."""
    for k, v in o.items():
        if isinstance(v, dict) and not wrapped(v):
            yield from plain_walk(v, prefix + k + ".")
        else:
            yield prefix + k, v["value"] if isinstance(v, dict) else v


def values(o: dict) -> dict[str, object]:
    """path -> value; a path inside an array holds the list of its elements' values, with their places."""
    out: dict[str, object] = {}

    def visit(d: dict, prefix: str, place: tuple | None) -> None:
        for k, v in d.items():
            path = prefix + k
            if place is None:
                out[path] = v
            else:
                out.setdefault(path, []).append([list(place), v])
            if isinstance(v, dict):
                visit(v, path + ".", place)
            elif isinstance(v, list):
                for i, x in enumerate(v):
                    if isinstance(x, dict):
                        visit(x, path + "[].", (place or ()) + (i,))

    visit(o, "", None)
    return out


def _canonical(v) -> str:
    def plain(x):
        if isinstance(x, float) and x.is_integer():
            return int(x)
        if isinstance(x, dict):
            return {k: plain(y) for k, y in x.items()}
        return [plain(y) for y in x] if isinstance(x, list) else x

    return json.dumps(plain(v), sort_keys=True, ensure_ascii=False)


def _digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def footers(lines: DataFrame, file_cols: list[str], line_col: str, shapes: bool = False) -> DataFrame:
    """``(file_cols..., path, kinds)``: each file's paths and the JSON types of their non-null values, '' for the file itself.

    With ``shapes`` also what the values of each path outside arrays can be cast from.
    """

    def run(batches):
        for pdf in batches:
            seen = set()
            for row in pdf.itertuples(index=False, name=None):
                file = row[:-1]
                seen.add((*file, "", "", ""))
                o = parse_object(row[-1])
                if o is not None:
                    for path, v in walk(o):
                        seen.add((*file, path, kind(v), ""))
                    for path, v in plain_walk(o) if shapes else ():
                        seen.add((*file, path, "", shape(v)))
            yield pd.DataFrame(list(seen), columns=[*file_cols, "path", "kind", "shape"])

    schema = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in file_cols) + ", path string, kind string, shape string"
    got = lines.select(*file_cols, line_col).mapInPandas(run, schema)
    sets = {"kinds": "kind"} | ({"shapes": "shape"} if shapes else {})
    return got.groupBy(*file_cols, "path").agg(*[F.array_sort(F.array_remove(F.collect_set(c), "")).alias(n) for n, c in sets.items()])


def lifespans(foot: DataFrame, stream: list[str], file: str, stamp: str) -> tuple[DataFrame, DataFrame]:
    """The files of each stream in order, and each path's lifespans.

    Returns ``files(stream..., file, seq, n_files)`` and ``spans(stream..., path, kinds, first_seq, last_seq,
    before, after)``: the islands of files in which a path exists with one set of types; ``before`` and
    ``after`` are the types in the adjacent files, null where the path is absent there.
    """
    files = foot.filter(F.col("path") == "").select(*stream, file, stamp).distinct()
    by = W.partitionBy(*stream)
    files = files.withColumn("seq", F.row_number().over(by.orderBy(F.col(stamp).asc_nulls_first(), file))).withColumn("n_files", F.count(F.lit(1)).over(by))
    at = foot.filter(F.col("path") != "").alias("f").join(files.alias("o"), [F.col(f"f.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*stream, file]]).select("f.*", "o.seq", "o.n_files")
    p = W.partitionBy(*stream, "path").orderBy("seq")
    at = at.withColumn("p_seq", F.lag("seq").over(p)).withColumn("p_kinds", F.lag("kinds").over(p))
    at = at.withColumn("starts", (F.coalesce(F.col("p_seq"), F.lit(-1)) != F.col("seq") - 1) | ~F.col("kinds").eqNullSafe(F.col("p_kinds")))
    at = at.withColumn("island", F.sum(F.col("starts").cast("int")).over(p))
    spans = at.groupBy(*stream, "path", "island").agg(F.first("kinds").alias("kinds"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("n_files").alias("n_files"))
    q = W.partitionBy(*stream, "path").orderBy("first_seq")
    spans = spans.withColumn("before", F.when(F.lag("last_seq").over(q) == F.col("first_seq") - 1, F.lag("kinds").over(q))).withColumn("after", F.when(F.lead("first_seq").over(q) == F.col("last_seq") + 1, F.lead("kinds").over(q)))
    return files, spans.drop("island")


def _match(old: dict[str, set], new: dict[str, set]) -> dict[str, str]:
    """new path -> old path. old, new: fingerprints of the vanished and the new paths.

    Parents first; the fields of a renamed object or array follow it under their own names. Of several
    equal partners the one with the same last name wins, then the same parent, then the first by name.
    """
    out: dict[str, str] = {}
    left = set(old)

    def leaf(p: str) -> str:
        return p.rpartition(".")[2]

    def under(p: str, parent: str) -> str | None:
        for sep in (".", "[]."):
            if p.startswith(parent + sep):
                return p[len(parent) :]
        return None

    by_print: dict[object, list[str]] = {}
    for o, f in old.items():
        by_print.setdefault(f, []).append(o)
    for n in sorted(new, key=lambda p: (p.count("."), p)):
        if n in out:
            continue
        cands = [o for o in by_print.get(new[n], []) if o in left]
        if not cands:
            continue
        o = min(cands, key=lambda o: (leaf(o) != leaf(n), o.rpartition(".")[0] != n.rpartition(".")[0], o))
        out[n] = o
        left.discard(o)
        for c in new:
            rest = under(c, n)
            if rest is not None and o + rest in left:
                out[c] = o + rest
                left.discard(o + rest)
    return out


def changes(lines: DataFrame, stream: list[str] | None = None, file: str = "file_name", stamp: str = "file_stamp", line_no: str = "line_no", line: str = "raw_line", id_field: str = "id") -> DataFrame:
    """``(stream..., file, change, field_path, old_path)`` of each file against the one before it in its stream.

    Files are ordered by ``stamp``, then name. Lines that are no JSON object count for nothing, but a file
    of only such lines still stands in its stream. ``change`` is added, removed, type_changed or renamed.
    A rename needs a record that both files have (by ``id_field``, the first of repeated ones counting) and
    in which the path exists; null values count as values. Empty input gives no row.
    """
    stream = stream or ["artifact", "stream"]
    file_cols = [*stream, file, stamp]
    # A row a field and file, read by several branches below: kept, so that the lines are parsed once for it.
    files, spans = (materialize(t) for t in lifespans(materialize(footers(lines, file_cols, line)), stream, file, stamp))
    on = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    begun = spans.filter(F.col("before").isNull() & (F.col("first_seq") > 1)).select(*stream, F.col("first_seq").alias("seq"), F.lit("added").alias("change"), F.col("path").alias("field_path"))
    ended = spans.filter(F.col("after").isNull() & (F.col("last_seq") < F.col("n_files"))).select(*stream, (F.col("last_seq") + 1).alias("seq"), F.lit("removed").alias("change"), F.col("path").alias("field_path"))
    retyped = spans.filter(F.col("before").isNotNull() & (F.size("before") > 0) & (F.size("kinds") > 0)).select(*stream, F.col("first_seq").alias("seq"), F.lit("type_changed").alias("change"), F.col("path").alias("field_path"))
    moved = begun.unionByName(ended)

    # Candidates for a rename: pairs of files with vanished and new paths.
    cand = moved.groupBy(*stream, "seq").agg(F.collect_list(F.when(F.col("change") == "removed", F.col("field_path"))).alias("old"), F.collect_list(F.when(F.col("change") == "added", F.col("field_path"))).alias("new")).filter((F.size("old") > 0) & (F.size("new") > 0))
    roles = cand.select(*stream, F.col("seq").alias("pair"), F.explode(F.array(F.struct((F.col("seq") - 1).alias("seq"), F.lit(0).alias("side"), F.col("old").alias("paths")), F.struct(F.col("seq").alias("seq"), F.lit(1).alias("side"), F.col("new").alias("paths")))).alias("r")).select(*stream, "pair", "r.*")
    jobs = roles.alias("r").join(files.alias("f"), on("r", "f", [*stream, "seq"])).select(*[f"f.{c}" for c in [*stream, file]], F.struct("r.pair", "r.side", "r.paths").alias("job"))
    jobs = jobs.groupBy(*stream, file).agg(F.collect_list("job").alias("jobs"))
    wanted = lines.alias("l").join(jobs.alias("j"), on("l", "j", [*stream, file])).select(*[f"l.{c}" for c in [*stream, line_no, line]], "j.jobs")

    def read(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                *key, no, raw, todo = row
                o = parse_object(raw)
                if o is None or o.get(id_field) is None:
                    continue
                rid, vals = _canonical(o[id_field]), values(o)
                for job in todo:
                    have = [{"path": p, "v": _digest(_canonical(vals[p]))} for p in job["paths"] if p in vals]
                    out.append((*key, int(job["pair"]), rid, int(job["side"]), no, have))
            yield pd.DataFrame(out, columns=[*stream, "pair", "rid", "side", "no", "have"])

    types = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in stream)
    got = wanted.mapInPandas(read, f"{types}, pair int, rid string, side int, no {lines.schema[line_no].dataType.simpleString()}, have array<struct<path:string,v:bigint>>")
    first = lambda s: F.min_by(F.when(F.col("side") == s, F.col("have")), F.when(F.col("side") == s, F.coalesce("no", F.lit(0))))
    shared = got.groupBy(*stream, "pair", "rid").agg(first(0).alias("a"), first(1).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    each = shared.select(*stream, "pair", "rid", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("have")), F.struct(F.lit(1).alias("side"), F.col("b").alias("have")))).alias("s")).select(*stream, "pair", "rid", "s.side", F.explode("s.have").alias("h"))
    prints = each.groupBy(*stream, "pair", "side", F.col("h.path").alias("path")).agg(F.concat_ws(":", F.count(F.lit(1)), F.expr("bit_xor(xxhash64(rid, h.v))"), F.expr("bit_xor(xxhash64(h.v, rid, 7))")).alias("print"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        old = dict(zip(pdf.path[pdf.side == 0], pdf.print[pdf.side == 0]))
        new = dict(zip(pdf.path[pdf.side == 1], pdf.print[pdf.side == 1]))
        key = [pdf[c].iloc[0] for c in [*stream, "pair"]]
        return pd.DataFrame([(*key, n, o) for n, o in _match(old, new).items()], columns=[*stream, "seq", "field_path", "old_path"])

    # One group is the changed fields of one file: bounded by the width of a schema.
    renamed = materialize(prints.groupBy(*stream, "pair").applyInPandas(match, f"{types}, seq int, field_path string, old_path string"))
    key = [*stream, "seq"]
    gone = renamed.select(*key, F.lit("removed").alias("change"), F.col("old_path").alias("field_path")).unionByName(renamed.select(*key, F.lit("added").alias("change"), "field_path"))
    plain = moved.alias("m").join(gone.alias("g"), on("m", "g", [*key, "change", "field_path"]), "left_anti")
    log = plain.unionByName(retyped).withColumn("old_path", F.lit("")).unionByName(renamed.withColumn("change", F.lit("renamed")))
    return log.alias("c").join(files.alias("f"), on("c", "f", key)).select(*[f"c.{c}" for c in stream], f"f.{file}", "c.change", "c.field_path", "c.old_path")


def catalogue(lines: DataFrame, stream: list[str] | None = None, file: str = "file_name", stamp: str = "file_stamp", line: str = "raw_line") -> DataFrame:
    """Each path's lifespans: ``(stream..., path, kinds, first_seq, last_seq, n_files)``, kinds joined by '|'."""
    stream = stream or ["artifact", "stream"]
    _, spans = lifespans(footers(lines, [*stream, file, stamp], line), stream, file, stamp)
    return spans.select(*stream, "path", F.concat_ws("|", "kinds").alias("kinds"), "first_seq", "last_seq", "n_files")


def _chains(lives: list[tuple[str, int, int]], renames: list[tuple[str, str, int]]) -> list[tuple[str, int, int, list[str]]]:
    """(path, first, last, chain) of each life of a path within one stream; chain is the names its field had, in order of time.

    lives: (path, first file, last file); renames: (old, new, file that has the new name). A life under a
    renamed object that has no rename of its own takes the object's chain with its own rest of the path.
    """
    begins = {(p, a): (p, a, b) for p, a, b in lives}
    ends = {(p, b): (p, a, b) for p, a, b in lives}
    after = {ends[o, s - 1]: begins[n, s] for o, n, s in renames if (o, s - 1) in ends and (n, s) in begins}
    own: dict[tuple, list[str]] = {}
    for head in set(after) - set(after.values()):
        chain = [head]
        while chain[-1] in after:
            chain.append(after[chain[-1]])
        own |= {x: [p for p, _, _ in chain] for x in chain}
    linked: dict[str, list[tuple]] = {}
    for x in own:
        linked.setdefault(x[0], []).append(x)
    out = []
    for x in lives:
        names, parent = own.get(x), x[0]
        while names is None and "." in parent:
            parent = parent.rpartition(".")[0]
            over = [y for y in linked.get(parent, []) if y[1] <= x[1] and x[2] <= y[2]]
            names = [p + x[0][len(parent) :] for p in own[over[0]]] if over else None
        out.append((*x, names or [x[0]]))
    return out


def _classes(chains: dict[tuple[str, ...], int], apart: set[frozenset]) -> list[list[tuple[str, ...]]]:
    """The chains of names (with how often each occurs) put into classes of one field each.

    Chains that share a name are one field, those with the greatest share of common names first, unless two
    chains of the classes stand side by side in some file (``apart``): these are different fields.
    """
    group = {c: [c] for c in chains}
    foes: dict[tuple, set] = {c: set() for c in chains}
    for pair in apart:
        x, y = tuple(pair)
        foes[x].add(y)
        foes[y].add(x)
    head = {c: c for c in chains}
    at: dict[str, list] = {}
    for c in sorted(chains):
        for n in set(c):
            at.setdefault(n, []).append(c)
    links = {(x, y) for cs in at.values() for i, x in enumerate(cs) for y in cs[i + 1 :]}

    def join(x: tuple, y: tuple) -> None:
        x, y = head[x], head[y]
        if x == y or any(c in foes[x] for c in group[y]):
            return
        for c in group[y]:
            head[c] = x
        group[x] += group.pop(y)
        foes[x] |= foes.pop(y)

    for x, y in sorted(links, key=lambda l: (-len(set(l[0]) & set(l[1])) / len(set(l[0]) | set(l[1])), l)):
        join(x, y)
    # Equal fields of objects that are one field, parents first.
    first: dict[tuple, tuple] = {}
    for c in sorted(chains, key=lambda c: (min(n.count(".") for n in c), c)):
        leaf = {n.rpartition(".")[2] for n in c}
        above = {n.rpartition(".")[0] for n in c}
        over = [p for p in at.get(min(above), []) if above <= set(p)] if len(leaf) == 1 else []
        if over:
            join(first.setdefault((head[min(over, key=lambda p: (len(p), p))], *leaf), c), c)
    return sorted(sorted(g) for g in group.values())


def _bounded(df: DataFrame, most: int, what: str) -> list:
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} {what}; raise max_columns")
    return got


def consistent(lines: DataFrame, log: DataFrame, foot: DataFrame, keep: list[str], stream: list[str] | None = None, file: str = "file_name", stamp: str = "file_stamp", line: str = "raw_line", max_columns: int = 2000, aliases: dict[str, str] | None = None) -> DataFrame:
    """One table of all records: a column for each field under one name, cast to one type.

    ``log`` is the result of ``changes`` of the same lines, ``foot`` of ``footers`` with shapes. All names that renames
    link, over all streams, are one field with one column: a rename links the life of the old name that ends
    with the life of the new name that begins, so that a name taken up again for another field is told apart,
    and A -> B -> A is one field. Names that stand side by side in a file stay apart. The column has the name
    that most streams end with, then the first by name. Its paths stand in its metadata (``paths``). ``aliases`` adds
    old names and new ones that no shared record links.

    Casts: an object that says one plain value (``value``, beside it only the same as text) is that value, and an
    array of one plain value is that value where the field is plain elsewhere and never a longer array. A column
    is double if all its values are numbers or texts of numbers and one is a number, boolean likewise ("true", "false",
    0 and 1 being texts of booleans and numbers), else string; other arrays are JSON text. Columns come from the catalogue, whose
    width is checked against ``max_columns``. Lines that are no JSON object are left out; repeated lines are kept.
    ``clashes`` holds, as a JSON object, the values of a record that found their column taken by another value
    of the record; null where there are none.
    """
    stream = stream or ["artifact", "stream"]
    on = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    foot = materialize(foot)
    files, spans = lifespans(foot, stream, file, stamp)
    files = materialize(files.select(*stream, file, "seq"))
    renames = log.filter("change = 'renamed' AND NOT contains(field_path, '[]') AND NOT contains(old_path, '[]')")
    renames = renames.alias("l").join(files.alias("f"), on("l", "f", [*stream, file])).select(*[f"f.{c}" for c in stream], "l.old_path", "l.field_path", "f.seq")
    # What an object says as its one plain value is the object's own field.
    says = foot.filter("array_contains(kinds, 'object') AND size(shapes) > 0").alias("l").join(files.alias("f"), on("l", "f", [*stream, file])).select(*[f"f.{c}" for c in stream], "f.seq", "l.path")
    for side, shift in (("field_path", 0), ("old_path", 1)):
        here_ = says.withColumn("seq", F.col("seq") + shift)
        renames = renames.alias("l").join(here_.alias("w"), [*on("l", "w", [*stream, "seq"]), F.col(f"l.{side}") == F.concat("w.path", F.lit(".value"))], "left").withColumn(side, F.coalesce("w.path", f"l.{side}")).select(*[f"l.{c}" for c in stream], *[side if side == c else f"l.{c}" for c in ("old_path", "field_path", "seq")])
    renames = materialize(renames.filter("old_path <> field_path").distinct())
    named = {p for r in _bounded(renames.select("old_path", "field_path").distinct(), max_columns * 10, "renames") for p in r}
    named |= {p for pair in (aliases or {}).items() for p in pair}
    # Lives of all paths that have or had another name somewhere, and of what lies below them.
    below = (F.col("path") == F.col("n")) | F.expr("startswith(path, n || '.')")
    touched = spans.filter("NOT contains(path, '[]')").select("path").distinct().join(F.broadcast(foot.sparkSession.createDataFrame([(n,) for n in sorted(named)], "n string")), below).select("path").distinct()
    w = W.partitionBy(*stream, "path").orderBy("first_seq")
    lives = spans.join(touched, "path").withColumn("fresh", F.col("before").isNull().cast("int")).withColumn("life", F.sum("fresh").over(w))
    lives = lives.groupBy(*stream, "path", "life").agg(F.min("first_seq").alias("a"), F.max("last_seq").alias("b"))
    rows = lives.select(*stream, "path", F.lit(None).cast("string").alias("old"), "a", "b").unionByName(renames.select(*stream, F.col("field_path").alias("path"), F.col("old_path").alias("old"), F.col("seq").alias("a"), F.lit(0).alias("b")))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [(p, int(a), int(b)) for p, o, a, b in zip(pdf.path, pdf.old, pdf.a, pdf.b) if not isinstance(o, str)]
        moves = [(o, p, int(a)) for p, o, a in zip(pdf.path, pdf.old, pdf.a) if isinstance(o, str)]
        key = [pdf[c].iloc[0] for c in stream]
        return pd.DataFrame([(*key, *x) for x in _chains(at, moves)], columns=[*stream, "path", "a", "b", "chain"])

    types = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in stream)
    # One group is the lives of the renamed paths of one stream.
    chains = materialize(rows.groupBy(*stream).applyInPandas(chain, f"{types}, path string, a int, b int, chain array<string>"))
    times = {tuple(r.chain): r.n for r in _bounded(chains.groupBy("chain").agg(F.count_distinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stream]).alias("n")), max_columns * 10, "chains of renames")}
    for pair in (aliases or {}).items():
        times.setdefault(pair, 0)
    beside = chains.alias("x").join(chains.alias("y"), [*on("x", "y", stream), F.col("x.chain") < F.col("y.chain"), F.col("x.a") <= F.col("y.b"), F.col("y.a") <= F.col("x.b")])
    apart = {frozenset((tuple(r.u), tuple(r.v))) for r in _bounded(beside.select(F.col("x.chain").alias("u"), F.col("y.chain").alias("v")).distinct(), max_columns * 1000, "pairs of names")}

    field: dict[tuple[str, ...], str] = {}
    used: set[str] = set()
    for group in sorted(_classes(times, apart), key=lambda g: (-max(map(len, g)), g)):
        ends: dict[str, int] = {}
        real = any(len(c) > 1 and times[c] for c in group)
        for c in group:
            if times[c] and (len(c) > 1 or not real):
                ends[c[-1]] = ends.get(c[-1], 0) + times[c]
        # the new name of a given alias, where the field has it
        given = {c[-1] for c in group if not times[c]} & {n for c in group if times[c] for n in c}
        name = min(ends or {c[-1]: 0 for c in group}, key=lambda n: (n not in given, -ends.get(n, 0), n))
        while name in used:
            name += "_"
        used.add(name)
        field |= {c: name for c in group}
    to = foot.sparkSession.createDataFrame([(list(c), n) for c, n in sorted(field.items())], "chain array<string>, field string")
    named_as = chains.join(F.broadcast(to), "chain").select(*stream, "path", "a", "b", "field")
    here = materialize(named_as.alias("c").join(files.alias("f"), [*on("c", "f", stream), F.col("f.seq").between(F.col("c.a"), F.col("c.b"))]).select(*[f"f.{c}" for c in [*stream, file]], "c.path", "c.field"))

    at = foot.filter("path <> ''").alias("t").join(here.alias("h"), on("t", "h", [*stream, file, "path"]), "left").select(F.coalesce("h.field", "t.path").alias("path"), F.col("t.path").alias("said"), F.explode("t.shapes").alias("shape"))
    # A column has at most six plain shapes, as many in an array of one, and other arrays.
    shapes = _bounded(at.filter("shape <> 'object'").groupBy("path", "shape").agg(F.array_sort(F.collect_set("said")).alias("paths")), max_columns * 13, "shapes of columns")
    cols: dict[str, set] = {}
    paths: dict[str, set] = {}
    for r in shapes:
        cols.setdefault(r.path, set()).add(r.shape)
        paths.setdefault(r.path, set()).update(r.paths)
    if len(cols) > max_columns:
        raise ValueError(f"{len(cols)} columns; raise max_columns")
    opened, casts = set(), {}
    for c, have in cols.items():
        if "array" not in have and any(x[0] != "[" for x in have):
            opened.add(c)
            have = {x.strip("[]") for x in have}
        if have <= {"number", "bit", "digits"} and have != {"digits"}:
            casts[c] = "double"
        elif have <= {"boolean", "bit", "truth"} and have != {"truth"}:
            casts[c] = "boolean"
    order = sorted(cols)
    names, taken = {}, {*keep, "clashes"}
    for p in order:
        n = p.replace(".", "__")
        while n.lower() in {t.lower() for t in taken}:
            n += "_"
        taken.add(n)
        names[p] = n
    alias = here.filter("path <> field").groupBy(*stream, file).agg(F.collect_list(F.struct("path", "field")).alias("alias"))
    lines = lines.alias("l").join(alias.alias("a"), on("l", "a", [*stream, file]), "left").select("l.*", "a.alias")

    def read(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False, name=None):
                o = parse_object(row[-1])
                if o is None:
                    continue
                final = {x["path"]: x["field"] for x in row[-2]} if row[-2] is not None else {}
                got: dict[str, str] = {}
                lost: dict[str, object] = {}
                for path, v in sorted(plain_walk(o), key=lambda x: (final.get(x[0], x[0]) != x[0], x[0])):
                    c = final.get(path, path)
                    if v is None or c not in names:
                        continue
                    if c in opened and isinstance(v, list):
                        v = v[0]
                    x = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
                    if got.setdefault(c, x) != x:
                        lost[path] = v
                rows.append((*row[:-2], *(got.get(c) for c in order), json.dumps(lost, ensure_ascii=False) if lost else None))
            yield pd.DataFrame(rows, columns=[*keep, *(names[c] for c in order), "clashes"])

    schema = ", ".join([f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in keep] + [f"`{names[c]}` string" for c in order] + ["clashes string"])
    raw = lines.select(*keep, "alias", line).mapInPandas(read, schema)
    typed = lambda c: F.expr(f"try_cast(`{names[c]}` AS {casts[c]})") if c in casts else F.col(f"`{names[c]}`")
    return raw.select(*keep, *[typed(c).alias(names[c], metadata={"paths": sorted(paths[c])}) for c in order], "clashes")
