"""Nested records to related flat tables.

Each Arrow batch of records is read once, as a stream, into path-value-ordinal triples. The triples of
one leaf path are held as a column (owner record, ordinals of the repeated ancestors, value), so leaves
that share their repeated ancestor have equal ordinals and pivoting them into one table is putting the
columns side by side: no shuffle, no row-wise Python, and only the wanted columns are read from the scan.
The repeated ancestors are found in the schema: arrays, written ``path[]``, and maps, written ``path{}``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Triples:
    """All triples of one leaf path: value i belongs to record owner[i], at ordinals[:, i]."""

    group: str
    leaf: str
    owner: np.ndarray
    ordinals: np.ndarray
    values: pa.Array


def _whole(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _open(arr: pa.Array, owner: np.ndarray, ordinals: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The non-null elements of a list column, with their record and their ordinals (nulls counted)."""
    sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parent = np.repeat(np.arange(len(arr)), sizes)
    pos = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = pc.list_flatten(arr)
    there = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(there)), owner[parent][there], np.vstack([ordinals[:, parent], pos])[:, there]


def _entries(arr: pa.MapArray, owner: np.ndarray, ordinals: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The keys and values of a map column, with their record and their ordinals."""
    offsets = arr.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    first, sizes = offsets[0], np.diff(offsets)
    parent = np.repeat(np.arange(len(arr)), sizes)
    pos = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there = pc.is_valid(arr).to_numpy(zero_copy_only=False)[parent]
    keys, items = (x.slice(first, len(parent)).filter(pa.array(there)) for x in (arr.keys, arr.items))
    return keys, items, owner[parent][there], np.vstack([ordinals[:, parent], pos])[:, there]


def _inner(group: str, leaf: str, mark: str) -> str:
    return f"{group}{'.' if group and leaf else ''}{leaf}{mark}"


def _leaves(arr: pa.Array, group: str, leaf: str, owner, ordinals, wanted: set[str]) -> Iterator[Triples]:
    """The triples of all leaves of the wanted groups; the first of a group marks its elements themselves."""
    t = arr.type
    if pa.types.is_map(t) or pa.types.is_list(t) or pa.types.is_large_list(t):
        inner = _inner(group, leaf, "{}" if pa.types.is_map(t) else "[]")
        if not any(w.startswith(inner) for w in wanted):
            return
        if pa.types.is_map(t):
            keys, items, o, n = _entries(arr, owner, ordinals)
            parts = [("key", keys), ("value", items)]
        else:
            flat, o, n = _open(arr, owner, ordinals)
            parts = [("", flat)]
        if inner in wanted:
            yield Triples(inner, "", o, n, pa.nulls(len(o)))
        for name, values in parts:
            yield from _leaves(values, inner, name, o, n, wanted)
    elif pa.types.is_struct(t):
        for field, child in zip([t.field(i).name for i in range(t.num_fields)], arr.flatten()):
            yield from _leaves(child, group, f"{leaf}.{field}" if leaf else field, owner, ordinals, wanted)
    elif group in wanted:
        yield Triples(group, leaf, owner, ordinals, arr)


def triples_of(batch: pa.RecordBatch, columns: list[str], wanted: set[str]) -> Iterator[Triples]:
    """Triples of the wanted groups (such as ``events[].ids[]``; '' for the records themselves) of one batch."""
    owner, none = np.arange(batch.num_rows), np.empty((0, batch.num_rows), dtype=np.int64)
    if "" in wanted:
        yield Triples("", "", owner, none, pa.nulls(len(owner)))
    for c in columns:
        yield from _leaves(_whole(batch.column(c)), "", c, owner, none, wanted)


def groups_of(schema: T.StructType, columns: list[str]) -> dict[str, list[tuple[str, T.DataType]]]:
    """Each group of paths by repeated ancestor, with its leaves: '' for the record, ``path[]`` an array, ``path{}`` a map."""
    out: dict[str, list[tuple[str, T.DataType]]] = {"": []}

    def visit(dt: T.DataType, group: str, leaf: str) -> None:
        if isinstance(dt, T.ArrayType):
            inner = _inner(group, leaf, "[]")
            out[inner] = []
            visit(dt.elementType, inner, "")
        elif isinstance(dt, T.MapType):
            inner = _inner(group, leaf, "{}")
            out[inner] = []
            visit(dt.keyType, inner, "key")
            visit(dt.valueType, inner, "value")
        elif isinstance(dt, T.StructType):
            for f in dt.fields:
                visit(f.dataType, group, f"{leaf}.{f.name}" if leaf else f.name)
        else:
            out[group].append((leaf, dt))

    for c in columns:
        visit(schema[c].dataType, "", c)
    return out


_PLACE = ("parent_pos", "pos", "ordinals")


@dataclass
class Shredded:
    """All tables of a nested one. ``rows`` has a row for each record and each element, from one pass over the source.

    Its columns: the record's key, ``child`` (the table), ``parent_pos``, ``pos``, ``ordinals``, and for each table a
    struct of its own fields, null in the rows of others.
    """

    rows: DataFrame
    key: str
    fields: dict[str, list[str]]  # table -> names of its fields
    structs: dict[str, str]  # table -> name of its struct

    def table(self, path: str) -> DataFrame:
        """The flat table of one path, such as ``events[].ids``, ``events[].ids[]`` or ``counts{}``; '' for the records."""
        name = path if path in self.structs else path + "[]"
        if name not in self.structs:
            raise ValueError(f"{path} is no array or map")
        s = self.structs[name]
        own = [F.col(f"`{s}`")[f].alias(f) for f in self.fields[name]]
        at = [] if name == "" else [F.col(c) for c in _PLACE]
        return self.rows.filter(F.col("child") == name).select(F.col(f"`{self.key}`"), *at, *own)

    def write(self, folder: str) -> None:
        """All tables as Parquet, a folder ``child=...`` each, in one pass over the source."""
        self.rows.write.mode("overwrite").partitionBy("child").parquet(folder)


def shred_all(df: DataFrame, key: str, columns: list[str] | None = None, tables: list[str] | None = None, values: bool = True) -> Shredded:
    """Related flat tables of a nested one: the records' own, and one for each array and each map at any depth.

    A table's rows name their record by ``key``, their parent element by ``parent_pos`` (its place, -1 where the record
    itself is the parent) and their own place by ``pos`` (0-based in the stored array, null elements counted; in the
    stored order of a map); ``ordinals`` are the places of all repeated ancestors and the element. Fields of structs are
    named ``a_b``, a plain element is ``value``, a map has ``key`` and ``value``. A field named as one of
    the columns above gets the prefix ``elem_``.

    ``columns`` are the top columns to be read, all by default; ``tables`` the paths to be given, all by default.
    With ``values=False`` only places come out. Null and empty arrays and null elements give no row; a null key stays
    null; records sharing a key keep all their rows; an empty table gives empty ones.
    """
    columns = [c for c in (columns or df.columns) if c != key]
    groups = groups_of(df.schema, columns)
    if tables is not None:
        named = [t if t in groups else t + "[]" for t in tables]
        if missing := [t for t, n in zip(tables, named) if n not in groups]:
            raise ValueError(f"{missing}: no arrays or maps")
        groups = {g: groups[g] for g in named}
    fields: dict[str, list[str]] = {}
    for g, leaves in groups.items():
        taken, names = {key, *_PLACE}, []
        for leaf, _ in leaves:
            name = leaf.replace(".", "_") or "value"
            while name in taken:
                name = f"elem_{name}"
            taken.add(name)
            names.append(name)
        fields[g] = names
    structs: dict[str, str] = {}
    for n, g in enumerate(groups):
        structs[g] = f"t{n}"
        while structs[g] == key:
            structs[g] += "_"
    head = [T.StructField(key, df.schema[key].dataType), T.StructField("child", T.StringType()), T.StructField("parent_pos", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("ordinals", T.ArrayType(T.IntegerType()))]
    own = {g: T.StructType([T.StructField(n, dt) for n, (_, dt) in zip(fields[g], leaves)]) for g, leaves in groups.items()} if values else {}
    schema = T.StructType(head + [T.StructField(structs[g], t) for g, t in own.items() if t.fields])
    wanted = set(groups)
    # an empty struct is no Parquet column; tables of arrays of arrays have none
    shown = [g for g, t in own.items() if t.fields]

    def pivot(batches):
        for batch in batches:
            found: dict[str, tuple[Triples, dict[str, pa.Array]]] = {}
            for t in triples_of(batch, columns, wanted):
                found.setdefault(t.group, (t, {}))[1][t.leaf] = t.values
            at = {g: {leaf: cols[leaf] for leaf, _ in groups[g]} for g, (_, cols) in found.items()} if values else {}
            types = {g: [c.type for c in at[g].values()] for g in shown if g in at}
            for g, (mark, _) in found.items():
                n, depth = len(mark.owner), len(mark.ordinals)
                if not n:
                    continue
                pos = mark.ordinals[-1].astype(np.int32) if depth else np.full(n, -1, np.int32)
                parent = mark.ordinals[-2].astype(np.int32) if depth > 1 else np.full(n, -1, np.int32)
                ordinals = pa.ListArray.from_arrays(np.arange(0, (n + 1) * depth, depth, dtype=np.int32) if depth else np.zeros(n + 1, np.int32), pa.array(mark.ordinals.T.reshape(-1).astype(np.int32)))
                out = [_whole(batch.column(key)).take(pa.array(mark.owner)), pa.array([g] * n, pa.string()), pa.array(parent), pa.array(pos), ordinals]
                for x in shown:
                    if x == g:
                        out.append(pa.StructArray.from_arrays([_whole(c) for c in at[g].values()], names=fields[g]))
                    else:
                        out.append(pa.nulls(n, pa.struct(list(zip(fields[x], types[x])))))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    rows = df.select(key, *columns).mapInArrow(pivot, schema)
    return Shredded(rows, key, fields if values else {g: [] for g in groups}, structs)


def shred(df: DataFrame, key: str, path: str) -> DataFrame:
    """The flat table of the array at ``path``, such as ``events`` or ``events[].ids``, alone; see ``shred_all``."""
    column = path.split("[]")[0].split("{}")[0].split(".")[0]
    return shred_all(df, key, [column], [path]).table(path)


def triples(df: DataFrame, key: str, column: str, path: str) -> DataFrame:
    """The triples themselves, as rows ``(key, group_path, ordinals, leaf_path, value)``, values as text.

    ``leaf_path`` is '' for the row that marks an element. Nulls are kept as null values.
    """
    wanted = path + "[]"
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("group_path", T.StringType()), T.StructField("ordinals", T.ArrayType(T.IntegerType())), T.StructField("leaf_path", T.StringType()), T.StructField("value", T.StringType())]
    )

    def long(batches):
        for batch in batches:
            for t in triples_of(batch, [column], {wanted}):
                if len(t.owner):
                    n, depth = len(t.owner), len(t.ordinals)
                    ordinals = pa.ListArray.from_arrays(np.arange(0, (n + 1) * depth, depth, dtype=np.int32), pa.array(t.ordinals.T.reshape(-1).astype(np.int32)))
                    values = pa.nulls(n, pa.string()) if pa.types.is_null(t.values.type) else t.values.cast(pa.string())
                    yield pa.RecordBatch.from_arrays([_whole(batch.column(key)).take(pa.array(t.owner)), pa.array([wanted] * n), ordinals, pa.array([t.leaf] * n), values], names=[f.name for f in schema.fields])

    return df.select(key, column).mapInArrow(long, schema)


def places(samples: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(child, record_id, parent_pos, pos)`` of all elements of the four nested arrays of the audit data, a pass over each table."""
    own = shred_all(samples, "record_id", ["blocks"], ["blocks"], values=False).rows
    theirs = shred_all(ledger, "ledger_id", ["retry_attempts", "cascade_events"], ["retry_attempts", "cascade_events", "cascade_events[].replaced_block_ordinals"], values=False).rows
    rows = own.unionByName(theirs.withColumnRenamed("ledger_id", "record_id"))
    # the last name on the path
    return rows.select(F.regexp_extract("child", r"(\w+)\[\]$", 1).alias("child"), "record_id", "parent_pos", "pos")
