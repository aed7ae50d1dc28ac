"""Differences between two copies of a table, by a merge over shared split points."""

from __future__ import annotations

import json
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIDE, _RANK, _TIE, _PART = "__side", "__rank", "__tie", "__part"


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both copies of a column are read as: numbers widen, other mixes become text."""
    if a == b:
        return a
    ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, ints) and isinstance(b, ints):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_common(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f.dataType for f in b.fields}
        mine = [T.StructField(f.name, _common(f.dataType, other[f.name]) if f.name in other else f.dataType) for f in a.fields]
        return T.StructType(mine + [f for f in b.fields if f.name not in {m.name for m in mine}])
    return T.StringType()


def _as(col, have: T.DataType, want: T.DataType):
    """The column cast by field name, so neither order nor missing fields of a struct matter."""
    if have == want:
        return col
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        there = {f.name: f.dataType for f in have.fields}
        fields = [(_as(col[f.name], there[f.name], f.dataType) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(col, lambda x: _as(x, have.elementType, want.elementType))
    if isinstance(want, T.StringType) and not isinstance(have, T.AtomicType):
        return F.to_json(col)
    return col.cast(want)


def _np(arr: pa.Array) -> np.ndarray:
    return arr.to_numpy(zero_copy_only=False)


def _same_as_before(cols: list[pa.Array], n: int) -> np.ndarray:
    """For rows 1..n-1: is the key that of the row before; null equals null."""
    same = np.ones(max(n - 1, 0), dtype=bool)
    for c in cols:
        a, b = c.slice(0, n - 1), c.slice(1)
        eq = _np(pc.fill_null(pc.equal(a, b), False))
        same &= eq | (_np(pc.is_null(a)) & _np(pc.is_null(b)))
    return same


def _near(a, b, eps: float) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) or isinstance(b, bool):
        return a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) <= eps or (a != a and b != b)
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_near(a[k], b[k], eps) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(_near(x, y, eps) for x, y in zip(a, b))
    return a == b


def _unequal(left: pa.Array, right: pa.Array, eps: float) -> np.ndarray:
    ln, rn = _np(pc.is_null(left)), _np(pc.is_null(right))
    t = left.type
    if pa.types.is_nested(t):
        out = ln != rn
        both = np.flatnonzero(~ln & ~rn)
        if len(both):
            at = pa.array(both)
            out[both] = [not _near(x, y, eps) for x, y in zip(left.take(at).to_pylist(), right.take(at).to_pylist())]
        return out
    if pa.types.is_floating(t):
        x, y = _np(pc.fill_null(left, 0)), _np(pc.fill_null(right, 0))
        with np.errstate(invalid="ignore"):
            eq = (x == y) | (np.abs(x - y) <= eps) | (np.isnan(x) & np.isnan(y))
    else:
        eq = _np(pc.fill_null(pc.equal(left, right), False))
    return np.where(ln | rn, ln != rn, ~eq)


def _flat(prefix: str, arr: pa.Array):
    if pa.types.is_struct(arr.type):
        for i, child in enumerate(arr.flatten()):
            yield from _flat(f"{prefix}.{arr.type.field(i).name}", child)
    else:
        yield prefix, arr


def _text(arr: pa.Array) -> list:
    """Values as text: texts as they are, all else as compact JSON, with NaN, Infinity and times in their usual form."""
    return [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"), default=str) for v in arr.to_pylist()]


def _order(v) -> tuple:
    """A value in a form that compares with any other of its column: null first, NaN last."""
    return (0,) if v is None else (2,) if v != v else (1, v)


def _order_all(cols: list[pa.Array]) -> list[tuple]:
    return list(zip(*(map(_order, c.to_pylist()) for c in cols)))


def split_points(key_rows: DataFrame, keys: list[str], rows_per_part: int, sample: int = 20_000) -> list[tuple]:
    """Keys that cut both copies into ranges of about equally many keys, from a hash sample of about ``sample`` distinct keys.

    There are as many ranges as ``rows_per_part`` gives, but no more than the session's shuffle partitions or three
    for each core. Only key columns are read.
    """
    spark = key_rows.sparkSession
    n = key_rows.count()
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    parts = min(-(-n // rows_per_part), most)
    if parts < 2:
        return []
    picked = key_rows.filter(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(max(1, n // sample))) == 0).distinct().toArrow()
    order = sorted(_order_all([picked.column(k) for k in keys]))
    return sorted({order[i * len(order) // parts] for i in range(1, parts)}) if order else []


def _latest_in_batch(keys: list[str], ranked: bool, bounds: list[tuple]):
    """Map-side combine: of each key and copy only the latest row of an Arrow batch travels, with the number of its range."""

    def run(batches):
        for b in batches:
            head = pa.Table.from_batches([b]).select([*keys, _SIDE, *([_RANK] if ranked else []), _TIE])
            pdf = head.to_pandas()
            pdf = pdf.sort_values(([_RANK] if ranked else []) + [_TIE], ascending=False, na_position="last", kind="stable")
            at = np.sort(pdf.index[~pdf.duplicated([*keys, _SIDE])].to_numpy())
            b = b.take(pa.array(at)) if len(at) < b.num_rows else b
            part = [bisect_right(bounds, k) for k in _order_all([b.column(k) for k in keys])] if bounds else [0] * b.num_rows
            yield b.append_column(_PART, pa.array(part, pa.int32()))

    return run


def diff_tables(left: DataFrame, right: DataFrame, keys: list[str], latest: str | None = None, eps: float = 1e-9, missing: tuple[str, str] = ("missing_in_right", "missing_in_left"), rows_per_part: int = 25_000) -> DataFrame:
    """Rows ``(keys..., field, left_value, right_value)``: keys that one copy lacks, and fields that differ, as text or JSON.

    Of several rows of a key the one with the greatest ``latest`` counts (null is the least; equal ones
    with other content are settled by a hash of the content, the same in both copies); exact repeats count
    once. ``latest`` is not compared. Numbers within ``eps`` are equal, also within arrays; null equals null
    only, NaN equals NaN, text is compared exactly. Structs are compared field by field as ``a.b`` (a null
    struct is one of nulls), arrays as a whole. Columns are matched by name; one that only one copy has is
    compared with nulls. Null keys are keys like others. Empty copies report the other's keys as missing.

    Split points come from the key columns alone (``split_points``), so both copies share them and the rows
    themselves are read once. They travel in one shuffle by range; within a partition rows are sorted and merged
    as a stream that holds one key. A hot key shrinks before the shuffle, to one row for each Arrow batch, and
    is never gathered.
    """
    names = list(dict.fromkeys([*left.columns, *right.columns]))
    types = {}
    for n in names:
        have = [d.schema[n].dataType for d in (left, right) if n in d.columns]
        types[n] = have[0] if len(have) == 1 else _common(*have)
    compared = [n for n in names if n not in keys and n != latest]

    def side(df: DataFrame, flag: int) -> DataFrame:
        cols = [(_as(F.col(f"`{n}`"), df.schema[n].dataType, types[n]) if n in df.columns else F.lit(None).cast(types[n])).alias(n) for n in names if n != latest]
        hashed = [F.to_json(F.struct(f"`{n}`")) if "map<" in types[n].simpleString() else F.col(f"`{n}`") for n in compared]
        stamp = [F.col(f"`{latest}`").alias(_RANK)] if latest else []
        return df.select(*cols, *stamp).select("*", F.lit(flag).cast("byte").alias(_SIDE), (F.xxhash64(*hashed) if hashed else F.lit(0).cast("long")).alias(_TIE))

    both = side(left, 0).unionByName(side(right, 1))
    bounds = split_points(both.select(*[F.col(f"`{k}`") for k in keys]), keys, rows_per_part)
    both = both.mapInArrow(_latest_in_batch(keys, bool(latest), bounds), T.StructType([*both.schema.fields, T.StructField(_PART, T.IntegerType())]))
    order = [F.col(f"`{k}`") for k in keys] + [F.col(_SIDE)] + ([F.col(_RANK).desc_nulls_last()] if latest else []) + [F.col(_TIE).desc()]
    ranged = both.repartitionById(len(bounds) + 1, F.col(_PART)).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(c, T.StringType()) for c in ("field", "left_value", "right_value")])
    out_names = [f.name for f in schema.fields]
    missing_right, missing_left = missing

    def emit(t: pa.Table, gid: np.ndarray, side_: np.ndarray):
        lrow, rrow = np.flatnonzero(side_ == 0), np.flatnonzero(side_ == 1)
        lg, rg = gid[lrow], gid[rrow]
        key_cols = [t.column(k).combine_chunks() for k in keys]

        def rows(at, field, lv=None, rv=None):
            n = len(at)
            if not n:
                return []
            idx = pa.array(at)
            return [pa.RecordBatch.from_arrays([c.take(idx) for c in key_cols] + [pa.array([field] * n, pa.string()), pa.array(lv or [None] * n, pa.string()), pa.array(rv or [None] * n, pa.string())], names=out_names)]

        yield from rows(lrow[~np.isin(lg, rg)], missing_right)
        yield from rows(rrow[~np.isin(rg, lg)], missing_left)
        pair = np.intersect1d(lg, rg)
        li, ri = lrow[np.searchsorted(lg, pair)], rrow[np.searchsorted(rg, pair)]
        la, ra = pa.array(li), pa.array(ri)
        for n in compared:
            col = t.column(n).combine_chunks()
            for (field, x), (_, y) in zip(_flat(n, col.take(la)), _flat(n, col.take(ra))):
                bad = np.flatnonzero(_unequal(x, y, eps))
                if len(bad):
                    at = pa.array(bad)
                    yield from rows(li[bad], field, _text(x.take(at)), _text(y.take(at)))

    def merge(batches):
        carry = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            n = t.num_rows
            if not n:
                continue
            new_key = ~_same_as_before([t.column(k).combine_chunks() for k in keys], n)
            gid = np.concatenate([[0], np.cumsum(new_key)])
            s = t.column(_SIDE).to_numpy()
            first = np.concatenate([[True], new_key | (s[1:] != s[:-1])])
            t, gid, s = t.filter(pa.array(first)), gid[first], s[first]
            done = gid < gid[-1]  # the last key may go on in the next batch
            carry = t.filter(pa.array(~done))
            if done.any():
                yield from emit(t.filter(pa.array(done)), gid[done], s[done])
        if carry is not None and carry.num_rows:
            yield from emit(carry, np.zeros(carry.num_rows, np.int64), carry.column(_SIDE).to_numpy())

    return ranged.mapInArrow(merge, schema)
