"""Objects in DataFrames: element rows, wide rows, frames, renders, and Column functions over content.

Every function maps rows on their own: no shuffle. A row that fails keeps its place with
an error code and message (``mode="PERMISSIVE"``), or fails the job (``"FAILFAST"``).
Batches are cut by bytes, so large objects do not pile up in one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lumenframe.functions import dictionary as dd
from lumenframe.functions import docbatches as db
from lumenframe.functions import documents as docs
from lumenframe.functions import tsyntax as ts
from lumenframe.functions.errors import ObjectError
from lumenframe.operators import pixels as px
from lumenframe.operators import transcode as tc
from lumenframe.sources import batches as bt
from lumenframe.sources import objects as ob

EXPLODED_BYTES = 2 << 20  # of contents and results in a batch of frames
ELEMENTS = (
    "item_path string, ord int, tag bigint, tag_hex string, keyword string, vr string, vm int, str_values array<string>, num_values array<double>, "
    "int_values array<decimal(20,0)>, bytes binary, offset bigint, value_length bigint, is_meta boolean, error_code string, error_message string"
)
_E_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.decimal128(20, 0)), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]


def _error(err: Exception, mode: str) -> tuple[str, str]:
    if mode == "FAILFAST" or not isinstance(err, ObjectError | ValueError | KeyError | IndexError | OverflowError | TypeError):
        raise err
    return (err.code if isinstance(err, ObjectError) else type(err).__name__), str(err)


def _kept(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*[F.col(f"`{c}`") for c in keep]).schema)


def element_rows(o: ob.Object, only: frozenset[int] | None = None) -> Iterator[tuple]:
    n = 0

    def walk(data: dict, path: str, meta: bool) -> Iterator[tuple]:
        nonlocal n
        for t in sorted(data):
            e = data[t]
            v = e.value
            if only is not None and t not in only and e.vr != "SQ":
                n += 1
                continue
            text = nums = ints = raw = None
            if isinstance(v, ob.Fragments):
                raw = ob.fragment_bytes(v)
            elif isinstance(v, bytes):
                raw = v
            elif e.vr != "SQ" and v is not None:
                text = [x if isinstance(x, str) else dd.expression(x) if e.vr == "AT" else ob.number_text(x) for x in v]
                if e.vr in ob.NUMBERS:
                    nums = [float(x) for x in v]
                    ints = [Decimal(x) for x in v] if e.vr not in ("FL", "FD") else None
                elif e.vr in ("DS", "IS"):
                    got = [px.first_number(x) for x in v]
                    nums = got if all(x is not None for x in got) else None
            if only is None or t in only:
                yield path, n, t, dd.hex_key(t), dd.keyword(t), e.vr, e.vm, text, nums, ints, raw, e.offset, e.length, meta, None, None
            n += 1
            if e.vr == "SQ":
                for k, item in enumerate(v or ()):
                    yield from walk(item, f"{path}{'.' if path else ''}{dd.hex_key(t)}[{k}]", meta)

    yield from walk(o.meta, "", True)
    yield from walk(o.data, "", False)


def _listed(values: pa.Array, there: np.ndarray) -> pa.Array:
    """Lists of one value where there is one, else null."""
    kind = pa.list_(values.type)
    if there.all():
        return pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1), pa.int32()), values).cast(kind)
    off = np.concatenate([[0], np.cumsum(there)])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values.filter(pa.array(there)), mask=pa.array(~there)).cast(kind)


def element_columns(g: bt.Group, only: frozenset[int] | None = None) -> list[pa.Array] | None:
    """What ``element_rows`` gives, for all rows of a group; None for what isn't done by columns."""
    n, out, k = len(g.rows), [], 0
    same = lambda x, t: pa.array([x], t).take(pa.array(np.zeros(n, np.int64)))
    for nodes, buf, origin, order, is_meta in ((g.meta, g.content, None, "<", True), (g.data, g.body, g.origin, ts.byte_order(g.syntax), False)):
        path: list[tuple[str, int]] = []  # sequences around a place, and how many items each has had
        for i, x in enumerate(nodes):
            if x.kind == bt.ITEM:
                path[-1] = path[-1][0], path[-1][1] + 1
            elif x.kind == bt.SEQUENCE_END:
                path.pop()
            if x.kind not in (bt.VALUE, bt.SEQUENCE):
                continue
            if only is None or x.tag in only:
                text, nums, ints, raw = (pa.nulls(n, t) for t in _E_TYPES[7:11])
                there, length = x.length > 0, x.length
                vm = there.astype(np.int32)
                if x.kind == bt.SEQUENCE:
                    end = next(y for y in nodes[i:] if y.kind == bt.SEQUENCE_END and y.depth == x.depth)
                    length = end.start - x.start - 8
                    inside = nodes[i : next(j for j in range(i, len(nodes)) if nodes[j] is end)]
                    vm = np.full(n, sum(y.kind == bt.ITEM and y.depth == x.depth + 1 for y in inside), np.int32)
                elif x.vr in dd.BULK_VRS:
                    raw = bt.cells(buf, x.start, x.length)
                    raw = bt.swapped(raw, ob.WIDTH.get(x.vr, 1)) if order == ">" else raw
                    raw = pc.if_else(pa.array(there), raw.cast(pa.binary()), pa.scalar(None, pa.binary()))
                elif x.vr in dd.STRING_VRS or x.vr in dd.TEXT_VRS:
                    s = bt.texts(bt.cells(buf, x.start, x.length), x.vr)
                    several = x.vr in dd.STRING_VRS and pc.any(pc.match_substring(s, "\\")).as_py()
                    text = pc.split_pattern(s, "\\") if several else _listed(s, s.is_valid().to_numpy(zero_copy_only=False))
                    vm = pc.fill_null(pc.list_value_length(text), 0).to_numpy(zero_copy_only=False)
                    if x.vr in ("DS", "IS"):
                        got = [None if y is None else [px.first_number(z) for z in y] for y in text.to_pylist()]
                        nums = pa.array([None if y is None or None in y else y for y in got], _E_TYPES[8])
                else:
                    v = bt.numbers(bt.cells(buf, x.start, x.length), x.vr, order)
                    if v is None:
                        return None
                    write = dd.expression if x.vr == "AT" else ob.number_text
                    text = _listed(pa.array([write(y) for y in v.tolist()], pa.string()), there)
                    if x.vr != "AT":
                        nums = _listed(pa.array(v.astype(np.float64)), there)
                        ints = _listed(pa.array(v).cast(pa.decimal128(20, 0)), there) if x.vr not in ("FL", "FD") else ints
                where = ".".join(f"{a}[{b}]" for a, b in path)
                offset = x.start - (g.start if is_meta else origin)
                out.append(
                    [same(where, pa.string()), same(k, pa.int32()), same(x.tag, pa.int64()), same(dd.hex_key(x.tag), pa.string()), same(dd.keyword(x.tag), pa.string()), same(x.vr, pa.string()), pa.array(vm, pa.int32()), text, nums, ints, raw, pa.array(offset), pa.array(length), same(is_meta, pa.bool_()), *[pa.nulls(n, pa.string())] * 2]
                )
            k += 1
            if x.kind == bt.SEQUENCE:
                path.append((dd.hex_key(x.tag), -1))
    if not out:
        return [pa.nulls(0, t) for t in _E_TYPES]
    order = pa.array((np.arange(n)[:, None] + n * np.arange(len(out))).ravel())
    return [pa.concat_arrays([c.cast(t) for c in cols]).take(order) for cols, t in zip(zip(*out, strict=True), _E_TYPES, strict=True)]


def elements(df: DataFrame, content: str = "content", keep: list[str] | None = None, mode: str = "PERMISSIVE", preamble: str = "auto", keywords: list[str] | None = None) -> DataFrame:
    """One row per element, nested ones with the path of their item; one row with the error for a broken object.

    With ``keywords`` only those elements are decoded and listed, at any depth and under their
    usual numbers; a filter on the result would come after all values are built.
    """
    only = None if keywords is None else frozenset(docs.parse_key(k) for k in keywords)
    keep = keep if keep is not None else [c for c in df.columns if c != content]

    names = [*keep, *(x.split()[0] for x in ELEMENTS.split(", "))]

    def one(x: bytes | None) -> list[tuple]:
        if x is None:
            return []
        try:
            return list(element_rows(ob.parse(x, preamble, only), only))
        except Exception as err:
            return [(None,) * 14 + _error(err, mode)]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in bt.parts(whole, len(keep)):
                groups, left = bt.scan(b.column(len(keep)))
                at, got = [], []
                for g in groups:
                    cols = element_columns(g, only)
                    if cols is None:
                        left += g.rows.tolist()
                    elif len(cols[0]):
                        at.append(np.repeat(g.rows, len(cols[0]) // len(g.rows)))
                        got.append(cols)
                rows = [(i, r) for i in left for r in one(b.column(len(keep))[i].as_py())]
                if rows:
                    at.append(np.array([i for i, _ in rows]))
                    got.append([pa.array(c, t) for c, t in zip(zip(*(r for _, r in rows), strict=True), _E_TYPES, strict=True)])
                if not got:
                    continue
                idx, cols = np.concatenate(at), [pa.concat_arrays(c) for c in zip(*got, strict=True)]
                if len(got) > 1:
                    order = np.argsort(idx, kind="stable")
                    idx, cols = idx[order], [c.take(pa.array(order)) for c in cols]
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(idx)) for k in range(len(keep))] + cols, names=names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{content}`")).mapInArrow(work, _kept(df, keep) + ELEMENTS)


def wide(df: DataFrame, keywords: list[str], content: str = "content", keep: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per object: the attributes' texts in columns, transfer_syntax_uid, pixel_kind and the error."""
    keep = keep if keep is not None else [c for c in df.columns if c != content]
    tags = [docs.parse_key(k) for k in keywords]
    tail = ["transfer_syntax_uid", "pixel_kind", "error_code", "error_message"]
    schema = _kept(df, keep) + ", ".join(f"`{c}` string" for c in [*keywords, *tail])

    def one(x: bytes | None) -> tuple:
        try:
            if x is None:
                return (None,) * (len(tags) + 4)
            o = ob.parse(x)
            return *(o.text(t) for t in tags), o.syntax, tc.pixel_kind(o), None, None
        except Exception as err:
            return (None,) * (len(tags) + 2) + _error(err, mode)

    def group(g: bt.Group) -> list[pa.Array]:
        n, e = len(g.rows), g.find(ob.PIXELS)[0]
        kind = pa.nulls(n, pa.string()) if e is None or e.kind != bt.VALUE else pc.if_else(pa.array(e.length > 0), "native", pa.scalar(None, pa.string()))
        return [*(bt.column(g, t) for t in tags), pa.array([g.syntax] * n, pa.string()), pc.fill_null(kind, "absent"), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in bt.parts(whole, len(keep)):
                groups, left = bt.scan(b.column(len(keep)))
                got = [(g.rows, group(g)) for g in groups]
                if left:
                    rows = [one(b.column(len(keep))[i].as_py()) for i in left]
                    got.append((np.array(left), [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]))
                cols = [bt.merged(b.num_rows, [(r, c[k]) for r, c in got], pa.string()) for k in range(len(tags) + 4)]
                yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + cols, names=[*keep, *keywords, *tail])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{content}`")).mapInArrow(work, schema)


def _function(f: Callable, returns: str, mode: str) -> Callable[..., Column]:
    """An Arrow function over columns that gives struct<value, code, message> a row."""
    kind = {"binary": pa.binary(), "string": pa.string()}[returns]
    schema = f"value {returns}, code string, message string"

    def run(*cols: pa.Array) -> pa.Array:
        v, c, m = [], [], []
        for cells in zip(*cols, strict=True):
            try:
                row = [x.as_py() for x in cells]
                v.append(None if row[0] is None else f(*row))
                c.append(None)
                m.append(None)
            except Exception as err:
                code, message = _error(err, mode)
                v.append(None)
                c.append(code)
                m.append(message)
        return pa.StructArray.from_arrays([pa.array(v, kind), pa.array(c, pa.string()), pa.array(m, pa.string())], names=["value", "code", "message"])

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return lambda *cols: arrow_udf(one if len(cols) == 1 else two, schema)(*cols)


def _batched(f: Callable[[object], object], columns: Callable[[pa.Array], tuple[list, list[int]]], returns: str, mode: str) -> Callable[[Column], Column]:
    """An Arrow function like ``_function`` of one column: by columns where that is possible, else row by row."""
    types = ({"binary": pa.binary(), "string": pa.string()}[returns], pa.string(), pa.string())

    def part(a: pa.Array) -> pa.StructArray:
        done, left = columns(a)
        got = [(r, [v, *[pa.nulls(len(v), pa.string())] * 2]) for r, v in done]
        if left:
            rows = []
            for i in left:
                try:
                    x = a[i].as_py()
                    rows.append((None if x is None else f(x), None, None))
                except Exception as err:
                    rows.append((None, *_error(err, mode)))
            got.append((np.array(left), [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]))
        return pa.StructArray.from_arrays([bt.merged(len(a), [(r, c[k]) for r, c in got], t) for k, t in enumerate(types)], names=["value", "code", "message"])

    def run(a: pa.Array) -> pa.Array:
        done = [part(b.column(0)) for b in bt.parts(pa.RecordBatch.from_arrays([a], ["content"]), 0)]
        return pa.concat_arrays(done) if done else part(a)

    return arrow_udf(run, f"value {returns}, code string, message string")


def _by_group(f: Callable[[bt.Group], pa.Array | None]) -> Callable[[pa.Array], tuple[list, list[int]]]:
    def columns(a: pa.Array) -> tuple[list, list[int]]:
        groups, left = bt.scan(a)
        done = []
        for g in groups:
            v = f(g)
            if v is None:
                left += g.rows.tolist()
            else:
                done.append((g.rows, v))
        return done, left

    return columns


def transcode(content: Column, target: str, quality: int = 90, mode: str = "PERMISSIVE") -> Column:
    uid = ts.normalize(target)

    def columns(g: bt.Group) -> pa.Array | None:
        return bt.rewritten(g, uid) if uid in bt.SYNTAXES else None

    return _batched(lambda x: ob.write(tc.transcode(ob.parse(x), target, quality)), _by_group(columns), "binary", mode)(content)


def override(content: Column, sets: list[str] = (), removes: list[str] = (), mode: str = "PERMISSIVE") -> Column:
    [docs.parse_set(x) for x in sets], [docs.parse_key(x) for x in removes]  # refused before any job
    gone = frozenset(docs.parse_key(x) for x in removes)
    try:
        new = docs.override(ob.Object(), list(sets))
        [ob.encode_value(e, order) for e in new.data.values() for order in "<>"]
    except ObjectError:
        new = None  # a value that doesn't fit: every row says so

    def columns(g: bt.Group) -> pa.Array | None:
        if new is None or new.meta or any(t >> 16 == 2 for t in gone):
            return None
        return bt.rewritten(g, None, new.data, gone)

    return _batched(lambda x: ob.write(docs.override(ob.parse(x), list(sets), list(removes))), _by_group(columns), "binary", mode)(content)


def redact(content: Column, boxes: list[str], color: str = "0,0,0", target: str | None = None, mode: str = "PERMISSIVE") -> Column:
    b, c = tuple(px.parse_box(x) for x in boxes), px.parse_color(color)
    return _function(lambda x: ob.write(tc.redact(ob.parse(x), b, c, target)), "binary", mode)(content)


def render_object(content: Column, target: str, options: px.Options = px.Options(), mode: str = "PERMISSIVE") -> Column:
    return _function(lambda x: ob.write(tc.render_object(ob.parse(x), options, target)), "binary", mode)(content)


def to_json_doc(content: Column, format: str = "flat", keys: str = "name", bulk: str = "inline", base: str | None = None, sets: list[str] = (), removes: list[str] = (), compat: bool = False, mode: str = "PERMISSIVE") -> Column:
    """A document of each object; in uri mode addresses point into the content itself, as it was before overrides."""
    f = lambda x: docs.write_json(docs.override(ob.parse(x), list(sets), list(removes)), format, keys, bulk, x if bulk == "uri" else None, base, compat)
    if bulk == "inline" and format in ("flat", "standard") and not sets and not removes:
        return _batched(f, _by_group(lambda g: db.written(g, format, keys)), "string", mode)(content)
    return _function(f, "string", mode)(content)


def from_json_doc(doc: Column, format: str = "flat", source: Column | None = None, target: str | None = None, mode: str = "PERMISSIVE") -> Column:
    """A file of each document; ``source`` holds the bytes that addresses point into."""
    f = lambda d, s=None: ob.write(docs.read_json(d, format, s), target)
    return _batched(f, lambda a: db.read(a, format, target), "binary", mode)(doc) if source is None else _function(f, "binary", mode)(doc, source)


FRAMES = "frame_index int, rows int, columns int, samples int, bits_allocated int, bits_stored int, is_signed boolean, planar int, photometric string, frame binary, error_code string, error_message string"
_F_TYPES = [pa.int32()] * 6 + [pa.bool_(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string()]
RENDERS = "frame_index int, width int, height int, samples int, bits int, format string, bytes binary, error_code string, error_message string"
_R_TYPES = [pa.int32()] * 5 + [pa.string(), pa.binary(), pa.string(), pa.string()]


def _exploded(df: DataFrame, content: str, keep: list[str] | None, mode: str, schema: str, types: list, f: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    keep = keep if keep is not None else [c for c in df.columns if c != content]
    names = [*keep, *(x.split()[0] for x in schema.split(", "))]

    def batch(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        idx = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(k).take(idx) for k in range(len(keep))] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, rows, size = [], [], 0
            for i in range(b.num_rows):
                x = b.column(len(keep))[i].as_py()
                if x is None:
                    continue
                try:
                    got = list(f(x))
                except Exception as err:
                    got = [(None,) * (len(types) - 2) + _error(err, mode)]
                rows += got
                at += [i] * len(got)
                size += len(x) + sum(len(y) * (8 if isinstance(y, list) else 1) for r in got for y in r if isinstance(y, bytes | list))
                if size > EXPLODED_BYTES:
                    if rows:
                        yield batch(b, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield batch(b, at, rows)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{content}`")).mapInArrow(work, _kept(df, keep) + schema)


def frames(df: DataFrame, content: str = "content", keep: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per frame with its native bytes."""

    def f(x: bytes) -> Iterator[tuple]:
        o = tc.native(ob.parse(x))
        m, raw = px.read_meta(o), px.native_bytes(o)
        for k in range(m.frames):
            yield k, m.rows, m.columns, m.samples, m.allocated, m.stored, m.signed, m.planar, m.photometric, px.frame_bytes(raw, m, k), None, None

    return _exploded(df, content, keep, mode, FRAMES, _F_TYPES, f)


def render(df: DataFrame, content: str = "content", options: px.Options = px.Options(), all_frames: bool = False, keep: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per rendered frame: an encoded image, or native bytes for raw."""
    px.check_window(options)

    def f(x: bytes) -> Iterator[tuple]:
        for k, r in enumerate(tc.render_frames(ob.parse(x), options, all_frames)):
            yield (k if all_frames else options.frame), *r, None, None

    return _exploded(df, content, keep, mode, RENDERS, _R_TYPES, f)


def pixel_values(df: DataFrame, content: str = "content", options: px.Options = px.Options(), keep: list[str] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """One row per frame with the rendered 8-bit samples as an array, for arithmetic in SQL."""

    def f(x: bytes) -> Iterator[tuple]:
        o = tc.native(ob.parse(x))
        for k in range(px.read_meta(o).frames):
            r = px.render(o, options, k)
            yield k, r.width, r.height, r.samples, r.pixels.ravel().tolist(), None, None

    schema = "frame_index int, width int, height int, samples int, values array<int>, error_code string, error_message string"
    return _exploded(df, content, keep, mode, schema, [pa.int32()] * 4 + [pa.list_(pa.int32()), pa.string(), pa.string()], f)


def encode(df: DataFrame, attributes: dict[str, str], syntax: str = ts.EXPLICIT_LE, keep: list[str] | None = None, constants: dict[str, object] | None = None) -> DataFrame:
    """Objects from rows: ``attributes`` names the column of each keyword or hexadecimal tag; adds ``content``.

    Null leaves an attribute empty. Bulk attributes take binary columns, sequences arrays of
    structs whose fields are keywords.
    """
    keep = keep if keep is not None else df.columns
    tags = {docs.parse_key(k): c for k, c in attributes.items()}
    fixed = {docs.parse_key(k): v for k, v in (constants or {}).items()}
    cols = list(dict.fromkeys(tags.values()))

    def item(x: dict) -> dict:
        return ob.build(x).data

    def one(row: dict) -> bytes:
        values: dict = dict(fixed)
        for t, c in tags.items():
            v = row[c]
            if dd.vr_of(t) == "SQ" and v is not None:
                v = [item(x) for x in v]
            elif v is not None and dd.vr_of(t) in dd.STRING_VRS | dd.TEXT_VRS:
                v = [x if isinstance(x, str) else ob.number_text(x) for x in (v if isinstance(v, list) else [v])]
            values[t] = v
        return ob.write(ob.build(values, syntax))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = bt.encoded(b.num_rows, {t: b.column(len(keep) + cols.index(c)) for t, c in tags.items()}, fixed, syntax) if b.num_rows else None
            if out is None:
                data = {c: b.column(len(keep) + k).to_pylist() for k, c in enumerate(cols)}
                out = pa.array([one({c: data[c][i] for c in cols}) for i in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [out], names=[*keep, "content"])

    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(cols)]).mapInArrow(work, _kept(df, keep) + "content binary")


def pack(values: Column, bits: int) -> Column:
    """Little-endian bytes of an array of whole numbers; single bits most significant first."""
    import numpy as np

    def run(a: pa.Array) -> pa.Array:
        out = []
        for x in a.to_pylist():
            if x is None:
                out.append(None)
            elif bits == 1:
                out.append(np.packbits(np.array(x, np.uint8)).tobytes())
            else:
                out.append(np.array(x, np.int64).astype(f"<u{bits // 8}").tobytes())
        return pa.array(out, pa.binary())

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    return arrow_udf(one, "binary")(values)
