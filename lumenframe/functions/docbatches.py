"""JSON documents of whole Arrow batches, by columns; what isn't done here is left to ``documents`` row by row."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenframe.functions import dictionary as dd
from lumenframe.functions import documents as docs
from lumenframe.functions import tsyntax as ts
from lumenframe.functions.errors import fail
from lumenframe.sources import batches as bt
from lumenframe.sources import objects as ob

_quoted = json.encoder.encode_basestring
_TEXT = (dd.STRING_VRS | dd.TEXT_VRS) - {"PN"}
_WHOLE = frozenset(docs._JSON_INT)


def written(g: bt.Group, format: str, keys: str) -> pa.Array | None:
    """A document with inline bulk data of each row of a group; None for what isn't done by columns."""
    n = len(g.rows)
    nodes = [(x, g.content, "<") for x in g.meta if x.tag != 0x00020000] + [(x, g.body, ts.byte_order(g.syntax)) for x in g.data]
    if any(x.kind != bt.VALUE for x, _, _ in nodes):
        return None
    out: dict[str, pa.Array] = {}
    for x, buf, order in nodes:
        raw = bt.cells(buf, x.start, x.length)
        k = dd.hex_key(x.tag) if format != "flat" else dd.flat_key(x.tag, keys)
        v = _standard(x, raw, order) if format != "flat" else _flat(x, raw, order)
        out[k] = v if v is not None else _each(x, raw, order, format, keys)
    pieces: list = [b"{"]
    for i, k in enumerate(sorted(out)):
        pieces += [(b"," if i else b"") + _quoted(k).encode() + b":", out[k]]
    return bt.joined([*pieces, b"}"], n).cast(pa.string())


def _each(x: bt.Node, raw: pa.Array, order: str, format: str, keys: str) -> pa.Array:
    """Values one by one, equal ones once."""
    known: dict[bytes, bytes] = {}
    out = []
    for b in raw.to_pylist():
        got = known.get(b)
        if got is None:
            e = ob.Element(x.tag, x.vr, ob.decode_value(x.vr, b, order))
            v = docs.standard_element(e, "inline", None, None) if format != "flat" else docs._wrapped(e, docs.flat_value(e, keys, "inline", None, None))
            got = docs.dumps(v).encode()
            if len(known) < 4096 and len(b) < 4096:
                known[b] = got
        out.append(got)
    return pa.array(out, pa.binary())


def _standard(x: bt.Node, raw: pa.Array, order: str) -> pa.Array | None:
    head, vr = f'{{"Keyword":{_quoted(dd.keyword(x.tag))},' if dd.keyword(x.tag) else "{", f'"vr":"{x.vr}"}}'
    none = f'{head}"VM":0,{vr}'
    one, end = f'{head}"VM":1,"Value":[', f"],{vr}"
    if x.vr in _TEXT and x.vr not in ("DS", "IS"):
        many = x.vr not in dd.TEXT_VRS

        def several(s: str) -> str:
            p = s.split("\\")
            return f'{head}"VM":{len(p)},"Value":[{",".join(map(_quoted, p))}{end}'

        return pa.array([none if s is None else several(s) if many and "\\" in s else one + _quoted(s) + end for s in bt.texts(raw, x.vr).to_pylist()], pa.string()).cast(pa.binary())
    if x.vr in ob.NUMBERS:
        v = bt.numbers(raw, x.vr, order)
        if v is not None:
            return pa.array([none if not k else one + (repr(y) if math.isfinite(y) else "null") + end for y, k in zip(v.tolist(), x.length.tolist(), strict=True)], pa.string()).cast(pa.binary())
    return None


def _flat(x: bt.Node, raw: pa.Array, order: str) -> pa.Array | None:
    if (x.tag >> 16) & 1:
        return None
    if x.vr in dd.STRING_VRS or x.vr in dd.TEXT_VRS:
        return pa.array(["null" if s is None else _quoted(s) for s in bt.texts(raw, x.vr).to_pylist()], pa.string()).cast(pa.binary())
    if x.vr in ob.NUMBERS:
        v = bt.numbers(raw, x.vr, order)
        if v is not None:
            return pa.array(["null" if not k else repr(y) if math.isfinite(y) else '""' for y, k in zip(v.tolist(), x.length.tolist(), strict=True)], pa.string()).cast(pa.binary())
    return None


def read(a: pa.Array, format: str, target: str | None) -> tuple[list[tuple[np.ndarray, pa.Array]], list[int]]:
    """Files of documents with the same keys, and the rows to be read one by one; nulls are among the latter."""
    left, alike = [], {}
    for i, doc in enumerate(a.to_pylist()):
        try:
            x = json.loads(doc) if doc is not None else None
        except ValueError:
            x = None
        if isinstance(x, dict):
            alike.setdefault(tuple(x), []).append((i, x))
        else:
            left.append(i)
    out = []
    for names, rows in alike.items():
        try:
            got = _files(names, [x for _, x in rows], format, target) if len(rows) >= bt.LEAST else None
        except (ValueError, TypeError, KeyError, OverflowError, pa.ArrowException):  # also ObjectError: each row says what is wrong
            got = None
        if got is None:
            left += [i for i, _ in rows]
        else:
            out.append((np.array([i for i, _ in rows]), got))
    return out, sorted(left)


def _files(names: tuple[str, ...], rows: list[dict], format: str, target: str | None) -> pa.Array | None:
    flat, n = format == "flat", len(rows)
    tags = {(docs._flat_tag if flat else docs._standard_tag)(k): k for k in names}
    if len(tags) < len(names) or any(t & 0xFFFF == 0 for t in tags):
        return None
    syntax = ts.EXPLICIT_LE
    if 0x00020010 in tags:
        ux = rows[0][tags[0x00020010]]
        if any(x[tags[0x00020010]] != ux for x in rows):
            return None
        if not flat:
            ux = ux["Value"][0] if len(ux["Value"]) == 1 else None
        if not isinstance(ux, str) or not ux:
            return None
        syntax = ts.normalize(ux)
    uid = ts.normalize(target or syntax)
    if syntax not in bt.SYNTAXES or uid not in bt.SYNTAXES:
        return None
    body = bt.Sheet(n, uid)
    meta: dict = {0x00020001: ob.Element(0x00020001, "OB", b"\0\1"), 0x00020010: ob.Element(0x00020010, "UI", [uid]), 0x00020012: ob.Element(0x00020012, "UI", [ob.IMPLEMENTATION_UID])}
    for t in sorted(tags):
        values = [x[tags[t]] for x in rows]
        one = docs._flat_element if flat else docs._standard_element
        if t >> 16 == 2:
            if t not in docs._META or t == 0x00020010:
                if t != 0x00020010:
                    [one(t, v, syntax, None) for v in values]  # may be refused, then row by row
                continue
            if all(v == values[0] for v in values):
                e = one(t, values[0], syntax, None)
                if e.value is not None and (t != 0x00020001 or len(e.value) >= 2):
                    meta[t] = e
                continue
            vr, got = _column(t, values, flat)
            if got is None or not pa.types.is_string(got.type) or vr != dd.vr_of(t) or got.null_count or not pc.all(pc.not_equal(pc.binary_length(got), 0)).as_py():
                return None
            meta[t] = got
            continue
        vr, got = _column(t, values, flat)
        if got is not None and (pa.types.is_string(got.type)):
            body.text(t, vr, got)
        elif got is not None:
            body.number(t, vr, pc.fill_null(got, 0).to_numpy(zero_copy_only=False), got.is_valid().to_numpy(zero_copy_only=False))
        else:
            piece = []
            for v in values:
                w = ob.Writer(body.explicit, body.order)
                w.dataset({t: one(t, v, syntax, None)})
                piece.append(b"".join(w.out))
            body.pieces.append(pa.array(piece, pa.binary()))
    for t, src in ((0x00020002, 0x00080016), (0x00020003, 0x00080018)):
        if t in meta:
            continue
        if src in tags:
            vr, got = _column(src, [x[tags[src]] for x in rows], flat)
            if got is None or vr != "UI" or pc.any(pc.match_substring(got, "\\")).as_py():
                return None
            meta[t] = got
        else:
            meta[t] = ob.Element(t, "UI", None)
    return bt.file(n, uid, meta, body)


def _column(tag: int, values: list, flat: bool) -> tuple[str, pa.Array | None]:
    """Representation, and texts or single numbers of one attribute; None if they are of another form."""
    vr = dd.vr_of(tag)
    if not flat:
        vr = values[0]["vr"]
        if vr not in dd.ALL_VRS or any(v["vr"] != vr or len(v.get("Value") or ()) > 1 or "InlineBinary" in v or "BulkDataURI" in v for v in values):
            return vr, None
        if any(type(v.get("Value")) not in (list, type(None)) for v in values):
            raise fail("InvalidValue", "Value is not an array")
        values = [v["Value"][0] if v.get("Value") else None for v in values]
        if any(v is None for v in values):
            return vr, None  # no value or an empty one
    kinds = set(map(type, values)) - {type(None)}
    if vr in (_TEXT | {"PN"} if flat else _TEXT) and kinds <= {str}:
        return vr, pa.array(values, pa.string())
    if vr == "FD" and kinds <= {float, int}:
        return vr, pa.array([None if v is None else float(v) for v in values], pa.float64())
    if vr in _WHOLE and kinds == {int}:
        lo, hi = docs._JSON_INT[vr]
        if all(v is None or lo <= v < hi for v in values):
            return vr, pa.array(values, pa.uint64() if vr == "UV" else pa.int64())
    return vr, None
