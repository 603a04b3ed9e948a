"""Many objects at a time: reading and writing whole Arrow batches by columns.

Objects of a batch that hold the same elements in the same order are read in step, an
element of all of them at once; only places and lengths differ. What is not alike, broken or
encapsulated is left to ``objects`` row by row, so results and errors are those of ``parse`` and ``write``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenframe.functions import dictionary as dd
from lumenframe.functions import tsyntax as ts
from lumenframe.sources import objects as ob

LEAST = 16  # fewer rows alike are read one by one
PART_BYTES = 8 << 20
VALUE, SEQUENCE, ITEM, ITEM_END, SEQUENCE_END = range(5)
SYNTAXES = (ts.EXPLICIT_LE, ts.IMPLICIT_LE, ts.EXPLICIT_BE, ts.DEFLATED)
_RIGHT_ONLY = ("UC", "PN", "LO", "SH")


@dataclass
class Node:
    """One element of all rows of a group, or a head or delimiter of a sequence."""

    tag: int
    vr: str
    kind: int
    depth: int
    start: np.ndarray
    length: np.ndarray

    def of(self, pick: np.ndarray) -> Node:
        return Node(self.tag, self.vr, self.kind, self.depth, self.start[pick], self.length[pick])


@dataclass
class Group:
    """Rows with the same elements. ``data`` holds places in ``body``, which starts at ``origin`` for each row."""

    rows: np.ndarray
    syntax: str
    meta: list[Node]
    data: list[Node]
    content: np.ndarray
    body: np.ndarray
    origin: np.ndarray
    start: np.ndarray

    def find(self, tag: int) -> tuple[Node | None, np.ndarray, str]:
        """The root element, where its bytes are, and their order."""
        if tag >> 16 == 2:
            return next((n for n in self.meta if n.tag == tag), None), self.content, "<"
        return next((n for n in self.data if n.tag == tag and n.depth == 0 and n.kind in (VALUE, SEQUENCE)), None), self.body, ts.byte_order(self.syntax)


def parts(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded bytes of one column."""
    n, _, off = _buffer(b.column(column))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + PART_BYTES, "right")) - 1)
        yield b.slice(at, to - at)
        at = to


def _buffer(a: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of values, bytes and offsets of a binary array."""
    wide = a.type in (pa.large_binary(), pa.large_string())
    _, off, data = a.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1] if off is not None and off.size else np.zeros(len(a) + 1, np.int64)
    return len(a), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), o.astype(np.int64)


def _array(data: np.ndarray | bytes, lengths: np.ndarray) -> pa.Array:
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    a = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(data)])
    return a.cast(pa.binary()) if off[-1] < 1 << 31 else a


def cells(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Bytes at places, as a binary array."""
    n = len(start)
    if n == 0 or not length.any():
        return _array(b"", length)
    total = int(length.sum())
    if total > 512 * n:
        mem = memoryview(buf)
        return _array(b"".join(mem[s : s + k] for s, k in zip(start.tolist(), length.tolist(), strict=True)), length)
    if (length == length[0]).all():
        return _array(np.ascontiguousarray(buf[start[:, None] + np.arange(int(length[0]))]), length)
    before = np.cumsum(length) - length
    return _array(buf[np.repeat(start - before, length) + np.arange(total)], length)


def lengths(a: pa.Array) -> np.ndarray:
    return np.diff(_buffer(a)[2])


class _Walk:
    """Reads groups of rows in step, and splits them where they differ."""

    def __init__(self, content: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.content, self.start, self.end = content, start, end
        self.groups: list[Group] = []
        self.left: list[np.ndarray] = []

    def leave(self, rows: np.ndarray) -> None:
        if len(rows):
            self.left.append(rows)

    def meta(self, rows: np.ndarray) -> None:
        self.walk(rows, self.content, self.start[rows] + 132, self.end[rows], True, "<", [], None)

    def body(self, rows: np.ndarray, meta: list[Node], at: np.ndarray) -> None:
        """The dataset after the meta information, by transfer syntax."""
        if not meta:
            return self.leave(rows)
        uid = next((n for n in meta if n.tag == 0x00020010), None)
        texts = cells(self.content, uid.start, uid.length).to_pylist() if uid is not None else [b""] * len(rows)
        known = {x: i for i, x in enumerate(sorted(set(texts)))}
        kind = np.fromiter((known[x] for x in texts), np.int64, len(rows))
        for x, i in known.items():
            pick = np.flatnonzero(kind == i)
            v = ob.decode_value("UI", x, "<")
            syntax = ts.normalize(v[0]) if v else ts.EXPLICIT_LE
            if syntax not in SYNTAXES or len(pick) < LEAST:
                self.leave(rows[pick])
                continue
            own, r, begin, end = [n.of(pick) for n in meta], rows[pick], at[pick], self.end[rows[pick]]
            buf = self.content
            if syntax == ts.DEFLATED:
                got, good = [], []
                mem = memoryview(buf)
                for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                    try:
                        got.append(zlib.decompressobj(-15).decompress(mem[a:b]))
                        good.append(k)
                    except zlib.error:
                        self.leave(r[k : k + 1])
                g = np.array(good, np.int64)
                own, r = [n.of(g) for n in own], r[g]
                end = np.cumsum([len(x) for x in got], dtype=np.int64)
                begin = end - np.fromiter((len(x) for x in got), np.int64, len(got))
                buf = np.frombuffer(b"".join(got) + b"\0" * 16, np.uint8)
            state = (own, syntax, buf, begin if syntax == ts.DEFLATED else self.start[r])
            self.walk(r, buf, begin, end, syntax != ts.IMPLICIT_LE, ts.byte_order(syntax), [], state)

    def walk(self, rows: np.ndarray, buf: np.ndarray, at: np.ndarray, end: np.ndarray, explicit: bool, order: str, nodes: list[Node], state: tuple | None) -> None:
        work = [(np.arange(len(rows)), at, nodes, ((), (-1,)))]
        while work:
            idx, at, nodes, (stack, last) = work.pop()
            while True:
                if len(idx) < LEAST:
                    self.leave(rows[idx])
                    break
                stop = end[idx]
                over = at >= stop if state else at + 8 > stop
                if over.all():
                    self.close(rows[idx], idx, at, nodes, state, bool(stack))
                    break
                if over.any():
                    for p in (np.flatnonzero(over), np.flatnonzero(~over)):
                        work.append((idx[p], at[p], [n.of(p) for n in nodes], (stack, last)))
                    break
                h = buf[at[:, None] + np.arange(12)]
                half, full = h.view(order + "u2"), h.view(order + "u4")
                key = half[:, 0].astype(np.int64) << 32 | half[:, 1].astype(np.int64) << 16
                if explicit:
                    key |= h[:, 4].astype(np.int64) << 8 | h[:, 5]
                tag = int(key[0] >> 16)
                if state is None and tag >> 16 != 2 and not (key >> 32 == 2).any():
                    self.close(rows[idx], idx, at, nodes, state, False)
                    break
                vr = dd.vr_of(tag)
                if tag >> 16 == 0xFFFE:
                    key &= ~np.int64(0xFFFF)
                elif explicit:
                    vr = h[0, 4:6].tobytes().decode("latin-1")
                    vr = vr if vr in dd.ALL_VRS else "UN"
                if (key != key[0]).any():
                    for x in np.unique(key):
                        p = np.flatnonzero(key == x)
                        work.append((idx[p], at[p], [n.of(p) for n in nodes], (stack, last)))
                    break
                if tag >> 16 == 0xFFFE or not explicit:
                    n, v = full[:, 1].astype(np.int64), at + 8
                elif vr in ob.LONG_HEADER:
                    n, v = full[:, 2].astype(np.int64), at + 12
                else:
                    n, v = half[:, 3].astype(np.int64), at + 8
                none = np.zeros(len(idx), np.int64)
                open_, depth = n == ob.UNDEFINED, len(stack)
                if tag >> 16 == 0xFFFE:
                    top = stack[-1] if stack else None
                    kind = {(ob.ITEM, SEQUENCE): ITEM, (ob.ITEM_END, ITEM): ITEM_END, (ob.SEQ_END, SEQUENCE): SEQUENCE_END}.get((tag, top))
                    keep = v <= stop
                    if kind is None or state is None or kind == ITEM and not open_.all() or not keep.all():
                        self.leave(rows[idx])
                        break
                    stack, last = ((*stack, ITEM), (*last, -1)) if kind == ITEM else (stack[:-1], last[:-1] if kind == ITEM_END else last)
                    nodes.append(Node(tag, "", kind, depth if kind == ITEM else depth - 1, v, none))
                    at = v
                    continue
                sequence = vr == "SQ"
                if tag <= last[-1] or (stack and stack[-1] == SEQUENCE) or sequence and (state is None or not open_.all()):
                    self.leave(rows[idx])
                    break
                last = (*last[:-1], tag)
                if sequence:
                    nodes.append(Node(tag, vr, SEQUENCE, depth, v, none))
                    stack, at = (*stack, SEQUENCE), v
                    continue
                width = ob.WIDTH.get(vr) or (np.dtype("=" + ob.NUMBERS[vr]).itemsize if vr in ob.NUMBERS else 4 if vr == "AT" else 1)
                bad = open_ | (v + n > stop) | (n % width != 0)
                if bad.any():
                    self.leave(rows[idx[bad]])
                    p = np.flatnonzero(~bad)
                    nodes = [x.of(p) for x in nodes]
                    idx, v, n = idx[p], v[p], n[p]
                nodes.append(Node(tag, vr, VALUE, depth, v, n))
                at = v + n

    def close(self, rows: np.ndarray, idx: np.ndarray, at: np.ndarray, nodes: list[Node], state: tuple | None, inside: bool) -> None:
        if state is None:
            self.body(rows, nodes, at)
        elif inside:
            self.leave(rows)
        else:
            meta, syntax, buf, origin = state
            self.groups.append(Group(rows, syntax, [n.of(idx) for n in meta], nodes, self.content, buf, origin[idx], self.start[rows]))


def scan(a: pa.Array) -> tuple[list[Group], list[int]]:
    """Groups of rows that are alike, and the rows to be read one by one; nulls are among the latter."""
    n, data, off = _buffer(a)
    if n == 0:
        return [], []
    base = int(off[0])
    content = np.concatenate([data[base : int(off[-1])], np.zeros(16, np.uint8)])
    start, end = off[:-1] - base, off[1:] - base
    plain = end - start >= 136
    if a.null_count:
        plain &= a.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(plain)
    magic = (content[start[rows, None] + np.arange(128, 132)] == np.frombuffer(b"DICM", np.uint8)).all(axis=1)
    w = _Walk(content, start, end)
    w.leave(np.flatnonzero(~plain))
    w.leave(rows[~magic])
    w.meta(rows[magic])
    return w.groups, sorted(np.concatenate(w.left).tolist()) if w.left else []


# --- values ----------------------------------------------------------------------------


def texts(raw: pa.Array, vr: str) -> pa.Array:
    """Texts as ``decode_value`` reads them, several joined by backslashes; null for none."""
    try:
        s = raw.cast(pa.string())
        s.validate(full=True)
    except pa.ArrowInvalid:
        got = [ob.decode_value(vr, x, "<") for x in raw.to_pylist()]
        return pa.array([None if x is None else "\\".join(x) for x in got], pa.string())
    s = pc.ascii_rtrim(s, "\0" if vr == "UI" else " \0")
    s = pc.if_else(pc.equal(pc.binary_length(s), 0), pa.scalar(None, pa.string()), s)
    if vr in dd.TEXT_VRS:
        return s
    right = vr in _RIGHT_ONLY
    if not right:
        s = pc.ascii_trim(s, " ")
    if pc.any(pc.match_substring(s, "\\")).as_py():
        s = pc.replace_substring_regex(s, r" *\\" if right else r" *\\ *", r"\\")
    return s


def numbers(raw: pa.Array, vr: str, order: str) -> np.ndarray | None:
    """One number a row, if every row that isn't empty has one; empty rows give zero."""
    size = 4 if vr == "AT" else np.dtype("=" + ob.NUMBERS[vr]).itemsize
    k = lengths(raw)
    if not ((k == size) | (k == 0)).all():
        return None
    out = np.zeros(len(k), np.int64 if vr == "AT" else "=" + ob.NUMBERS[vr])
    _, data, off = _buffer(raw)
    v = data[int(off[0]) : int(off[-1])]
    if vr == "AT":
        h = v.view(order + "u2").reshape(-1, 2).astype(np.int64)
        out[k > 0] = h[:, 0] << 16 | h[:, 1]
    else:
        out[k > 0] = v.view(order + ob.NUMBERS[vr])
    return out


def column(g: Group, tag: int) -> pa.Array:
    """Texts of a root element for all rows of a group, as ``Object.text`` gives them."""
    node, buf, order = g.find(tag)
    if node is None or node.kind != VALUE or node.vr in dd.BULK_VRS:
        return pa.nulls(len(g.rows), pa.string())
    raw = cells(buf, node.start, node.length)
    if node.vr in dd.STRING_VRS or node.vr in dd.TEXT_VRS:
        return texts(raw, node.vr)
    v = numbers(raw, node.vr, order)
    if v is None:
        e = ob.Object()
        out = []
        for x in raw.to_pylist():
            e.data[0x00080000] = ob.Element(tag, node.vr, ob.decode_value(node.vr, x, order))
            out.append(e.text(0x00080000))
        return pa.array(out, pa.string())
    if node.vr == "AT":
        names = {x: dd.expression(x) for x in np.unique(v).tolist()}
        s = pa.array([names[x] for x in v.tolist()], pa.string())
    elif node.vr in ("FL", "FD"):
        s = pa.array([ob.number_text(x) for x in v.tolist()], pa.string())
    else:
        s = pa.array(v).cast(pa.string())
    return pc.if_else(pa.array(node.length > 0), s, pa.scalar(None, pa.string())) if not node.length.all() else s


# --- writing ---------------------------------------------------------------------------

Piece = bytes | pa.Array  # the same for all rows, or one value a row


def joined(pieces: list[Piece], n: int) -> pa.Array:
    """Pieces of each row one after another."""
    out: list = []
    for p in pieces:
        if isinstance(p, bytes) and out and isinstance(out[-1], bytes):
            out[-1] += p
        elif not isinstance(p, bytes) or p:
            out.append(p)
    big = sum(len(p) * n if isinstance(p, bytes) else p.nbytes for p in out) >= 1 << 31
    kind = pa.large_binary() if big else pa.binary()
    if all(isinstance(p, bytes) for p in out):
        return pa.array([b"".join(out)] * n, kind)
    if len(out) == 1:
        return out[0]
    return pc.binary_join_element_wise(*[pa.scalar(p, kind) if isinstance(p, bytes) else p.cast(kind) for p in out], pa.scalar(b"", kind))


def sizes(pieces: list[Piece], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for p in pieces:
        out += len(p) if isinstance(p, bytes) else lengths(p)
    return out


def _ints(v: np.ndarray, kind: str) -> pa.Array:
    a = np.ascontiguousarray(v.astype(kind))
    return _array(a.view(np.uint8), np.full(len(a), a.itemsize, np.int64))


def padded(raw: pa.Array, fill: bytes) -> pa.Array:
    odd = lengths(raw) % 2
    return joined([raw, _array(fill * int(odd.sum()), odd)], len(raw)) if odd.any() else raw


class Sheet:
    """Writes one dataset of every row as pieces, an element at a time, in the order of tags."""

    def __init__(self, n: int, syntax: str):
        self.n, self.explicit, self.order = n, syntax != ts.IMPLICIT_LE, ts.byte_order(syntax)
        self.pieces: list[Piece] = []
        self.failed = False

    def constant(self, e: ob.Element) -> None:
        w = ob.Writer(self.explicit, self.order)
        w.dataset({e.tag: e})
        self.pieces.append(b"".join(w.out))

    def mark(self, tag: int, vr: str, length: int) -> None:
        w = ob.Writer(self.explicit, self.order)
        w.head(tag, vr, length)
        self.pieces.append(b"".join(w.out))

    def wire(self, tag: int, vr: str, raw: pa.Array) -> None:
        """An element from its bytes in the sheet's own order, of even length."""
        k = lengths(raw)
        head = np.array([tag >> 16, tag & 0xFFFF], self.order + "u2").tobytes()
        if self.explicit:
            head += vr.encode() + (b"\0\0" if vr in ob.LONG_HEADER else b"")
        short = self.explicit and vr not in ob.LONG_HEADER
        if short and len(k) and k.max() > 0xFFFF:
            self.failed = True  # too long for this representation; the row by row way says so
            return
        kind = self.order + ("u2" if short else "u4")
        if len(k) and (k == k[0]).all():
            self.pieces += [head + np.array([k[0]], kind).tobytes(), *([raw] if k[0] else [])]
        else:
            self.pieces += [head, _ints(k, kind), raw]

    def text(self, tag: int, vr: str, s: pa.Array) -> None:
        raw = pc.fill_null(s, "").cast(pa.binary()) if s.null_count else s.cast(pa.binary())
        self.wire(tag, vr, padded(raw, b"\0" if vr == "UI" else b" "))

    def number(self, tag: int, vr: str, v: np.ndarray, there: np.ndarray | None = None) -> None:
        """One number a row; ``there`` marks the rows that have one."""
        if there is not None and not there.all():
            v = v[there]
            k = there.astype(np.int64)
        else:
            k = np.ones(self.n, np.int64)
        if vr == "AT":
            v = np.stack([v >> 16, v & 0xFFFF], 1).astype(self.order + "u2")
            size = 4
        else:
            v = v.astype(self.order + ob.NUMBERS[vr])
            size = v.itemsize
        self.wire(tag, vr, _array(np.ascontiguousarray(v).view(np.uint8), k * size))

    def bulk(self, tag: int, vr: str, raw: pa.Array, order: str = "<") -> None:
        width = ob.WIDTH.get(vr, 1)
        if width > 1 and order != self.order:
            if (lengths(raw) % width).any():
                self.failed = True
                return
            raw = swapped(raw, width)
        self.wire(tag, vr, padded(raw, b"\0"))

    def node(self, n: Node, buf: np.ndarray, order: str) -> None:
        """An element as it was read, from bytes of the given order."""
        if n.kind != VALUE:
            self.mark(n.tag, n.vr, ob.UNDEFINED if n.kind in (SEQUENCE, ITEM) else 0)
            return
        raw = cells(buf, n.start, n.length)
        if n.vr in dd.STRING_VRS or n.vr in dd.TEXT_VRS:
            self.text(n.tag, n.vr, texts(raw, n.vr))
        elif n.vr in dd.BULK_VRS:
            self.bulk(n.tag, n.vr, raw, order)
        else:
            width = 2 if n.vr == "AT" else np.dtype("=" + ob.NUMBERS[n.vr]).itemsize
            self.wire(n.tag, n.vr, swapped(raw, width) if order != self.order else raw)


def swapped(raw: pa.Array, width: int) -> pa.Array:
    _, data, off = _buffer(raw)
    v = data[int(off[0]) : int(off[-1])]
    return _array(np.ascontiguousarray(v.view(f"u{width}").byteswap().view(np.uint8)), np.diff(off))


def _first(s: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(s, r"(?s)\\.*", "")


def file(n: int, syntax: str, meta: dict[int, ob.Element | pa.Array], body: Sheet) -> pa.Array | None:
    """Files of meta information and datasets; texts of meta come as arrays, the rest as elements. None if a value doesn't fit."""
    head = Sheet(n, ts.EXPLICIT_LE)
    for t in sorted(meta):
        if isinstance(meta[t], ob.Element):
            head.constant(meta[t])
        else:
            head.text(t, dd.vr_of(t), meta[t])
    if head.failed or body.failed:
        return None
    size = Sheet(n, ts.EXPLICIT_LE)
    size.number(0x00020000, "UL", sizes(head.pieces, n))
    front: list[Piece] = [b"\0" * 128 + b"DICM", *size.pieces, *head.pieces]
    if syntax != ts.DEFLATED:
        return joined(front + body.pieces, n)
    out = []
    for x in joined(body.pieces, n).to_pylist():
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        x = z.compress(x) + z.flush()
        out.append(x + b"\0" * (len(x) % 2))
    return joined([*front, pa.array(out, pa.binary())], n)


def rewritten(g: Group, syntax: str | None = None, sets: dict[int, ob.Element] | None = None, removes: frozenset[int] = frozenset()) -> pa.Array | None:
    """The group's files in a transfer syntax without encapsulation, root elements replaced or left out; None for what isn't done by columns."""
    syntax, n = syntax or g.syntax, len(g.rows)
    body, sets = Sheet(n, syntax), sets or {}
    order = ts.byte_order(g.syntax)
    new, root, gone = sorted(t for t in sets if t not in removes), None, False
    for x in [*g.data, None]:
        if x is None or x.depth == 0 and x.kind in (VALUE, SEQUENCE):
            root = x.tag if x is not None else None
            while new and (root is None or new[0] <= root):
                body.constant(sets[new.pop(0)])
            gone = x is None or root in sets or root in removes or root & 0xFFFF == 0
        if not gone:
            body.node(x, g.body, order)
    meta: dict[int, ob.Element | pa.Array] = {}
    for x in g.meta:
        if x.vr in dd.STRING_VRS and dd.vr_of(x.tag) == x.vr:
            meta[x.tag] = texts(cells(g.content, x.start, x.length), x.vr)
        elif x.tag != 0x00020000:
            raw = cells(g.content, x.start, x.length)
            same = raw.unique().to_pylist()
            if len(same) > 1:
                return None
            meta[x.tag] = ob.Element(x.tag, x.vr, ob.decode_value(x.vr, same[0], "<"))
    meta.setdefault(0x00020001, ob.Element(0x00020001, "OB", b"\0\1"))
    for t, src in ((0x00020002, 0x00080016), (0x00020003, 0x00080018)):
        have = meta.get(t)
        if isinstance(have, ob.Element):
            return None
        if have is not None and not have.null_count:
            continue
        if src in removes:
            there: pa.Array = pa.nulls(n, pa.string())
        elif src in sets:
            e = sets[src]
            there = pa.array([e.value[0] if e.value else None] * n, pa.string())
        else:
            node, _, _ = g.find(src)
            if node is not None and node.vr not in dd.STRING_VRS:
                return None
            there = _first(column(g, src))
        meta[t] = there if have is None else pc.coalesce(have, there)
    meta[0x00020010] = ob.Element(0x00020010, "UI", [syntax])
    meta.setdefault(0x00020012, ob.Element(0x00020012, "UI", [ob.IMPLEMENTATION_UID]))
    return file(n, syntax, meta, body)


def encoded(n: int, columns: dict[int, pa.Array], constants: dict[int, object], syntax: str) -> pa.Array | None:
    """Files of objects built from columns and constants; None for what isn't done by columns."""
    if syntax not in SYNTAXES or any(t >> 16 == 2 for t in (*columns, *constants)):
        return None
    body = Sheet(n, syntax)
    fixed = ob.build({t: v for t, v in constants.items() if t not in columns}, syntax).data
    for t in sorted({*columns, *fixed}):
        if t & 0xFFFF == 0:
            continue
        if t in fixed:
            body.constant(fixed[t])
        elif not _put(body, t, columns[t]):
            return None
    meta: dict[int, ob.Element | pa.Array] = {0x00020001: ob.Element(0x00020001, "OB", b"\0\1"), 0x00020010: ob.Element(0x00020010, "UI", [syntax]), 0x00020012: ob.Element(0x00020012, "UI", [ob.IMPLEMENTATION_UID])}
    for t, src in ((0x00020002, 0x00080016), (0x00020003, 0x00080018)):
        if src in columns and not pa.types.is_string(columns[src].type):
            return None
        e = fixed.get(src)
        meta[t] = columns[src] if src in columns else ob.Element(t, "UI", [e.value[0]] if e and e.value else None)
    return file(n, syntax, meta, body)


def _put(sheet: Sheet, tag: int, a: pa.Array) -> bool:
    """Adds an element from a column; False if this kind of column is left to the row by row way."""
    vr, kind = dd.vr_of(tag), a.type
    if vr == "SQ":
        return _put_sequence(sheet, tag, a)
    if vr in dd.STRING_VRS or vr in dd.TEXT_VRS:
        if pa.types.is_list(kind) and pa.types.is_string(kind.value_type):
            if a.flatten().null_count:
                return False
            a = pc.binary_join(a, "\\")
        elif pa.types.is_integer(kind):
            a = a.cast(pa.string())
        elif pa.types.is_float64(kind):
            a = pa.array([None if x is None else ob.number_text(x) for x in a.to_pylist()], pa.string())
        elif not pa.types.is_string(kind):
            return False
        sheet.text(tag, vr, a)
    elif vr in dd.BULK_VRS:
        if not pa.types.is_binary(kind):
            return False
        sheet.bulk(tag, vr, pc.fill_null(a, b"") if a.null_count else a)
    else:
        real = vr in ("FL", "FD")
        if not (pa.types.is_integer(kind) or real and pa.types.is_float64(kind)):
            return False
        there = a.is_valid().to_numpy(zero_copy_only=False)
        v = pc.fill_null(a, 0).to_numpy(zero_copy_only=False)
        if not real:
            least, most = (0, (1 << 32) - 1) if vr == "AT" else (lambda i: (int(i.min), int(i.max)))(np.iinfo(ob.NUMBERS[vr]))
            if len(v) and not (least <= int(v.min()) and int(v.max()) <= most):
                return False
            v = v.astype(np.uint64 if vr == "UV" else np.int64)
        elif vr == "FL" and (np.abs(v[np.isfinite(v)]) > np.finfo(np.float32).max).any():
            return False
        sheet.number(tag, vr, v, there)
    return True


def _put_sequence(sheet: Sheet, tag: int, a: pa.Array) -> bool:
    """A sequence from a column of arrays of structs whose fields are keywords."""
    if not pa.types.is_list(a.type) or not pa.types.is_struct(a.type.value_type):
        return False
    items = a.flatten()
    names = {f.name: dd.BY_KEYWORD.get(f.name) for f in items.type}
    if items.null_count or None in names.values() or any(t >> 16 == 2 or dd.vr_of(t) == "SQ" for t in names.values()):
        return False
    inner = Sheet(len(items), ts.EXPLICIT_LE)
    inner.explicit, inner.order = sheet.explicit, sheet.order
    inner.mark(ob.ITEM, "", ob.UNDEFINED)
    for name, t in sorted(names.items(), key=lambda x: x[1]):
        f = pc.struct_field(items, name)
        if pa.types.is_integer(f.type) and dd.vr_of(t) in dd.STRING_VRS | dd.TEXT_VRS or pa.types.is_float64(f.type) and dd.vr_of(t) not in ("FL", "FD") or not _put(inner, t, f):
            return False
    inner.mark(ob.ITEM_END, "", 0)
    if inner.failed:
        return False
    size = np.concatenate([[0], np.cumsum(sizes(inner.pieces, len(items)))]).astype(np.int64)
    there = a.is_valid().to_numpy(zero_copy_only=False)
    count = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.cumsum(np.where(there, count, 0))
    _, data, off = _buffer(joined(inner.pieces, len(items)))
    sheet.mark(tag, "SQ", ob.UNDEFINED)
    if len(items):
        sheet.pieces.append(_array(np.ascontiguousarray(data[int(off[0]) : int(off[-1])]), size[last] - size[last - count]))
    sheet.mark(ob.SEQ_END, "", 0)
    return True


def merged(n: int, got: list[tuple[np.ndarray, pa.Array]], kind: pa.DataType) -> pa.Array:
    """Arrays of some rows each, put together in the order of rows."""
    got = [(r, a) for r, a in got if len(r)]
    if not got:
        return pa.nulls(n, kind)
    if len(got) == 1 and len(got[0][0]) == n:
        return got[0][1].cast(kind)
    rows = np.concatenate([np.asarray(r, np.int64) for r, _ in got])
    at = np.empty(n, np.int64)
    at[rows] = np.arange(len(rows))
    return pa.concat_arrays([a.cast(kind) for _, a in got]).take(pa.array(at))
