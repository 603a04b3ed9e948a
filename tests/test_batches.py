"""Batches read and written by columns give what the row by row code gives."""

import json
import random

import pyarrow as pa
import pytest
from fixtures import ct, dx, sc

from lumenframe.functions import docbatches as db
from lumenframe.functions import documents as docs
from lumenframe.functions import tsyntax as ts
from lumenframe.operators import tables
from lumenframe.operators import transcode as tc
from lumenframe.sources import batches as bt
from lumenframe.sources import objects as ob

TAGS = [docs.parse_key(k) for k in "SOPInstanceUID PatientID StudyDescription SelectorCSValue TextValue SelectorFDValue SelectorUSValue SelectorSVValue SelectorATValue SelectorFLValue EncapsulatedDocument SelectorUCValue RequestAttributesSequence TransferSyntaxUID".split()]


def values(i, r):
    t = lambda: r.choice(["", "a", " ab ", "x\\y", " x \\ y \\", "é\\ü ", "abc\0", None, "longer text"])
    v = {"SOPInstanceUID": r.choice([f"2.25.{i}", "1.2\\3.4", None]), "PatientID": t(), "StudyDescription": t(), "SelectorCSValue": t(), "TextValue": t(), "SelectorUCValue": t(), "SelectorUSValue": i, "SelectorSVValue": -i << 32, "SelectorATValue": 0x00100020 + i % 3}
    v |= {"SelectorFDValue": r.choice([1.5, float(i), 1e300, -0.0, None, float("nan")]) if i % 2 else [1.0, 2.5], "SelectorFLValue": r.choice([0.1, None]), "EncapsulatedDocument": r.choice([b"ab", b"abc", None]), "SelectorOWValue": b"abcd"}
    return v


@pytest.fixture(scope="module")
def files():
    r, out = random.Random(1), []
    for i in range(800):
        v = values(i, r)
        if i % 3 == 0:
            v["RequestAttributesSequence"] = [ob.build({"CodeValue": "x", "CodeMeaning": None}).data for _ in range(i % 2 + 1)]
        out.append(ob.write(ob.build(v, (ts.EXPLICIT_LE, ts.EXPLICIT_BE, ts.IMPLICIT_LE, ts.DEFLATED)[i % 4])))
    for i in range(0, 300, 3):
        at = r.randrange(140, len(out[i]))
        out += [out[i][:at], out[i][:at] + bytes([r.randrange(256)]) + out[i][at + 1 :]]
    return [*out, ob.write(dx()), ob.write(ct()), ob.write(sc()), None, b"", b"junk" * 100]


def test_groups(files):
    groups, left = bt.scan(pa.array(files, pa.binary()))
    assert sorted([*left, *(int(i) for g in groups for i in g.rows)]) == list(range(len(files))) and sum(len(g.rows) for g in groups) > 500
    sets, removes = ["PatientName=Doe^J", "StudyDescription=x", "(0008,1030)=URGENT", "SOPInstanceUID=9.9"], ["PatientID", "RequestAttributesSequence", "PatientSex"]
    new, gone = docs.override(ob.Object(), sets).data, frozenset(map(docs.parse_key, removes))
    for g in groups:
        rows = [files[i] for i in g.rows]
        for t in TAGS:
            assert bt.column(g, t).to_pylist() == [ob.parse(x).text(t) for x in rows]
        for uid in bt.SYNTAXES:
            assert bt.rewritten(g, uid).to_pylist() == [ob.write(tc.transcode(ob.parse(x), uid)) for x in rows]
        assert bt.rewritten(g, None, new, gone).to_pylist() == [ob.write(docs.override(ob.parse(x), sets, removes)) for x in rows]
        for only in (None, frozenset([TAGS[1], TAGS[4], 0x00080100, 0x00400275])):
            got = tables.element_columns(g, only)
            if got is not None:
                assert repr(list(zip(*[c.to_pylist() for c in got], strict=True))) == repr([y for x in rows for y in tables.element_rows(ob.parse(x, "auto", only), only)])
        for form, keys in (("flat", "name"), ("flat", "hex"), ("standard", "name")):
            got = db.written(g, form, keys)
            if got is not None:
                assert got.to_pylist() == [docs.write_json(ob.parse(x), form, keys) for x in rows]


@pytest.mark.parametrize("form", ["flat", "standard"])
def test_documents(form):
    r, known = random.Random(2), []
    for i in range(200):
        known.append(docs.write_json(ob.build({k: v for k, v in (values(i, r) | {"SOPInstanceUID": f"2.25.{i}"}).items() if i < 100 or v is not None}), form))
    odd = [json.dumps(json.loads(x) | {("PatientID" if form == "flat" else "00100020"): y}) for x in known[:40] for y in (5, ["x"], {"vr": "LO", "Value": ["a", "b"]}, {"vr": "ZZ"})]
    for rows in (known[:100], known + odd + [None, "junk", "[]"]):
        for uid in (None, ts.EXPLICIT_BE, ts.DEFLATED):
            done, left = db.read(pa.array(rows, pa.string()), form, uid)
            assert sorted([*left, *(int(i) for k, _ in done for i in k)]) == list(range(len(rows)))
            assert len(rows) > 100 or not left
            for k, got in done:
                assert got.to_pylist() == [ob.write(docs.read_json(rows[i], form), uid) for i in k]


def test_rows_alike_go_by_columns():
    a = bt.encoded(50, {0x00080018: pa.array([f"2.25.{i}" for i in range(50)]), 0x00720072: pa.array([i + 0.5 for i in range(50)]), 0x00720062: pa.array([["A", "B"], None] * 25)}, {0x00080060: "OT"}, ts.EXPLICIT_BE)
    assert a.to_pylist() == [ob.write(ob.build({"SOPInstanceUID": f"2.25.{i}", "SelectorFDValue": i + 0.5, "SelectorCSValue": None if i % 2 else ["A", "B"], "Modality": "OT"}, ts.EXPLICIT_BE)) for i in range(50)]
    groups, left = bt.scan(a)
    assert not left and len(groups) == 1
    codes = pa.array([[{"CodeValue": "O", "CodeMeaning": None}] * (i % 3) if i % 4 else None for i in range(50)], pa.list_(pa.struct([("CodeValue", pa.string()), ("CodeMeaning", pa.string())])))
    b = bt.encoded(50, {0x00400275: codes}, {}, ts.IMPLICIT_LE)
    assert b.to_pylist() == [ob.write(ob.build({0x00400275: None if x is None else [ob.build(y).data for y in x]}, ts.IMPLICIT_LE)) for x in codes.to_pylist()]
    assert bt.encoded(2, {0x0072007A: pa.array([1, 70000])}, {}, ts.EXPLICIT_LE) is None
