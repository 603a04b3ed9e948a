import json

import numpy as np
import pytest
from fixtures import ct, dx, sc
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.functions import dictionary as dd
from lumenframe.functions import documents as docs
from lumenframe.functions import tsyntax as ts
from lumenframe.functions.errors import ObjectError
from lumenframe.operators import images
from lumenframe.operators import pixels as px
from lumenframe.operators import transcode as tc
from lumenframe.sources import objects as ob

J2K = min(ts.JPEG2000)
NATIVE = [ts.IMPLICIT_LE, ts.EXPLICIT_LE, ts.EXPLICIT_BE, ts.DEFLATED]


def values(o):
    def plain(e):
        return [{t: plain(x) for t, x in i.items()} for i in e.value or ()] if e.vr == "SQ" else e.value

    return {t: plain(e) for t, e in o.data.items()}


@pytest.mark.parametrize("uid", NATIVE)
@pytest.mark.parametrize("make", [dx, sc])
def test_native_round_trips(uid, make):
    o = make()
    back = ob.parse(ob.write(tc.transcode(o, uid)), "always")
    assert back.syntax == uid
    if uid == ts.IMPLICIT_LE:  # private elements have no representation there
        back.data[0x00131010].value = [back.data[0x00131010].value.decode()]
    assert values(back) == values(o)


@pytest.mark.parametrize("uid", [ts.RLE, ts.ENCAPSULATED_LE])
@pytest.mark.parametrize("make", [dx, sc, lambda: sc(1), lambda: dx(8, 8, 8, 8), lambda: tc.transcode(ct(), ts.EXPLICIT_LE)])
def test_encapsulated_round_trips(uid, make):
    o = make()
    there = ob.parse(ob.write(tc.transcode(o, uid)))
    assert tc.pixel_kind(there) == "encapsulated"
    back = tc.transcode(there, ts.EXPLICIT_LE)
    m = px.read_meta(o)
    for k in range(m.frames):
        a, b = (px.samples(px.frame_bytes(px.native_bytes(x), px.read_meta(x), k), px.read_meta(x)) for x in (o, back))
        if m.samples == 3 and m.planar == 1 and px.read_meta(back).planar == 0 and uid == ts.RLE:
            a = a.reshape(3, -1).T.ravel()
        assert (a == b).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_rle(data):
    x = images.rle_encode([data])
    assert images.rle_decode(x, len(data)) == [data]


def test_capabilities_and_refusals():
    t = {c.uid: c for c in ts.capabilities()}
    assert list(t) == sorted(t) and t[ts.RLE].can_transcode_to and not t[J2K].can_transcode_to
    assert t[min(ts.MPEG)].claimed_decode and not t[min(ts.MPEG)].implemented
    with pytest.raises(ObjectError, match="unsupported target transfer syntax"):
        tc.transcode(dx(), J2K)
    with pytest.raises(ObjectError, match="unknown transfer syntax"):
        tc.transcode(dx(), "1.2.3")
    o = dx()
    o.meta[0x00020010].value = ["1.2.3 "]
    assert tc.transcode(o, "1.2.3") is o  # the same syntax, even if unknown


def test_preamble_and_damage():
    raw = ob.write(dx())
    assert ob.parse(raw[132:]).syntax == ts.EXPLICIT_LE
    for bad in (b"", b"NOTADICOMFILE", raw[:200], raw[:-10]):
        with pytest.raises(ObjectError):
            ob.parse(bad, "always")


def test_flat_json():
    o, raw = dx(), ob.write(dx())
    d = json.loads(docs.write_json(o))
    assert d["Modality"] == "DX" and d["Rows"] == 32 and d["00131010"] == {"vr": "LO", "Value": "private text"} and set(d["PixelData"]) == {"InlineBinary"}
    assert values(docs.read_json(docs.write_json(o))) == values(o)
    h = json.loads(docs.write_json(o, keys="hex"))
    assert h["00080060"] == "DX" and h["00020010"] == ts.EXPLICIT_LE
    u = docs.write_json(ob.parse(raw), bulk="uri", source=raw, base="file://x")
    assert json.loads(u)["PixelData"]["BulkDataURI"].startswith("file://x?offset=")
    assert values(docs.read_json(u, source=raw)) == values(o)
    with pytest.raises(ObjectError) as e:
        docs.read_json(u)
    assert e.value.code == "MissingBulkDataSource"


def test_encapsulated_and_sequences_in_json():
    o = ct()
    raw = ob.write(o)
    for bulk in ("inline", "uri"):
        for form in ("flat", "standard"):
            back = docs.read_json(docs.write_json(ob.parse(raw), form, bulk=bulk, source=raw), form, raw)
            assert back.data[ob.PIXELS].value.parts == o.data[ob.PIXELS].value.parts
            assert len(back.data[0x00400275].value) == 2 and back.syntax == ts.RLE


def test_standard_json():
    d = json.loads(docs.write_json(dx(), "standard"))
    assert d["00080060"] == {"vr": "CS", "Value": ["DX"], "Keyword": "Modality", "VM": 1}
    assert d["00100010"]["Value"] == [{"Alphabetic": "Doe^Jane"}] and d["7FE00010"]["VM"] == 1
    assert values(docs.read_json(docs.write_json(dx(), "standard"), "standard")) == values(dx())


@pytest.mark.parametrize(
    "doc,code",
    [
        ("[]", "InvalidJsonRoot"), ("{", "Json"), ('{"Nope":1}', "UnknownAttribute"), ('{"00131010":{"vr":"??","Value":1}}', "InvalidVr"), ('{"PixelData":{"InlineBinary":"a!"}}', "InvalidBase64"),
        ('{"PixelData":{"BulkDataURI":"?offset=1&length=2"}}', "MissingBulkDataSource"), ('{"PixelData":"x"}', "InvalidValue"), ('{"RequestAttributesSequence":"x"}', "InvalidValue"), ('{"PixelData":{"InlineBinary":"AAAA"}}', "InvalidBulkDataLength"),
        ('{"Rows":70000}', "InvalidValue"), ('{"Rows":"a"}', "InvalidValue"),
    ],
)
def test_broken_documents(doc, code):
    with pytest.raises(ObjectError) as e:
        docs.read_json(doc)
    assert e.value.code == code


def test_bulk_uris():
    assert docs.parse_bulk_uri("http://h/p?offset=5&x=1&length=7&offset=6") == (6, 7)
    assert docs.parse_bulk_uri("offset=5&length=7") == (5, 7)
    for bad in ("?offset=5", "?offset=a&length=1", "?offset=1&length=2&length=x", ""):
        with pytest.raises(ObjectError):
            docs.parse_bulk_uri(bad)
    with pytest.raises(ObjectError) as e:
        docs.Source(b"abc").slice(2, 2)
    assert e.value.code == "BulkDataOutOfRange"


def test_locator_agrees_with_the_parser():
    for o in (dx(), ct(), sc()):
        raw = ob.write(o)
        at = ob.locate(raw)
        for e in ob.parse(raw).elements():
            assert at[e.tag] == (e.offset, e.length)


def test_overrides():
    o = docs.override(dx(), ["PatientName= A^B", "Rows=7", "StudyDescription=a\\b"], ["Modality", "PatientSex"])
    assert (o.text(0x00100010), o.text(0x00280010), o.data[0x00081030].value, 0x00080060 in o.data) == (" A^B", "7", ["a", "b"], False)
    for bad in ("PatientName", "Nope=1", "RequestAttributesSequence=1", "00131010=x"):
        with pytest.raises(ObjectError):
            docs.parse_set(bad)


def test_keys():
    assert dd.parse_tag("(0008,0060)") == dd.parse_tag("0008,0060") == dd.parse_tag("00080060") == dd.parse_tag("Modality") == 0x00080060
    assert dd.parse_tag("0008006") is None and dd.flat_key(0x00080060) == "Modality" and dd.flat_key(0x60003000) == "60003000"


# --- pixels ----------------------------------------------------------------------------


def test_window_fallbacks_equal_no_window():
    o = dx()
    plain = tc.render_frames(o, px.Options(voi_lut=False))
    for opt in (px.Options(window_center=90_000, window_width=10), px.Options(window_center=100)):
        assert tc.render_frames(o, opt) == plain
    assert tc.render_frames(dx(WindowCenter="100", WindowWidth="0"), px.Options()) == plain
    with pytest.raises(ObjectError, match="window width must be greater than zero"):
        tc.render_frames(o, px.Options(window_center=1, window_width=0))
    with pytest.raises(ObjectError):
        tc.render_frames(o, px.Options(window_width=1))


def test_window_values():
    v = np.arange(0, 101, dtype=float)
    got = px.window(v, 50.0, 51.0)
    assert got[0] == 0 and got[-1] == 255 and got[50] == int(((50 - 49.5) / 50 + 0.5) * 255)
    assert (px.normalize(np.full(5, 3.0)) == 0).all()


def test_image_formats():
    r = tc.render_frames(dx(), px.Options(format="png"))[0]
    assert r[:5] == (40, 32, 1, 8, "png") and r[5][:8] == b"\x89PNG\r\n\x1a\n"
    j = tc.render_frames(sc(), px.Options(format="jpeg", quality=500))[0]
    assert j[5][:2] == b"\xff\xd8" and j[5][-2:] == b"\xff\xd9"
    raw = tc.render_frames(dx(), px.Options(format="raw"))[0]
    assert len(raw[5]) == 32 * 40 * 2
    with pytest.raises(ObjectError):
        tc.render_frames(dx(), px.Options(format="raw", boxes=(px.Box(0, 0, 1, 1),)))
    assert len(tc.render_frames(ct(), px.Options(), every=True)) == 2
    with pytest.raises(ObjectError):
        tc.render_frames(ct(), px.Options(frame=2))


def test_jpeg_decodes_close_to_the_original():
    """A decoder of just what the encoder writes."""
    x = np.add.outer(np.arange(24), np.arange(16)).astype(np.uint8)[..., None] * 5
    data = images.jpeg(x, 95)
    at, tables = 2, {}
    quant = None
    while True:
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            quant = np.array(list(body[1:]))
        if marker == 0xC4:
            code, k, t = 0, 17, {}
            for size, c in enumerate(body[1:17], 1):
                for _ in range(c):
                    t[size, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = t
        if marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    pos = 0

    def symbol(t):
        nonlocal pos
        code = size = 0
        while True:
            code, size, pos = code << 1 | int(bits[pos]), size + 1, pos + 1
            if (size, code) in t:
                return t[size, code]

    def number(n):
        nonlocal pos
        v = int(bits[pos : pos + n], 2) if n else 0
        pos += n
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    out, dc = np.zeros((24, 16)), 0
    for by in range(3):
        for bx in range(2):
            z = np.zeros(64)
            dc += number(symbol(tables[0]))
            z[0], k = dc, 1
            while k < 64:
                s = symbol(tables[16])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    z[k] = number(s & 15)
                k += 1
            f = np.zeros(64)
            f[images._ZIGZAG] = z * quant
            c = images._cosines()
            out[by * 8 : by * 8 + 8, bx * 8 : bx * 8 + 8] = c.T @ f.reshape(8, 8) @ c + 128
    assert np.abs(out - x[..., 0]).max() < 4


@pytest.mark.parametrize("box,want", [("-20,-15,50%,20", (20, 40, 17, 32)), ("-0,0,5,5", (40, 40, 0, 5)), ("3,4,5,6", (3, 8, 4, 10)), ("100,0,1,100%", (40, 40, 0, 32)), ("0,0,300%,1", (0, 40, 0, 1))])
def test_boxes(box, want):
    assert px.clamped(px.parse_box(box), 40, 32) == want


def test_redaction():
    o = tc.redact(dx(), (px.parse_box("1,2,16,16"),), (255, 0, 0))
    a = np.frombuffer(px.native_bytes(dx()), "<u2").reshape(32, 40)
    b = np.frombuffer(px.native_bytes(o), "<u2").reshape(32, 40)
    inside = np.zeros((32, 40), bool)
    inside[2:18, 1:17] = True
    assert (b[inside] == px.scale_to_depth(54, 12)).all() and (a[~inside] == b[~inside]).all()
    p = np.frombuffer(px.native_bytes(tc.redact(sc(1), (px.parse_box("0,0,2,2"),), (12, 34, 56))), np.uint8)[:189].reshape(3, 9, 7)
    assert (p[:, :2, :2] == np.array([12, 34, 56])[:, None, None]).all()
    one = dx(8, 8, 1, 1)
    assert np.unpackbits(np.frombuffer(px.native_bytes(tc.redact(one, (px.parse_box("0,0,8,1"),), (255, 255, 255))), np.uint8))[:8].all()
    for bad in ("1,2,3", "a,0,1,1", "0,0,-1,1", "0,0,-5%,1"):
        with pytest.raises(ObjectError):
            px.parse_box(bad)
    assert px.parse_color("#0102ff") == (1, 2, 255) and px.parse_color("1, 2,3") == (1, 2, 3)
    for bad in ("1,2", "256,0,0", "#12345"):
        with pytest.raises(ObjectError):
            px.parse_color(bad)


def test_sizes_and_resize():
    assert px.output_size(40, 32, None, None, 20) == (20, 16) and px.output_size(40, 32, 10, None, None) == (10, 8) and px.output_size(40, 32, None, 64, None) == (80, 64)
    assert px.output_size(40, 32, 5, 6, None) == (5, 6) and px.output_size(40, 32, 5, None, 6) is None and px.output_size(1000, 1, 1, None, None) == (1, 1)
    f = px.resize(px.Frame(8, 8, 1, np.full((8, 8, 1), 77, np.uint8)), px.Options(width=3, height=20))
    assert f.pixels.shape == (20, 3, 1) and (f.pixels == 77).all()


def test_frame_rate():
    rate = lambda **k: px.default_fps(ob.build(k))
    assert rate(CineRate="15") == 15 and rate(FrameTime="40") == 25 and rate(FrameTimeVector=["20", "-1", "60"]) == 25
    assert rate(RecommendedDisplayFrameRate="0", CineRate="15") is None and rate() is None and rate(RecommendedDisplayFrameRateInFloat=7.5, CineRate="1") == 7.5


def test_render_to_object():
    o = tc.render_object(ct(), px.Options(), ts.EXPLICIT_LE)
    m = px.read_meta(o)
    assert (m.allocated, m.stored, m.signed, m.photometric, m.frames) == (8, 8, False, "MONOCHROME2", 2)
    want = tc.render_frames(ct(), px.Options(), every=True)
    assert images.png(px.render_values(o, m, px.samples(px.frame_bytes(px.native_bytes(o), m, 0), m), px.Options(voi_lut=False)))[:8] == want[0][5][:8]
    assert tc.pixel_kind(tc.render_object(sc(), px.Options(), ts.JPEG_BASELINE)) == "encapsulated"


def test_names():
    assert px.frame_path("a/b.png", 3) == "a/b_000003.png" and px.frame_path("b", 1) == "b_000001"
