"""Synthetic objects: an X-ray-like, a CT-like and a colour one."""

import numpy as np

from lumenframe.functions import tsyntax as ts
from lumenframe.operators import transcode as tc
from lumenframe.sources import objects as ob


def dx(rows=32, columns=40, bits=16, stored=12, **more):
    r = np.random.default_rng(1)
    v = r.integers(0, 1 << stored, rows * columns)
    raw = np.packbits(v.astype(np.uint8)).tobytes() if bits == 1 else v.astype(f"<u{bits // 8}").tobytes()
    base = {
        "SOPClassUID": ts.DIGITAL_XRAY, "SOPInstanceUID": "2.25.1", "Modality": "DX", "PatientName": "Doe^Jane", "StudyDescription": "CHEST", "Rows": rows, "Columns": columns, "SamplesPerPixel": 1,
        "PhotometricInterpretation": "MONOCHROME2", "BitsAllocated": bits, "BitsStored": stored, "HighBit": stored - 1, "PixelRepresentation": 0, "PixelData": raw, 0x00130010: "ACME", 0x00131010: "private text",
    }
    return ob.build(base | more, vrs={0x00131010: "LO"})


def ct():
    item = ob.build({"RequestedProcedureID": "R1"}).data
    r = np.random.default_rng(2)
    v = r.integers(-1000, 1000, 2 * 16 * 16).astype("<i2").tobytes()
    o = dx(16, 16, 16, 16, Modality="CT", NumberOfFrames="2", PixelRepresentation=1, RescaleSlope="1", RescaleIntercept="-1024", WindowCenter="40\\80", WindowWidth="400\\200", PixelData=v, RequestAttributesSequence=[item, item])
    return tc.transcode(o, ts.RLE)


def sc(planar=0, rows=9, columns=7):
    v = np.random.default_rng(3).integers(0, 256, rows * columns * 3).astype(np.uint8).tobytes()
    return dx(rows, columns, 8, 8, Modality="OT", SamplesPerPixel=3, PhotometricInterpretation="RGB", PlanarConfiguration=planar, PixelData=v + b"\0" * (len(v) % 2))
