"""Transfer syntaxes: what they are, and what this engine reads, decodes and encodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenframe.functions.errors import fail

IMPLICIT_LE = "1.2.840.10008.1.2"
EXPLICIT_LE = "1.2.840.10008.1.2.1"
EXPLICIT_BE = "1.2.840.10008.1.2.2"
DEFLATED = "1.2.840.10008.1.2.1.99"
ENCAPSULATED_LE = "1.2.840.10008.1.2.1.98"
RLE = "1.2.840.10008.1.2.5"
_J = "1.2.840.10008.1.2.4."
JPEG_BASELINE = "1.2.840.10008.1.2.4.50"
#: Classes of images without an acquisition of their own, and of projection X-ray.
SECONDARY_CAPTURE = "1.2.840.10008.5.1.4.1.1.7"
DIGITAL_XRAY = "1.2.840.10008.5.1.4.1.1.1.1"
JPEG2000, JPEG_LS, MPEG = frozenset([_J + "90", _J + "91"]), frozenset([_J + "80", _J + "81"]), frozenset(_J + str(k) for k in range(100, 109))

_NAMES = {
    IMPLICIT_LE: "Implicit VR Little Endian",
    EXPLICIT_LE: "Explicit VR Little Endian",
    ENCAPSULATED_LE: "Encapsulated Uncompressed Explicit VR Little Endian",
    DEFLATED: "Deflated Explicit VR Little Endian",
    EXPLICIT_BE: "Explicit VR Big Endian",
    JPEG_BASELINE: "JPEG Baseline (Process 1)",
    _J + "51": "JPEG Extended (Process 2 & 4)",
    _J + "57": "JPEG Lossless (Process 14)",
    _J + "70": "JPEG Lossless (Process 14, Selection Value 1)",
    _J + "80": "JPEG-LS Lossless",
    _J + "81": "JPEG-LS Near-Lossless",
    _J + "90": "JPEG 2000 Lossless",
    _J + "91": "JPEG 2000",
    _J + "92": "JPEG 2000 Multi-component Lossless",
    _J + "93": "JPEG 2000 Multi-component",
    _J + "100": "MPEG2 Main Profile / Main Level",
    _J + "101": "MPEG2 Main Profile / High Level",
    _J + "102": "MPEG-4 AVC/H.264 High Profile / Level 4.1",
    _J + "103": "MPEG-4 AVC/H.264 BD-compatible High Profile / Level 4.1",
    _J + "104": "MPEG-4 AVC/H.264 High Profile / Level 4.2 For 2D Video",
    _J + "105": "MPEG-4 AVC/H.264 High Profile / Level 4.2 For 3D Video",
    _J + "106": "MPEG-4 AVC/H.264 Stereo High Profile / Level 4.2",
    _J + "107": "HEVC/H.265 Main Profile / Level 5.1",
    _J + "108": "HEVC/H.265 Main 10 Profile / Level 5.1",
    RLE: "RLE Lossless",
}
#: What the reference announces; its MPEG and JPEG-LS entries always fail there.
_CLAIM_DECODE = {ENCAPSULATED_LE, RLE, JPEG_BASELINE, _J + "51", _J + "57", _J + "70"} | JPEG_LS | MPEG | JPEG2000
_CLAIM_ENCODE = {ENCAPSULATED_LE, JPEG_BASELINE} | JPEG_LS | MPEG
_CAN_DECODE, _CAN_ENCODE = {ENCAPSULATED_LE, RLE}, {ENCAPSULATED_LE, RLE, JPEG_BASELINE}


def normalize(uid: str) -> str:
    return uid.rstrip(" \t\r\n\x0b\x0c\x00")


def is_encapsulated(uid: str) -> bool:
    return normalize(uid) not in (IMPLICIT_LE, EXPLICIT_LE, EXPLICIT_BE, DEFLATED)


def byte_order(uid: str) -> str:
    return ">" if normalize(uid) == EXPLICIT_BE else "<"


def dataset_encoding(uid: str) -> tuple[bool, str]:
    """Whether value representations are explicit, and the byte order, as the bulk locator sees it."""
    u = normalize(uid)
    if u == IMPLICIT_LE:
        return False, "<"
    if u == EXPLICIT_BE:
        return True, ">"
    if u in (EXPLICIT_LE, DEFLATED, RLE) or u.startswith(_J):
        return True, "<"
    raise fail("UnsupportedTransferSyntax", f"unsupported transfer syntax {u} for bulk data lookup")


@dataclass(frozen=True)
class Capability:
    uid: str
    name: str
    encapsulated: bool
    can_read_dataset: bool
    can_write_dataset: bool
    can_decode_pixel_data: bool
    can_encode_pixel_data: bool
    can_transcode_to: bool
    engine: str
    implemented: bool
    claimed_decode: bool
    claimed_encode: bool


def capability(uid: str) -> Capability | None:
    u = normalize(uid)
    if u not in _NAMES:
        return None
    enc = is_encapsulated(u)
    dec, cod = not enc or u in _CAN_DECODE, not enc or u in _CAN_ENCODE
    return Capability(u, _NAMES[u], enc, True, True, dec, cod, cod, "n/a" if not enc else "builtin" if dec or cod else "unavailable", dec or cod, not enc or u in _CLAIM_DECODE, not enc or u in _CLAIM_ENCODE)


def capabilities() -> list[Capability]:
    return sorted((capability(u) for u in _NAMES), key=lambda c: c.uid)


def transfer_syntaxes(spark: SparkSession) -> DataFrame:
    """The capability table, ordered by uid."""
    fields = "uid string, name string, encapsulated boolean, can_read_dataset boolean, can_write_dataset boolean, can_decode_pixel_data boolean, can_encode_pixel_data boolean, can_transcode_to boolean, engine string, implemented boolean, claimed_decode boolean, claimed_encode boolean"
    return spark.createDataFrame([tuple(vars(c).values()) for c in capabilities()], fields).orderBy("uid")
