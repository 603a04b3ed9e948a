"""Operators as Column expressions: keys, bulk addresses, input kinds, frame math, geometry.

All of these stay in the JVM. Regular expressions guard casts, as numbers with a suffix
would pass ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import dictionary as dd

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def hex_key(tag: Column) -> Column:
    return F.format_string("%08X", tag)


def tag_expression(tag: Column) -> Column:
    return F.format_string("(%04X,%04X)", F.shiftright(tag, 16), tag.bitwiseAND(0xFFFF))


def keyword_of(tag: Column) -> Column:
    """Keyword of a standard tag, else its expression; the dictionary is a literal map of fixed size."""
    return F.coalesce(F.try_element_at(_map({t: k for t, k, _, _ in dd.ENTRIES if not dd.is_group_length(t)}), tag), tag_expression(tag))


def must_be_hex(tag: Column) -> Column:
    known = F.map_contains_key(_map({t: k for t, k, _, _ in dd.ENTRIES}), tag)
    return (F.shiftright(tag, 16).bitwiseAND(1) == 1) | ~known | (tag.bitwiseAND(0xFFFF) == 0)


def flat_key(tag: Column, style: str = "name") -> Column:
    return hex_key(tag) if style == "hex" else F.when(must_be_hex(tag), hex_key(tag)).otherwise(keyword_of(tag))


def _map(x: dict[int, str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k).cast("bigint") for k in x]), F.array(*[F.lit(v) for v in x.values()]))


def normalize_uid(uid: Column) -> Column:
    return F.regexp_replace(uid, r"[\s\x00]+$", "")


def split_multi(text: Column) -> Column:
    """Values of a multi-valued text; an empty one has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\\", -1))


def to_number(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def first_number(text: Column) -> Column:
    return to_number(F.try_element_at(F.split(text, r"\\", -1), F.lit(1)))


def all_numbers(text: Column) -> Column:
    return F.filter(F.transform(split_multi(text), to_number), lambda x: x.isNotNull())


def padded_length(n: Column) -> Column:
    return n + n % 2


def bulk_reference(offset: Column, length: Column, content: Column, base: str = "") -> Column:
    """What a bulk value becomes in uri mode: base64 text up to 32 bytes, an address beyond."""
    inline = F.regexp_replace(F.base64(F.substring(content, offset + 1, length)), "[\r\n]", "")
    return F.when(length <= 32, inline).otherwise(F.concat(F.lit(base + "?offset="), offset.cast("string"), F.lit("&length="), length.cast("string")))


def bulk_uri_part(uri: Column, name: str) -> Column:
    """offset or length of an address: the last parameter of that name, null if it isn't a number."""
    query = F.when(F.instr(uri, "?") > 0, F.regexp_replace(uri, r"^[^?]*\?", "")).otherwise(uri)
    own = F.filter(F.split(query, "&", -1), lambda p: F.startswith(p, F.lit(name + "=")))
    last = F.substring_index(F.try_element_at(own, F.lit(-1)), "=", -1)
    value = F.regexp_replace(F.try_element_at(own, F.lit(-1)), f"^{name}=", "")
    return F.when(last.isNotNull() & value.rlike(r"^\+?[0-9]+$"), value.try_cast("bigint"))


def file_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def kind_of_extension(path: Column) -> Column:
    e = extension(path)
    return F.when(e == "json", "json").when(e.isin("dcm", "dicom"), "dicom").when(e.isin("jpg", "jpeg", "png", "raw", "mp4", "m4v"), "render")


def kind_of_content(content: Column) -> Column:
    """json if the first byte that isn't white space opens a document, dicom if the magic code is there."""
    head = F.ltrim(F.regexp_replace(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), r"^[\t\n\f\r ]+", ""))
    return F.when(F.substring(head, 1, 1).isin("{", "["), "json").when((F.length(content) >= 132) & (F.substring(content, 129, 4) == F.lit(bytearray(b"DICM"))), "dicom")


def input_kind(path: Column, content: Column) -> Column:
    e = kind_of_extension(path)
    return F.when(e.isin("json", "dicom"), e).otherwise(kind_of_content(content))


def frame_path(path: Column, number: Column) -> Column:
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(ext)), F.format_string("_%06d", number), ext)


# --- frame math over array<double> ------------------------------------------------------


def signed_values(raw: Column, stored: int, is_signed: bool) -> Column:
    """Masks to the stored bits and extends the sign."""
    mask, half = (1 << stored) - 1, 1 << (stored - 1)
    m = F.transform(raw, lambda x: x.bitwiseAND(mask))
    return F.transform(m, lambda x: F.when(x >= half, x - (1 << stored)).otherwise(x)) if is_signed else m


def modality(values: Column, slope: float = 1.0, intercept: float = 0.0) -> Column:
    return values if slope == 1.0 and intercept == 0.0 else F.transform(values, lambda x: x * F.lit(slope) + F.lit(intercept))


def _trunc_u8(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)).cast("int")


def normalize_u8(values: Column) -> Column:
    v = F.filter(values, lambda x: ~F.isnan(x))
    lo, hi = F.array_min(v), F.array_max(v)
    flat = F.abs(hi - lo) < F.lit(2.220446049250313e-16)
    return F.transform(values, lambda x: F.when(flat, F.lit(0)).otherwise(_trunc_u8((x - lo) / (hi - lo) * F.lit(255.0))))


def window_u8(values: Column, center: float | None, width: float | None) -> Column:
    if center is None or width is None:
        return normalize_u8(values)
    den = max(width - 1.0, 1.0)
    middle, half = center - 0.5, (width - 1.0) / 2.0
    lower, upper = middle - half, middle + half
    v = F.filter(values, lambda x: ~F.isnan(x))
    lo, hi = F.array_min(v), F.array_max(v)
    overlap = F.greatest(F.lit(0.0), F.least(F.lit(upper), hi) - F.greatest(F.lit(lower), lo)) / F.greatest(hi - lo, F.lit(1.0))
    inside = F.size(F.filter(values, lambda x: (x >= lower) & (x <= upper)))
    back = (F.lit(upper) <= lo) | (F.lit(lower) >= hi) | (overlap < 0.05) | (inside * 100 < F.size(values))
    one = lambda x: F.when(x <= lower, F.lit(0)).when(x > upper, F.lit(255)).otherwise(_trunc_u8(((x - F.lit(center - 0.5)) / F.lit(den) + F.lit(0.5)) * F.lit(255.0)))
    return F.when(back, normalize_u8(values)).otherwise(F.transform(values, one))


def invert_u8(values: Column) -> Column:
    return F.transform(values, lambda x: 255 - x)


def half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(0.5 - x))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), half_away(F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b).cast("int")))


def scale_to_depth(v: Column, stored: Column) -> Column:
    top = F.call_function("shiftleft", F.lit(1), F.least(F.greatest(stored, F.lit(1)), F.lit(16))) - 1
    return F.floor((v * top + 127) / 255).cast("int")


def axis_start(offset: Column, extent: Column) -> Column:
    """Start of a box on an axis; -2147483648 stands for -0, the far edge."""
    return F.when(offset == -(1 << 31), extent).when(offset >= 0, F.least(offset, extent)).otherwise(extent - F.least(-offset, extent))


def axis_length(pixels: Column, percent: Column, extent: Column) -> Column:
    return F.coalesce(pixels.cast("bigint"), half_away(extent * F.least(F.greatest(percent, F.lit(0.0)), F.lit(100.0)) / 100.0).cast("bigint"))


def axis_end(offset: Column, pixels: Column, percent: Column, extent: Column) -> Column:
    return F.least(axis_start(offset, extent) + axis_length(pixels, percent, extent), extent)


def ratio(new: Column, ref: Column, x: Column) -> Column:
    return F.when(ref == 0, x).otherwise(F.greatest(F.lit(1), half_away(new.cast("double") / ref * x)).cast("bigint"))


def scaled_size(width: Column, height: Column, most: Column) -> tuple[Column, Column]:
    """Width and height with the longer side ``most``."""
    wide = width >= height
    return F.when(wide, most).otherwise(ratio(most, height, width)).cast("bigint"), F.when(wide, ratio(most, width, height)).otherwise(most).cast("bigint")


def frame_rate(in_float: Column, recommended: Column, cine: Column, frame_time: Column, vector: Column) -> Column:
    """Frame rate from texts of the five attributes; a first one that isn't positive gives null."""
    good = F.filter(all_numbers(vector), lambda x: (x > 0) & (x < F.lit(float("inf"))))
    mean = F.aggregate(good, F.lit(0.0), lambda a, x: a + x) / F.size(good)
    t = first_number(frame_time)
    x = F.coalesce(first_number(in_float), first_number(recommended), first_number(cine), F.when(t > 0, F.lit(1000.0) / t), F.when(F.size(good) > 0, F.lit(1000.0) / mean))
    return F.when((x > 0) & (x < F.lit(float("inf"))), x)
