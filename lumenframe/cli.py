"""Command line: one object, or a list of paths from standard input, one after another.

Tables of paths go through ``sources.io.read_path_list`` on a cluster instead.
"""

from __future__ import annotations

import argparse
import os
import sys

from lumenframe.functions import documents as docs
from lumenframe.functions import tsyntax as ts
from lumenframe.functions.errors import ObjectError, fail
from lumenframe.operators import pixels as px
from lumenframe.operators import transcode as tc
from lumenframe.sources import objects as ob

RENDERS = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "raw": "raw", "mp4": "mpeg4", "m4v": "mpeg4"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lumenframe", description="Convert, edit, redact and render objects.")
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?")
    p.add_argument("--list-transfer-syntaxes", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("-I", "--stdin-paths", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--format", choices=["flat", "standard"], default="flat")
    p.add_argument("--keys", choices=["name", "hex"], default="name")
    p.add_argument("--bulk-data", choices=["inline", "uri"], default="uri")
    p.add_argument("--bulk-data-source", nargs="?", const="")
    p.add_argument("--transfer-syntax")
    p.add_argument("--set", action="append", default=[], dest="sets", metavar="KEY=VALUE")
    p.add_argument("--remove", action="append", default=[], dest="removes", metavar="KEY")
    p.add_argument("--render-format", choices=["raw", "png", "jpeg", "mpeg4"])
    p.add_argument("--render-frame", type=int)
    p.add_argument("--render-all-frames", action="store_true")
    p.add_argument("--render-fps", type=float)
    p.add_argument("--no-modality-lut", action="store_true")
    p.add_argument("--no-voi-lut", action="store_true")
    p.add_argument("--window-center", type=float)
    p.add_argument("--window-width", type=float)
    p.add_argument("--jpeg-quality", type=int, default=90)
    p.add_argument("--output-width", type=int)
    p.add_argument("--output-height", type=int)
    p.add_argument("--scale-max-size", type=int)
    p.add_argument("--redact-box", action="append", default=[], metavar="X,Y,W,H")
    p.add_argument("--redact-color")
    p.add_argument("--version", action="version", version="lumenframe 1")
    return p


def kind_of_path(path: str) -> str | None:
    e = os.path.splitext(path)[1][1:].lower()
    return "json" if e == "json" else "dicom" if e in ("dcm", "dicom") else "render" if e in RENDERS else None


def kind_of_input(path: str, data: bytes) -> str:
    k = kind_of_path(path)
    if k in ("json", "dicom"):
        return k
    if data.lstrip(b" \t\n\r\f")[:1] in (b"{", b"["):
        return "json"
    if ob.has_preamble(data):
        return "dicom"
    try:
        ob.parse(data)
        return "dicom"
    except ObjectError:
        raise fail("UnknownInput", f"could not determine input type of {path}") from None


def direction(a: argparse.Namespace, path: str, data: bytes) -> str:
    """to-json, to-dicom, to-render or from-json."""
    kind = kind_of_input(path, data)
    out = kind_of_path(a.output) if a.output else None
    if a.overwrite:
        if a.output:
            raise fail("Usage", "--overwrite cannot be combined with an explicit output path")
        if kind != "dicom":
            raise fail("Usage", "--overwrite needs a DICOM input")
    if kind == "dicom":
        if not a.output:
            return "to-dicom" if a.overwrite else "to-json"
        if out is None and a.render_format:
            return "to-render"
        if out is None:
            raise fail("Usage", f"could not determine output type of {a.output}")
        return {"json": "to-json", "dicom": "to-dicom", "render": "to-render"}[out]
    if out in ("json", "render"):
        raise fail("Usage", f"JSON input cannot be turned into {out}")
    if not a.output:
        raise fail("Usage", "JSON input needs an output path")
    return "from-json"


def _uses_render(a: argparse.Namespace) -> bool:
    return any([a.render_format, a.render_frame is not None, a.render_all_frames, a.render_fps is not None, a.no_modality_lut, a.no_voi_lut, a.window_center is not None, a.window_width is not None, a.jpeg_quality != 90, a.output_width is not None, a.output_height is not None, a.scale_max_size is not None])


def validate(a: argparse.Namespace, way: str) -> None:
    if way in ("to-json", "from-json") and (_uses_render(a) or a.redact_box or a.redact_color):
        raise fail("Usage", "render and redaction options need a DICOM or image output")
    if way == "to-dicom" and _uses_render(a):
        raise fail("Usage", "render options need an image output")
    if a.redact_color and not a.redact_box:
        raise fail("Usage", "--redact-color needs --redact-box")
    if way == "to-render":
        if a.transfer_syntax:
            raise fail("Usage", "--transfer-syntax does not apply to images")
        if a.render_all_frames and a.render_frame is not None:
            raise fail("Usage", "--render-all-frames and --render-frame exclude each other")
        if a.scale_max_size is not None and (a.output_width is not None or a.output_height is not None) and render_format(a) != "mpeg4":
            raise fail("Usage", "--scale-max-size excludes --output-width and --output-height")


def render_format(a: argparse.Namespace) -> str:
    f = a.render_format or RENDERS.get(os.path.splitext(a.output)[1][1:].lower())
    if f is None:
        raise fail("Usage", "no render format")
    return f


def options(a: argparse.Namespace) -> px.Options:
    return px.Options(
        "png" if render_format(a) == "mpeg4" else render_format(a), a.render_frame or 0, not a.no_modality_lut, not a.no_voi_lut, a.window_center, a.window_width, a.jpeg_quality, a.output_width, a.output_height, a.scale_max_size,
        tuple(px.parse_box(x) for x in a.redact_box), px.parse_color(a.redact_color) if a.redact_color else (0, 0, 0),
    )


def convert(a: argparse.Namespace, path: str, data: bytes) -> list[tuple[str | None, bytes]]:
    """Output paths (None: standard output) and their bytes."""
    way = direction(a, path, data)
    validate(a, way)
    if way == "from-json":
        source = None
        if a.bulk_data_source:
            with open(a.bulk_data_source, "rb") as f:
                source = f.read()
        o = docs.override(docs.read_json(data.decode(), a.format, source), a.sets, a.removes)
        return [(a.output, ob.write(tc.transcode(o, a.transfer_syntax) if a.transfer_syntax else o))]
    o = docs.override(ob.parse(data), a.sets, a.removes)
    if way == "to-json":
        base = None
        if a.bulk_data_source is not None:
            base = a.bulk_data_source or "file://" + os.path.realpath(path).replace("%", "%25").replace(" ", "%20")
        text = docs.write_json(o, a.format, a.keys, a.bulk_data, data if a.bulk_data == "uri" else None, base)
        return [(a.output, text.encode() + (b"" if a.output else b"\n"))]
    if way == "to-dicom":
        if a.redact_box:
            o = tc.redact(o, tuple(px.parse_box(x) for x in a.redact_box), px.parse_color(a.redact_color) if a.redact_color else (0, 0, 0), a.transfer_syntax)
        elif a.transfer_syntax:
            o = tc.transcode(o, a.transfer_syntax)
        return [(a.output or path, ob.write(o))]
    if render_format(a) == "mpeg4":
        raise fail("UnsupportedOutput", "MPEG-4 output needs an external encoder that is not part of this engine")
    frames = tc.render_frames(o, options(a), a.render_all_frames)
    if not a.render_all_frames:
        return [(a.output, frames[0][5])]
    if render_format(a) == "raw":
        return [(a.output, b"".join(f[5] for f in frames))]
    return [(px.frame_path(a.output, k), f[5]) for k, f in enumerate(frames, 1)]


def _emit(results: list[tuple[str | None, bytes]]) -> None:
    for out, data in results:
        if out is None:
            sys.stdout.buffer.write(data)
            sys.stdout.buffer.flush()
            continue
        tmp = f"{out}.part"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, out)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.list_transfer_syntaxes:
        for c in ts.capabilities():
            print(f"{c.uid:<24} {c.name:<58} {'yes' if c.can_decode_pixel_data else 'no':<4} {'yes' if c.can_encode_pixel_data else 'no':<4} {c.engine}")
        return 0
    if a.stdin_paths:
        if a.output:
            print("error: with -I every input needs its own output; none can be named", file=sys.stderr)
            return 2
        paths = [x.strip() for x in sys.stdin if x.strip()]
    elif a.input:
        paths = [a.input]
    else:
        print("error: no input", file=sys.stderr)
        return 2
    failed = False
    for p in paths:
        try:
            with open(p, "rb") as f:
                data = f.read()
            if a.verbose:
                print(f"{p}: {len(data)} bytes", file=sys.stderr)
            _emit(convert(a, p, data))
        except (ObjectError, OSError, ValueError) as err:
            print(f"error: {p}: {err}", file=sys.stderr)
            failed = True
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
