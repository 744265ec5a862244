"""Binary payloads inside documents: metafiles, drawings, companion bitmaps. Decoders are total: bad input gives a code."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METAFILE = "code string, width int, height int, records int, rgb binary, width_in double, height_in double"
DRAWING = "code string, records array<struct<type:int,length:int,depth:int,offset:int>>"
PREVIEW = "code string, width int, height int, grey binary, sha256 string"
MAX_RECORDS, MAX_DEPTH, MAX_PIXELS = 65536, 32, 16_000_000
MAX_BYTES, MAX_OBJECTS, MAX_PALETTE, MAX_METAFILE_RECORDS = 16 * 1024 * 1024, 4096, 4096, 10_000


class _Bad(Exception):
    pass


def _need(ok: bool, code: str) -> None:
    if not ok:
        raise _Bad(code)


def _placeable(data: bytes) -> tuple[float, float]:
    """Inches of a placeable header."""
    _need(len(data) >= 40, "truncated-placeable-header")
    handle, left, top, right, bottom, inch, reserved, check = struct.unpack("<HhhhhHIH", data[4:22])
    _need(not handle and not reserved, "invalid-placeable-header")
    total = 0
    for x in struct.unpack("<10H", data[:20]):
        total ^= x
    _need(total == check, "placeable-checksum")
    _need(inch > 0, "invalid-placeable-units")
    w, h = (right - left) / inch, (bottom - top) / inch
    _need(0 < w <= 100 and 0 < h <= 100, "invalid-placeable-bounds")
    return w, h


def _palette(body: bytes) -> None:
    _need(len(body) >= 4, "truncated-palette")
    start, n = struct.unpack("<HH", body[:4])
    _need(start == 0x300, "unsupported-palette")
    _need(n <= MAX_PALETTE, "palette-limit")
    _need(len(body) == 4 + 4 * n, "invalid-palette-size")
    _need(not set(body[7::4]) - {0, 1, 2, 4}, "invalid-palette-flags")


def _picture(body: bytes, max_side: int, max_pixels: int) -> dict:
    """The bitmap of a stretch record: its place and its rows, checked but not yet expanded."""
    _need(len(body) >= 60, "truncated-dib")
    mode, sh, sw, sy, sx, dh, dw, dy, dx = struct.unpack("<Ihhhhhhhh", body[:20])
    _need(mode == 0xCC0020, "unsupported-raster-operation")
    _need(not sx and not sy, "unsupported-source-origin")
    dib = body[20:]
    size, w, h, planes, depth, packing, n_bytes, _, _, used, important = struct.unpack("<IiiHHIIiiII", dib[:40])
    _need(size == 40, "unsupported-dib-header")
    _need(h >= 0, "unsupported-top-down-dib")
    _need(w > 0 and h > 0, "invalid-dib-dimensions")
    _need(max(w, h) <= max_side, "dimension-limit")
    _need(w * h <= max_pixels, "pixel-limit")
    _need(planes == 1, "invalid-dib-planes")
    _need(depth in (1, 4, 8, 24), "unsupported-dib-depth")
    _need(packing == 0, "unsupported-dib-compression")
    colours = 0 if depth == 24 else used or 1 << depth
    _need(not (depth == 24 and (used or important)) and (depth == 24 or colours <= 1 << depth) and important <= max(colours, 0) * (colours > 0) + (2**32) * (colours == 0), "invalid-color-table")
    _need(colours <= MAX_PALETTE, "palette-limit")
    stride = (w * depth + 31) // 32 * 4
    _need(n_bytes in (0, stride * h), "image-size-mismatch")
    want = 40 + 4 * colours + stride * h
    _need(len(dib) >= want, "truncated-dib")
    _need(len(dib) == want, "trailing-dib-data")
    table = np.frombuffer(dib, np.uint8, 4 * colours, 40).reshape(-1, 4)
    _need(not table[:, 3].any(), "invalid-color-table")
    rows = np.frombuffer(dib, np.uint8, stride * h, 40 + 4 * colours).reshape(h, stride)
    if depth == 24:
        index = None
    else:
        bits = np.unpackbits(rows, axis=1) if depth == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(h, -1) if depth == 4 else rows
        index = bits[:, :w]
        _need(index.max(initial=0) < colours, "invalid-palette-index")
    return {"w": w, "h": h, "at": (dx, dy), "to": (dw, dh), "of": (sw, sh), "rows": rows, "index": index, "table": table}


def _pixels(p: dict) -> bytes:
    """RGB rows from the top."""
    if p["index"] is None:
        bgr = p["rows"][:, : 3 * p["w"]].reshape(p["h"], p["w"], 3)
    else:
        bgr = p["table"][:, :3][p["index"]]
    return np.ascontiguousarray(bgr[::-1, :, ::-1]).tobytes()


def decode_metafile(data: bytes | None, max_side: int = 4096, max_pixels: int = 4_000_000) -> dict:
    """A metafile of the closed grammar that is decoded (map mode, window, palettes, one bitmap, end): code, width, height,
    records, rgb, width_in, height_in. Whatever else it holds is a code, and nothing of it is run."""
    out = {"code": "ok", "width": None, "height": None, "records": 0, "rgb": None, "width_in": None, "height_in": None}
    try:
        _metafile(data or b"", out, max_side, max_pixels)
    except _Bad as e:
        out["code"] = str(e)
    return out


def _metafile(data: bytes, out: dict, max_side: int, max_pixels: int) -> None:
    _need(len(data) <= MAX_BYTES, "asset-limit")
    _need(len(data) >= 18, "truncated-header")
    at = 0
    if data[:4] == b"\xd7\xcd\xc6\x9a":
        out["width_in"], out["height_in"] = _placeable(data)
        at = 22
    _need(len(data) - at >= 18, "truncated-header")
    kind, head, version, size, slots, largest, params = struct.unpack("<HHHIHIH", data[at : at + 18])
    _need(kind == 1, "unsupported-header")
    _need(head == 9, "invalid-header-size")
    _need(version == 0x300, "unsupported-version")
    _need(params == 0, "invalid-header")
    _need(size >= 12, "invalid-file-size")
    _need(2 * size == len(data) - at, "file-size-mismatch")
    _need(slots <= MAX_OBJECTS, "object-limit")
    _need(largest >= 3, "invalid-max-record")
    end, at = at + 2 * size, at + 18
    palettes, selected, mode, origin, extent, picture, seen = 0, False, None, None, None, None, 0
    done = False
    while at < end and not done:
        _need(end - at >= 6, "truncated-record")
        words, function = struct.unpack("<IH", data[at : at + 6])
        _need(words >= 3, "invalid-record-size")
        _need(2 * words <= end - at, "truncated-record")
        out["records"] += 1
        _need(out["records"] <= MAX_METAFILE_RECORDS, "record-limit")
        seen = max(seen, words)
        body = data[at + 6 : at + 2 * words]
        at += 2 * words
        sized = lambda n: _need(len(body) == n, "invalid-record-size")
        if function == 0x0000:
            _need(words == 3, "invalid-eof")
            _need(at == end, "early-eof")
            done = True
        elif function == 0x0626:
            _need(False, "unsafe-escape")
        elif function == 0x0103:
            sized(2)
            _need(mode is None and origin is None and extent is None and picture is None, "transform-order")
            mode = struct.unpack("<h", body)[0]
            _need(mode == 8, "unsupported-map-mode")
        elif function == 0x020B:
            sized(4)
            _need(origin is None, "duplicate-transform")
            origin = struct.unpack("<hh", body)[::-1]
        elif function == 0x020C:
            sized(4)
            _need(extent is None, "duplicate-transform")
            extent = struct.unpack("<hh", body)[::-1]
            _need(0 not in extent, "invalid-transform")
        elif function == 0x00F7:
            _palette(body)
            _need(palettes < slots, "object-table-overflow")
            palettes += 1
        elif function == 0x0234:
            sized(2)
            _need(struct.unpack("<H", body)[0] < palettes, "invalid-object-index")
            selected = True
        elif function == 0x0035:
            sized(0)
            _need(selected, "invalid-object-state")
        elif function == 0x0B41:
            _need(picture is None, "multiple-images")
            _need(origin is not None and extent is not None, "missing-transform")
            picture = _picture(body, max_side, max_pixels)
        else:
            _need(False, "unsupported-record")
    _need(done, "missing-eof")
    _need(seen == largest, "max-record-mismatch")
    _need(picture is not None, "missing-image")
    _need(origin == (0, 0), "unsupported-transform")
    _need(extent == picture["to"], "transform-mismatch")
    _need((min(extent) >= 0 or mode == 8) and extent[0] >= 0, "unsupported-transform")
    own = (picture["w"], picture["h"])
    _need((abs(extent[0]), abs(extent[1])) == own, "transform-mismatch")
    _need(picture["at"] == (0, 0), "unsupported-transform")
    _need(picture["of"] == own, "source-mismatch")
    out["width"], out["height"] = own
    out["rgb"] = _pixels(picture)


def metafile(data: bytes | None) -> tuple[str, int | None, int | None, int]:
    """(code, width, height, records)."""
    m = decode_metafile(data)
    return m["code"], m["width"], m["height"], m["records"]


def drawing(data: bytes | None) -> tuple[str, list[dict]]:
    """Validates the record envelope of a drawing stream: a header with a record count and a length, then records
    led by type and length; containers hold streams. Returns summaries in preorder."""
    found: list[dict] = []

    def stream(at: int, end: int, depth: int) -> str | None:
        if depth > MAX_DEPTH:
            return "too-deep"
        if end - at < 20:
            return "too-short"
        magic, _, _, count, *_bounds, length = struct.unpack("<4sHHIhhhhH", data[at : at + 22]) if end - at >= 22 else (b"", 0, 0, 0, 0, 0, 0, 0, 0)
        if magic != b"SM\x02\x01":
            return "bad-magic"
        if length > end - at:
            return "length-beyond-data"
        pos = at + 22
        for _ in range(count):
            if pos + 4 > end:
                return "record-beyond-data"
            kind, size = struct.unpack("<HH", data[pos : pos + 4])
            if size < 4 or pos + size > end:
                return "record-beyond-data"
            if len(found) >= MAX_RECORDS:
                return "too-many-records"
            found.append({"type": kind, "length": size, "depth": depth, "offset": pos})
            if kind == 14 and (bad := stream(pos + 18, pos + size, depth + 1)):
                return bad
            pos += size
        return None if pos == end else "trailing-bytes"

    if data is None:
        return "too-short", []
    bad = stream(0, len(data), 0)
    return bad or "ok", found


def preview(data: bytes | None) -> tuple[str, int | None, int | None, bytes | None, str | None]:
    """Companion bitmap to grey bytes: rows top down, planes interleaved per row, (bits, planes) one of (1,1), (1,4),
    (8,1); a level i of m becomes (i * 255 + m // 2) // m."""
    if data is None or len(data) < 18:
        return "too-short", None, None, None, None
    magic, w, h, stride, bits, planes = struct.unpack("<2sHHHBB", data[:10])
    if magic != b"SS":
        return "bad-magic", None, None, None, None
    if (bits, planes) not in ((1, 1), (1, 4), (8, 1)):
        return "unsupported-depth", w, h, None, None
    if not w or not h or w * h > MAX_PIXELS:
        return "bad-size", w, h, None, None
    if stride < ((w + 7) // 8 if bits == 1 else w):
        return "bad-stride", w, h, None, None
    if len(data) - 18 != stride * planes * h:
        return "length-mismatch", w, h, None, None
    rows = np.frombuffer(data, np.uint8, offset=18).reshape(h, planes, stride)
    if bits == 8:
        level, top = rows[:, 0, :w].astype(int), 255
    else:
        level, top = sum(np.unpackbits(rows[:, p], axis=1)[:, :w].astype(int) << p for p in range(planes)), (1 << planes) - 1
    grey = ((level * 255 + top // 2) // top).astype(np.uint8).tobytes()
    return "ok", w, h, grey, hashlib.sha256(grey).hexdigest()


def read_metafile(content: Column) -> Column:
    @F.pandas_udf(METAFILE)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_metafile(None if x is None else bytes(x)) for x in s]).astype({"width": "Int32", "height": "Int32"})

    return run(content)


def read_drawing(content: Column) -> Column:
    @F.pandas_udf(DRAWING)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([drawing(x) for x in s], columns=["code", "records"])

    return run(content)


def read_preview(content: Column) -> Column:
    @F.pandas_udf(PREVIEW)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([preview(x) for x in s], columns=["code", "width", "height", "grey", "sha256"])

    return run(content)


# --- structural checks of images -----------------------------------------------------------------------------


def valid_png(b: bytes) -> bool:
    """Chunks in order with right checksums, a header first, data, and an end that ends the bytes."""
    import zlib

    if b[:8] != b"\x89PNG\r\n\x1a\n":
        return False
    at, kinds = 8, []
    while at + 12 <= len(b):
        n, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        if at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != int.from_bytes(b[at + 8 + n : at + 12 + n], "big"):
            return False
        kinds.append(kind)
        if kind == b"IHDR" and (n != 13 or 0 in struct.unpack(">II", b[at + 8 : at + 16])):
            return False
        at += 12 + n
        if kind == b"IEND":
            break
    return at == len(b) and kinds[:1] == [b"IHDR"] and kinds[-1:] == [b"IEND"] and b"IDAT" in kinds and kinds.count(b"IHDR") == 1


def valid_jpeg(b: bytes) -> bool:
    """Segments with lengths up to a scan after a frame header of a size, and an end marker."""
    if b[:2] != b"\xff\xd8" or b[-2:] != b"\xff\xd9":
        return False
    at, framed = 2, False
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return False
        kind = b[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        n = int.from_bytes(b[at + 2 : at + 4], "big")
        if n < 2 or at + 2 + n > len(b):
            return False
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            framed = n >= 8 and 0 not in struct.unpack(">HH", b[at + 5 : at + 9])
        if kind == 0xDA:
            return framed
        at += 2 + n
    return False


def valid_gif(b: bytes) -> bool:
    """A screen, blocks with sub-blocks, at least one picture, and a trailer that ends the bytes."""
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 14:
        return False
    w, h, flags = struct.unpack("<HHB", b[6:11])
    at = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    pictures = 0
    if not w or not h:
        return False
    while at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1 == len(b) and pictures > 0
        if kind == 0x21:
            at += 2
        elif kind == 0x2C and at + 10 <= len(b):
            pictures += 1
            at += 10 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0) + 1
        else:
            return False
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return False


def image_kind(b: bytes | None) -> str | None:
    """The media type of a structurally valid image, else null."""
    from .legacy import valid_bitmap

    if not b or len(b) > MAX_BYTES:
        return None
    for kind, ok in (("image/png", valid_png), ("image/jpeg", valid_jpeg), ("image/gif", valid_gif), ("image/bmp", valid_bitmap)):
        if ok(b):
            return kind
    return None


def read_image_kind(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: image_kind(None if x is None else bytes(x)))

    return run(content)


def findings(content: Column, path: Column) -> Column:
    """What in a file's first bytes or name needs a look before it is kept: executables, archives, risky suffixes."""
    h = F.hex(F.substring(content, 1, 64))
    new = F.conv(F.concat(F.substring(h, 127, 2), F.substring(h, 125, 2), F.substring(h, 123, 2), F.substring(h, 121, 2)), 16, 10).cast("long")
    second = F.when(new + 4 <= F.length(content), F.hex(F.substring(content, (new + 1).cast("int"), F.lit(4))))
    exe = F.when(F.startswith(h, F.lit("4D5A")) & (F.length(content) >= 64), F.when(second.isNull(), "executable, second header out of range").when(F.startswith(second, F.lit("4E45")), "16-bit executable").when(second == "50450000", "32-bit executable").when(F.substring(second, 1, 4).isin("4C45", "4C58"), "linear executable").otherwise("executable"))
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.array_compact(F.array(exe, F.when(F.startswith(h, F.lit("60EA")), "ARJ archive"), F.when(F.startswith(h, F.lit("4D534346")), "CAB archive"), F.when(suffix.isin(".exe", ".dll", ".drv", ".com", ".ttf", ".sam"), F.concat(F.lit("suffix "), suffix))))
