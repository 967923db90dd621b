"""From a rendition's payload to its bytes, its pixels and its original file.

A rendition is a mapping with the columns of ``Catalog.renditions``.  What
cannot be decoded raises ``ImageError``, whose ``code`` tells the kind of fault.
"""

from __future__ import annotations

import struct
from collections.abc import Mapping
from typing import Any

import numpy as np

from . import deepmap
from .compression import StreamError, gunzip, is_stream, lzfse, lzvn
from .deepmap import ImageError
from .pixels import PIXEL_BYTES, crop, orient, strip_rows, unpremultiply

#: Compressions by number.
UNCOMPRESSED, ZIP, LZVN, LZFSE, HEVC, DEEPMAP = 0, 2, 3, 4, 9, 11
#: Pixel format that an encoding gives its deep maps.
DEEP_FORMATS = {"ARGB": deepmap.RGBA8888, "RGBW": deepmap.RGBA8888, "GA8 ": deepmap.GA88}
#: Encodings whose payload is a file of its own.
FILES = ("DATA", "HEIF", "PDF ", "SVG ", "JPEG", "WEBP")
#: Brands of a HEIF file.
BRANDS = (b"heic", b"heix", b"hevc", b"hevx", b"heim", b"heis", b"mif1", b"msf1", b"MiHE", b"MiHB")
#: TLV tags.
EXIF, ROW_BYTES = 1006, 1007
#: Faults that leave other assets worth trying.
RECOVERABLE = ("UnsupportedCompression", "UnsupportedEncoding", "Deepmap2", "DecodeFailed")
#: Faults of a deep map, all of which count as one.
_DEEP = ("DekuParse", "InvalidData", "InvalidPaletteType", "UnsupportedPixelFormat", "UnsupportedDecodeType", "LzfseDecompress", "LzvnDecompress")


def recoverable(code: str) -> bool:
    return code in RECOVERABLE


def _failed(message: str) -> ImageError:
    return ImageError("DecodeFailed", message)


def within(size: int, limit: int | None, stage: str) -> None:
    """Raises if an output of ``size`` bytes would go beyond the budget."""
    if limit is not None and size > limit:
        raise ImageError("DecodeBudgetExceeded", f"{stage}: {size} bytes of {limit}")


def first_number(r: Mapping[str, Any], tag: int) -> int | None:
    """The number in the first TLV with that tag."""
    body = next((t["body"] for t in r["tlvs"] or () if t["tag"] == tag), None)
    return None if body is None or len(body) < 4 else struct.unpack_from("<I", body)[0]


def row_bytes(r: Mapping[str, Any], pixel: int) -> int:
    least, told = r["width"] * pixel, first_number(r, ROW_BYTES)
    if told is not None and told < least:
        raise _failed(f"{told} bytes a row, at least {least} needed")
    return least if told is None else told


def _deep(chunk: bytes, r: Mapping[str, Any], rows: int | None) -> np.ndarray:
    tile, one = chunk.find(deepmap.TILE), chunk.find(deepmap.MAGIC)
    form = DEEP_FORMATS.get(r["encoding"])
    if tile < 0 and one < 0:
        raise _failed("no deep map in a chunk")
    try:
        if tile >= 0 and (one < 0 or tile <= one):
            return deepmap.decode_tiles(chunk[tile:], r["width"], None, form)
        return deepmap.decode(deepmap.region(chunk, one), r["width"], rows, form)[0]
    except ImageError as e:
        raise ImageError("Deepmap2", str(e)) if e.code in _DEEP else e from None


def _raster(r: Mapping[str, Any], limit: int | None) -> bytes:
    """The chunks of a raster, decompressed and put together."""
    chunks, way = [(c["height"], bytes(c["data"])) for c in r["chunks"] or ()], r["compression"]
    if way == UNCOMPRESSED:
        within(sum(len(d) for _, d in chunks), limit, "Uncompressed")
        return b"".join(d for _, d in chunks)
    if way in (LZFSE, ZIP):
        out, stage = bytearray(), "Lzfse" if way == LZFSE else "Zip"
        for _, data in chunks:
            try:
                part = lzfse(data) if way == LZFSE else gunzip(data)
            except StreamError as e:
                raise _failed(f"{stage}: {e}") from None
            if way == LZFSE and data and not part:
                raise _failed("no output of a stream that is not empty")
            out += part
            within(len(out), limit, stage)
        return bytes(out)
    if way == LZVN:
        if r["encoding"] not in PIXEL_BYTES:
            raise _failed(f"LZVN of encoding {r['encoding']}")
        wide = row_bytes(r, PIXEL_BYTES[r["encoding"]])
        total, out = wide * r["height"], bytearray()
        within(total, limit, "Lzvn")
        for height, data in chunks:
            if len(chunks) > 1 and not height:
                raise _failed("a part without its height")
            try:
                out += lzvn(data, total if len(chunks) == 1 else height * wide)
            except StreamError as e:
                raise ImageError("Deepmap2", f"Lzvn: {e}") from None
        if len(out) != total:
            raise _failed(f"{len(out)} bytes instead of {total}")
        return bytes(out)
    if way == DEEPMAP:
        if max(r["width"], r["height"]) > 0xFFFF:
            raise _failed("width or height beyond 16 bits")
        within(r["width"] * r["height"] * 4, limit, "Deepmap2")
        out, rows, wide = bytearray(), 0, None
        for height, data in chunks:
            if (height or 0) > 0xFFFF:
                raise _failed(f"a part of {height} rows")
            image = _deep(data, r, height or (r["height"] if len(chunks) == 1 else None))
            if wide not in (None, image.shape[1]):
                raise _failed(f"parts of widths {wide} and {image.shape[1]}")
            wide, rows = image.shape[1], rows + image.shape[0]
            out += image.tobytes()
            within(len(out), limit, "Deepmap2")
        if len(chunks) > 1 and rows != r["height"]:
            raise _failed(f"{rows} rows instead of {r['height']}")
        return bytes(out)
    raise ImageError("UnsupportedCompression", f"compression {way}")


def decoded(r: Mapping[str, Any], limit: int | None = None) -> bytes | None:
    """The bytes of a rendition's payload, decompressed: components as doubles, raw data, or pixels as stored; None if it has none."""
    kind = r["rendition_kind"]
    if kind == "None":
        return None
    if kind == "Unknown":
        raise _failed("unknown payload")
    if kind == "ThemeCBCK":
        return _raster(r, limit)
    if kind == "Color":
        out = struct.pack(f"<{len(r['components'])}d", *r["components"])
    elif kind == "RawData":
        out = bytes(r["raw"])
    else:
        out = b"".join(struct.pack("<2I2H", s["width"], s["height"], s["index"], s["idiom"]) for s in r["sizes"])
    within(len(out), limit, "BorrowedPayload")
    return out


def _rows(data: bytes, r: Mapping[str, Any], kind: str, channels: int) -> np.ndarray:
    size = np.dtype(kind).itemsize * channels
    w, h = r["width"], r["height"]
    data = strip_rows(data, w, size, row_bytes(r, size))[: w * h * size]
    if len(data) < w * h * size:
        raise _failed(f"{len(data)} bytes for {w} x {h} pixels of {size}")
    return np.frombuffer(data, kind).reshape(h, w, channels)


def image(r: Mapping[str, Any], limit: int | None = None, exif: bool = False) -> np.ndarray:
    """A rendition's pixels, (rows, columns, channels) of 8 or 16 bits: grey, grey and alpha, RGB, or RGBA with straight alpha."""
    enc = r["encoding"]
    data = decoded(r, limit) if r["rendition_kind"] == "ThemeCBCK" else None
    if data is None:
        if r["rendition_kind"] == "Unknown":
            raise _failed("unknown payload")
        raise ImageError("UnsupportedEncoding", f"encoding {enc}")
    if r["compression"] == DEEPMAP:
        wide = r["width"] * 4
        if len(data) != wide * r["height"]:
            told = first_number(r, ROW_BYTES)
            data = strip_rows(data, r["width"], 4, told if told is not None and told >= wide else wide)
        if not wide or len(data) % wide:
            raise _failed(f"{len(data)} bytes for rows of {wide}")
        out = unpremultiply(np.frombuffer(data, np.uint8).reshape(-1, r["width"], 4))
    elif enc in ("ARGB", "RGBW"):
        out = unpremultiply(_rows(data, r, "<u2" if enc == "RGBW" else "u1", 4)[..., [2, 1, 0, 3]])
    elif enc in ("GRAY", "GA8 ", "GA16"):
        out = _rows(data, r, "<u2" if enc == "GA16" else "u1", 1 if enc == "GRAY" else 2)
    elif enc == "RGB5":
        v = _rows(data, r, "<u2", 1)[..., 0]
        five = np.stack([v >> 10 & 31, v >> 5 & 31, v & 31], axis=-1)
        out = (five << 3 | five >> 2).astype(np.uint8)
    elif enc in ("JPEG", "WEBP"):
        raise ImageError("UnsupportedEncoding", f"no decoder for {enc}")
    else:
        raise ImageError("UnsupportedEncoding", f"encoding {enc}")
    within(out.nbytes, limit, "ImageConversion")
    return orient(out, first_number(r, EXIF) or 0) if exif else out


def cropped(pixels: np.ndarray, crops: list[Mapping[str, int]]) -> np.ndarray:
    """The rectangles cut out one after the other; their origins are lower left corners."""
    for c in crops:
        try:
            pixels = crop(pixels, c["x"], c["y"], c["width"], c["height"])
        except ValueError as e:
            raise _failed(str(e)) from None
    return pixels


def rgba(pixels: np.ndarray) -> np.ndarray:
    """RGBA of 8 bits."""
    if pixels.dtype.itemsize == 2:
        pixels = ((pixels.astype(np.uint32) + 128) // 257).astype(np.uint8)
    n = pixels.shape[2]
    color = pixels[..., : 3 if n > 2 else 1]
    color = np.repeat(color, 3, axis=2) if color.shape[2] == 1 else color
    alpha = pixels[..., -1:] if n in (2, 4) else np.full((*pixels.shape[:2], 1), 255, np.uint8)
    return np.concatenate([color, alpha], axis=2)


def heif(chunk: bytes) -> bytes:
    """The HEIF file in a HEVC chunk: eight bytes of wrapper, the last four its length, then a file that says so."""
    if len(chunk) < 24:
        raise _failed("the chunk is too short")
    body = bytes(chunk[8:])
    (told,), (box,) = struct.unpack_from("<I", chunk, 4), struct.unpack_from(">I", body)
    if told != len(body):
        raise _failed(f"{len(body)} bytes instead of {told}")
    if not 16 <= box <= len(body) or body[4:8] != b"ftyp":
        raise _failed("no ftyp box")
    if body[8:12] not in BRANDS and not any(body[at : at + 4] in BRANDS for at in range(16, box - 3, 4)):
        raise _failed("no HEIF brand")
    return body


def _plain(data: bytes) -> bytes:
    if not is_stream(data):
        return bytes(data)
    try:
        return lzfse(data)
    except StreamError as e:
        raise ImageError("NativeFallbackUnavailable", str(e)) from None


def original(r: Mapping[str, Any]) -> bytes:
    """The file that a rendition was made of, where it holds one."""
    kind, enc = r["rendition_kind"], r["encoding"]
    if kind == "ThemeCBCK" and r["compression"] == HEVC:
        if len(r["chunks"]) != 1:
            raise _failed(f"{len(r['chunks'])} chunks of a HEVC file")
        return heif(r["chunks"][0]["data"])
    if enc not in FILES:
        raise ImageError("UnsupportedEncoding", f"encoding {enc}")
    if kind == "RawData":
        return _plain(r["raw"])
    if kind == "ThemeCBCK" and r["compression"] == UNCOMPRESSED and enc != "DATA":
        return b"".join(_plain(c["data"]) for c in r["chunks"])
    if kind == "ThemeCBCK":
        return _raster(r, None)
    if kind == "Unknown":
        raise _failed("unknown payload")
    raise ImageError("UnsupportedEncoding", f"encoding {enc}")


def thumbnail(pixels: np.ndarray, most: int = 256) -> np.ndarray:
    """The image shrunk to fit a square, by a triangle filter, if it is larger; at least one pixel each way."""
    rows, columns = pixels.shape[:2]
    if max(rows, columns) <= most:
        return pixels
    share = min(most / columns, most / rows)
    out = pixels.astype(np.float64)
    for axis, (old, new) in enumerate(((rows, max(1, round(rows * share))), (columns, max(1, round(columns * share))))):
        step = old / new
        reach = max(1.0, step)
        middle = (np.arange(new) + 0.5) * step
        weight = np.maximum(0.0, 1 - np.abs((np.arange(old) + 0.5)[None, :] - middle[:, None]) / reach)
        weight /= weight.sum(axis=1, keepdims=True)
        out = np.moveaxis(np.tensordot(weight, out, axes=(1, axis)), 0, axis)
    return np.clip(np.rint(out), 0, np.iinfo(pixels.dtype).max).astype(pixels.dtype)
