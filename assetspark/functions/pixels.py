"""Pixel kernels on arrays; rows come first."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Colour types of a PNG by channels.
COLOR_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}
#: Bytes of a pixel by encoding.
PIXEL_BYTES = {"ARGB": 4, "GRAY": 1, "GA8 ": 2, "RGBW": 8, "GA16": 4, "RGB5": 2}


def unpremultiply(pixels: np.ndarray) -> np.ndarray:
    """Colour divided by alpha, rounded half up and capped; alpha 0 and full are left alone."""
    top = np.iinfo(pixels.dtype).max
    out, alpha = pixels.copy(), pixels[..., 3:].astype(np.uint64)
    some = (alpha > 0) & (alpha < top)
    color = (pixels[..., :3].astype(np.uint64) * top + alpha // 2) // np.maximum(alpha, 1)
    out[..., :3] = np.where(some, np.minimum(color, top), pixels[..., :3])
    return out


def strip_rows(data: bytes, width: int, pixel: int, row_bytes: int | None) -> bytes:
    """Rows without the padding behind them; short rows at the end are dropped."""
    need = width * pixel
    if row_bytes is None or row_bytes == need:
        return data
    if row_bytes < need:
        raise ValueError(f"{row_bytes} bytes a row for {need}")
    return b"".join(data[at : at + need] for at in range(0, len(data) - need + 1, row_bytes))


def to_rgba(data: bytes, encoding: str, width: int, height: int) -> np.ndarray:
    """Decoded bytes of a raster encoding as RGBA of 8 or 16 bits."""
    if encoding == "ARGB":
        return unpremultiply(np.frombuffer(data, np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]])
    if encoding == "RGBW":
        return unpremultiply(np.frombuffer(data, "<u2").reshape(height, width, 4)[..., [2, 1, 0, 3]].astype(np.uint16))
    if encoding in ("GRAY", "GA8 ", "GA16"):
        kind, top = (("<u2", 65535) if encoding == "GA16" else (np.uint8, 255))
        v = np.frombuffer(data, kind).reshape(height, width, -1)
        alpha = v[..., 1] if encoding != "GRAY" else np.full((height, width), top, v.dtype)
        return np.stack([v[..., 0]] * 3 + [alpha], axis=-1)
    if encoding == "RGB5":
        v = np.frombuffer(data, "<u2").reshape(height, width)
        five = np.stack([v >> 10 & 31, v >> 5 & 31, v & 31], axis=-1)
        return np.concatenate([(five << 3 | five >> 2).astype(np.uint8), np.full((height, width, 1), 255, np.uint8)], axis=-1)
    raise ValueError(f"no raster encoding: {encoding}")


def crop(image: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A rectangle whose origin is the lower left corner."""
    rows, columns = image.shape[:2]
    if x + width > columns or y + height > rows:
        raise ValueError("the crop lies outside")
    top = rows - y - height
    return image[top : top + height, x : x + width]


def orient(image: np.ndarray, exif: int) -> np.ndarray:
    """EXIF orientation 1 to 8 applied; others change nothing."""
    turns = {2: lambda i: i[:, ::-1], 3: lambda i: i[::-1, ::-1], 4: lambda i: i[::-1], 5: lambda i: i.swapaxes(0, 1), 6: lambda i: np.rot90(i, -1), 7: lambda i: i[::-1, ::-1].swapaxes(0, 1), 8: lambda i: np.rot90(i)}
    return turns.get(exif, lambda i: i)(image)


def _half(v: np.ndarray) -> np.ndarray:
    return np.trunc(v / 2).astype(np.int32)


def ycocg(y: np.ndarray, co: np.ndarray, cg: np.ndarray, shift: bool = False) -> np.ndarray:
    """RGB of lifted luma and chroma, halves cut towards zero."""
    y, co, cg = (np.asarray(v, np.int32) for v in (y, co, cg))
    if shift:
        co, cg = co << 1, cg << 1
    t = y - _half(cg)
    b = t - _half(co)
    return np.clip(np.stack([t + co - _half(co), t + cg, b], axis=-1), 0, 255).astype(np.uint8)


def predict(row: np.ndarray, above: np.ndarray | None, kind: int) -> np.ndarray:
    """One row of 16-bit triples undone: 1 Paeth, 2 left, 3 up, 4 mean, else as it is."""
    v = np.asarray(row, np.int16).reshape(-1, 3)
    up = np.zeros_like(v) if above is None else np.asarray(above, np.int16).reshape(-1, 3)
    if kind == 2:
        return np.cumsum(v, axis=0, dtype=np.int16).reshape(-1)
    if kind == 3:
        return (v + up).reshape(-1)
    if kind not in (1, 4):
        return v.reshape(-1)
    out = v.copy()
    out[:1] += up[:1]
    for k in range(1, len(v)):
        left = out[k - 1].astype(np.int32)
        if kind == 4:
            out[k] = (v[k] + _half(left + up[k].astype(np.int32) + 1)).astype(np.int16)
        else:
            corner = int(up[k - 1][0])
            near = abs(int(up[k][0]) - corner) <= abs(int(left[0]) - corner)
            out[k] = v[k] + (out[k - 1] if near else up[k])
    return out.reshape(-1)


def zigzag(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Signed values of split unsigned ones; odd ones are negative."""
    v = low.astype(np.int32) | high.astype(np.int32) << 8
    return np.where(v & 1, -(v >> 1), v >> 1).astype(np.int16)


def png(image: np.ndarray) -> bytes:
    """A PNG file of an image of 8 or 16 bits: grey, grey and alpha, RGB or RGBA."""
    rows, columns, channels = image.shape
    deep = image.dtype.itemsize * 8
    body = b"".join(b"\0" + r.astype(f">u{image.dtype.itemsize}").tobytes() for r in image)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", columns, rows, deep, COLOR_TYPES[channels], 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")
