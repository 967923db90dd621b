"""Deep-map images: a header, four ways to store pixels, and grids of tiles; all give RGBA bytes."""

from __future__ import annotations

import struct
from dataclasses import dataclass, replace

import numpy as np

from .compression import StreamError, lzfse, lzvn
from .pixels import predict, ycocg, zigzag

#: Magics, ways of storing, pixel formats, palette layouts.
MAGIC, TILE = b"dmp2", b"KCBC"
PLAIN, SPLIT, LOSSLESS, PALETTE = 1, 2, 3, 4
G8, GA88, RGB888, RGBA8888 = 1, 2, 3, 4
ALPHA_AND_INDEX, INDEX = 3, 4
#: Lossless pixels of fewer bytes than this may be a bare LZVN stream.
SMALL = 0x1000


class ImageError(ValueError):
    """An image that cannot be decoded; ``code`` names the kind of fault."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


def _bad(message: str) -> ImageError:
    return ImageError("InvalidData", message)


@dataclass(frozen=True)
class Header:
    way: int
    shift: bool
    format: int
    width: int
    height: int
    palette_layout: int = 0
    palette: tuple[int, ...] = ()
    size: int = 12

    @property
    def has_alpha(self) -> bool:
        return self.format in (GA88, RGBA8888)

    @property
    def streams(self) -> int:
        """Samples of a pixel besides alpha."""
        return 3 if self.format in (RGB888, RGBA8888) else 1


def header(data: bytes) -> Header:
    try:
        magic, way, shift, _, form, width, height = struct.unpack_from("<4s4B2H", data)
        if magic != MAGIC:
            raise ImageError("DekuParse", "no deep-map magic")
        if way != PALETTE:
            return Header(way, shift != 0, form, width, height)
        count, layout = struct.unpack_from("<2H", data, 12)
        return Header(way, shift != 0, form, width, height, layout, struct.unpack_from(f"<{count}I", data, 16), 16 + 4 * count)
    except struct.error:
        raise ImageError("DekuParse", "the header is cut off") from None


def prefixed(payload: bytes) -> list[bytes] | None:
    """The parts of a payload that is nothing but parts with their sizes before them; else None."""
    out, at = [], 0
    while at + 4 <= len(payload):
        (size,) = struct.unpack_from("<I", payload, at)
        at += 4 + size
        if not size or at > len(payload):
            return None
        out.append(payload[at - size : at])
    return out if out and at == len(payload) else None


def _unpacked(data: bytes) -> bytes:
    try:
        out = lzfse(data)
    except StreamError as e:
        raise ImageError("LzfseDecompress", str(e)) from None
    if data and not out:
        raise ImageError("LzfseDecompress", "no output")
    return out


def _either(data: bytes, size: int, small_first: bool) -> bytes:
    """LZFSE, or a bare LZVN stream of ``size`` bytes; the order decides which error counts."""
    if small_first:
        try:
            return lzvn(data, size)
        except StreamError:
            return _unpacked(data)
    try:
        return _unpacked(data)
    except ImageError:
        try:
            return lzvn(data, size)
        except StreamError:
            pass
        raise


def split_rows(head: Header, raw: bytes, rows: int, above: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(rows, width, 4) bytes of split streams, and the last row's samples for those that go on from it.

    ``raw`` has the alpha plane if any, a predictor for each row, and the high
    and low bytes of all samples.  The colours come out as blue, green, red.
    """
    w, n = head.width, head.streams
    alpha = w * rows if head.has_alpha else 0
    if len(raw) < alpha + rows + 2 * w * n * rows:
        raise _bad(f"{len(raw)} bytes for {rows} rows of {w} pixels")
    data = np.frombuffer(raw, np.uint8)
    kinds = data[alpha : alpha + rows]
    high, low = data[alpha + rows :][: 2 * w * n * rows].reshape(2, rows, w * n)
    samples = zigzag(low, high).reshape(rows, w, n)
    if n == 1:  # predictors work on triples
        samples = np.concatenate([samples, np.zeros((rows, w, 2), np.int16)], axis=2)
    done = np.empty((rows, w, 3), np.int16)
    for k in range(rows):
        above = predict(samples[k].reshape(-1), above, int(kinds[k]))
        done[k] = above.reshape(w, 3)
    out = np.full((rows, w, 4), 255, np.uint8)
    if n == 3:
        out[..., :3] = ycocg(done[..., 0], done[..., 1], done[..., 2], head.shift)[..., ::-1]
    else:
        out[..., :3] = done[..., :1].astype(np.uint8)
    if alpha:
        out[..., 3] = data[:alpha].reshape(rows, w)
    return out, above


def _split(head: Header, payload: bytes, rows: int, above: np.ndarray | None, carry: bool) -> tuple[np.ndarray, np.ndarray | None]:
    parts = prefixed(payload)
    if parts is None:
        return split_rows(head, _unpacked(payload), rows, above)
    row_size, done, out = (head.width if head.has_alpha else 0) + 1 + 2 * head.width * head.streams, 0, []
    for part in parts:
        if done == rows:
            break
        raw = _unpacked(part)
        held = len(raw) // row_size
        if not held:
            raise _bad("a part holds no row")
        take = min(held, rows - done)
        image, last = split_rows(head, raw, take, above)
        above = last if carry else None
        out.append(image)
        done += take
    if done != rows:
        raise _bad(f"{done} rows of {rows}")
    return np.concatenate(out), above


def _direct(head: Header, payload: bytes, rows: int, packed: bool) -> np.ndarray:
    """Pixels stored as they are, blue first."""
    size = head.width * rows * head.format
    raw = _either(payload, size, True) if packed and size < SMALL else _unpacked(payload) if packed else payload
    if len(raw) < size:
        raise _bad(f"{len(raw)} bytes of {size}")
    v = np.frombuffer(raw, np.uint8, size).reshape(rows, head.width, head.format)
    out = np.full((rows, head.width, 4), 255, np.uint8)
    if head.streams == 3:
        out[..., :3] = v[..., 2::-1]
    else:
        out[..., :3] = v[..., :1]
    if head.has_alpha:
        out[..., 3] = v[..., -1]
    return out


def _lossless(head: Header, payload: bytes, rows: int) -> np.ndarray:
    parts = prefixed(payload)
    if parts is None:
        return _direct(head, payload, rows, True)
    out, done = [], 0
    for part in parts:
        if done == rows:
            raise _bad("more parts than rows")
        take = min(head.height, rows - done)
        out.append(_direct(head, part, take, True))
        done += take
    if done != rows:
        raise _bad(f"{done} rows of {rows}")
    return np.concatenate(out)


def palette_colors(entries: tuple[int, ...]) -> np.ndarray:
    """RGBA of the 256 indices; those without an entry are all zero."""
    v = np.zeros(256, np.uint32)
    v[: min(256, len(entries))] = entries[:256]
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24], axis=-1).astype(np.uint8)


def _palette(head: Header, payload: bytes, rows: int) -> np.ndarray:
    if not head.palette:
        raise _bad("no palette")
    if head.palette_layout not in (ALPHA_AND_INDEX, INDEX):
        raise ImageError("InvalidPaletteType", f"palette layout {head.palette_layout}")
    count = head.width * rows
    size = count * (2 if head.palette_layout == ALPHA_AND_INDEX else 1)
    raw = bytearray()
    for part in prefixed(payload) or [payload]:
        if len(raw) < size or not raw:
            raw += _either(part, size - len(raw), False)
    if len(raw) < size:
        raise _bad(f"{len(raw)} bytes of {size}")
    v = np.frombuffer(raw, np.uint8)
    out = palette_colors(head.palette)[v[size - count : size]]
    if head.palette_layout == ALPHA_AND_INDEX:
        out[:, 3] = v[:count]
    return out.reshape(rows, head.width, 4)


def decode(data: bytes, width: int | None = None, height: int | None = None, form: int | None = None, above: np.ndarray | None = None, carry: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The RGBA image of one deep map, and with ``carry`` the samples that a next one may go on from.

    Width, height and pixel format replace those of the header.
    """
    head = header(data)
    payload = bytes(data[head.size :])
    if form is not None:
        head = replace(head, format=form)
    if head.format not in (G8, GA88, RGB888, RGBA8888):
        raise ImageError("UnsupportedPixelFormat", f"pixel format {head.format}")
    head = replace(head, width=head.width if width is None else width)
    rows = head.height if height is None else height
    if head.way == SPLIT:
        return _split(head, payload, rows, above if carry else None, carry)
    if head.way == LOSSLESS:
        return _lossless(head, payload, rows), None
    if head.way == PLAIN:
        return _direct(head, payload, rows, False), None
    if head.way == PALETTE:
        return _palette(head, payload, rows), None
    raise ImageError("UnsupportedDecodeType", f"way {head.way}")


@dataclass(frozen=True)
class Tile:
    column: int
    row: int
    rows: int
    data: bytes


def tiles(data: bytes) -> list[Tile]:
    """The tiles of a grid in the order they are stored."""
    out, at = [], data.find(TILE)
    while at >= 0:
        if at + 20 > len(data):
            raise _bad("a tile's head is cut off")
        column, row, rows, size = struct.unpack_from("<4I", data, at + 4)
        end = at + size if size >= 0x20 and at + size <= len(data) else data.find(TILE, at + 4)
        if end < 0:
            end = len(data)
        inside = data.find(MAGIC, at, end)
        if inside < 0:
            raise _bad("a tile holds no deep map")
        out.append(Tile(column, row, rows, data[inside:end]))
        at = data.find(TILE, end)
    if not out:
        raise _bad("no tile")
    return out


def decode_tiles(data: bytes, width: int | None = None, height: int | None = None, form: int | None = None) -> np.ndarray:
    """The image of a grid; columns are as wide as their widest tile, rows as high as their highest."""
    done = []
    for t in tiles(data):
        if t.rows > 0xFFFF:
            raise _bad(f"a tile of {t.rows} rows")
        done.append((t, decode(t.data, None, t.rows or None, form)[0]))
    wide: dict[int, int] = {}
    high: dict[int, int] = {}
    for t, image in done:
        wide[t.column] = max(wide.get(t.column, 0), image.shape[1])
        high[t.row] = max(high.get(t.row, 0), image.shape[0])
    places = []
    for sizes, want, what in ((wide, width, "width"), (high, height, "height")):
        total, place = 0, {}
        for k in sorted(sizes):
            place[k] = total
            total += sizes[k]
        if want is not None and total != want:
            raise _bad(f"{what} {total} instead of {want}")
        places.append((place, total))
    (left, columns), (top, rows) = places
    out = np.zeros((rows, columns, 4), np.uint8)
    for t, image in done:
        y, x = top[t.row], left[t.column]
        out[y : y + image.shape[0], x : x + image.shape[1]] = image
    return out


def region(chunk: bytes, at: int) -> bytes:
    """The deep map at a place of a chunk: up to the end of the tile around it, or to the next tile."""
    around = chunk.find(TILE, max(0, at - 0x40), at)
    if around >= 0 and around + 20 <= len(chunk):
        (size,) = struct.unpack_from("<I", chunk, around + 16)
        if size >= 0x20 and at < around + size <= len(chunk):
            return chunk[at : around + size]
    after = chunk.find(TILE, at + 4)
    return chunk[at : after if after >= 0 else len(chunk)]


def encode(way: int, form: int, width: int, height: int, payload: bytes, shift: bool = False, palette: tuple[int, ...] = (), layout: int = INDEX) -> bytes:
    """A deep map of a payload that is packed already."""
    head = MAGIC + bytes([way, shift, 0, form]) + struct.pack("<2H", width, height)
    if way == PALETTE:
        head += struct.pack(f"<2H{len(palette)}I", len(palette), layout, *palette)
    return head + payload


def encode_tile(column: int, row: int, rows: int, data: bytes) -> bytes:
    return TILE + struct.pack("<4I", column, row, rows, 20 + len(data)) + data
