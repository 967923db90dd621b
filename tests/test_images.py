"""Payloads, deep maps and pictures against hand-made vectors."""

import gzip
import struct

import numpy as np
import pytest

from assetspark.functions import compression as Z
from assetspark.functions import deepmap as D
from assetspark.functions import images as I
from assetspark.functions.pixels import orient


def theme(encoding, w, h, compression, *chunks, tlvs=()):
    parts = [c if isinstance(c, tuple) else (None, c) for c in chunks]
    return {"rendition_kind": "ThemeCBCK", "encoding": encoding, "width": w, "height": h, "compression": compression, "tlvs": [{"tag": t, "body": b} for t, b in tlvs],
            "chunks": [{"no": k, "height": a, "data": d} for k, (a, d) in enumerate(parts)], "raw": None, "components": None, "sizes": None}


def code(call):
    with pytest.raises(D.ImageError) as e:
        call()
    return e.value.code


def test_chunks_are_put_together():
    assert I.decoded(theme("GRAY", 4, 2, 2, gzip.compress(bytes([1, 2, 3, 4])), gzip.compress(bytes([5, 6, 7, 8])))) == bytes(range(1, 9))
    assert I.decoded(theme("GRAY", 2, 2, 0, b"ab", b"cd")) == b"abcd"
    assert I.decoded(theme("GRAY", 2, 2, 4, Z.lzfse_raw(b"ab"), Z.lzfse_vn(b"cd"))) == b"abcd"
    assert code(lambda: I.decoded(theme("GRAY", 2, 2, 4, Z.lzfse_raw(b"")))) == "DecodeFailed"
    assert code(lambda: I.decoded(theme("GRAY", 2, 2, 2, b"no gzip"))) == "DecodeFailed"
    for way in (1, 5, 6, 7, 8, 9, 10, 77):
        assert code(lambda: I.decoded(theme("GRAY", 2, 2, way, b""))) == "UnsupportedCompression"


def test_lzvn_takes_its_size_from_the_rows():
    rows = bytes([1, 2, 0, 0, 3, 4, 0, 0, 5, 6, 0, 0])
    r = theme("GRAY", 2, 3, 3, Z.lzvn_literals(rows), tlvs=[(1007, struct.pack("<I", 4))])
    assert I.decoded(r) == rows
    assert I.image(r)[..., 0].tolist() == [[1, 2], [3, 4], [5, 6]]
    parts = theme("GRAY", 2, 3, 3, (1, Z.lzvn_literals(rows[:4])), (2, Z.lzvn_literals(rows[4:])), tlvs=[(1007, struct.pack("<I", 4))])
    assert I.decoded(parts) == rows
    assert code(lambda: I.decoded(theme("GRAY", 2, 3, 3, (0, b""), (2, b"")))) == "DecodeFailed"
    assert code(lambda: I.decoded(theme("JPEG", 2, 3, 3, b""))) == "DecodeFailed"
    assert code(lambda: I.decoded(theme("GRAY", 8, 3, 3, b"", tlvs=[(1007, struct.pack("<I", 4))]))) == "DecodeFailed"
    assert code(lambda: I.decoded(theme("GRAY", 2, 2, 3, Z.lzvn_literals(b"abc")))) == "Deepmap2"


@pytest.mark.parametrize(("r", "stage"), [
    (theme("GRAY", 2, 2, 0, b"abcd"), "Uncompressed"), (theme("GRAY", 2, 2, 4, Z.lzfse_raw(b"abcd")), "Lzfse"), (theme("GRAY", 2, 2, 2, gzip.compress(b"abcd")), "Zip"),
    (theme("GRAY", 2, 2, 3, Z.lzvn_literals(b"abcd")), "Lzvn"), (theme("GRAY", 2, 2, 11, D.encode(1, 1, 2, 2, b"abcd")), "Deepmap2"),
    ({"rendition_kind": "RawData", "raw": b"abcd"}, "BorrowedPayload"), ({"rendition_kind": "Color", "components": [1.0]}, "BorrowedPayload"),
])
def test_budget_by_stage(r, stage):
    with pytest.raises(D.ImageError, match=stage) as e:
        I.decoded(r, 3)
    assert e.value.code == "DecodeBudgetExceeded" and I.decoded(r, 16)


def test_pixels_by_encoding():
    assert I.image(theme("ARGB", 2, 1, 0, bytes([10, 20, 30, 255, 32, 64, 128, 128]))).tolist() == [[[30, 20, 10, 255], [255, 128, 64, 128]]]
    assert I.image(theme("RGBW", 1, 1, 0, struct.pack("<4H", 8192, 16384, 32768, 32768))).tolist() == [[[65535, 32768, 16384, 32768]]]
    assert I.image(theme("RGB5", 1, 1, 0, struct.pack("<H", 0x7C00))).tolist() == [[[255, 0, 0]]]
    assert I.rgba(I.image(theme("GA8 ", 1, 1, 0, bytes([7, 9])))).tolist() == [[[7, 7, 7, 9]]]
    assert I.rgba(I.image(theme("GA16", 1, 1, 0, struct.pack("<2H", 65535, 32768)))).tolist() == [[[255, 255, 255, 128]]]
    assert code(lambda: I.image(theme("GRAY", 3, 3, 0, b"abcd"))) == "DecodeFailed"
    assert code(lambda: I.image(theme("JPEG", 3, 3, 0, b"abcd"))) == "UnsupportedEncoding"
    assert code(lambda: I.image(theme("PDF ", 3, 3, 0, b"abcd"))) == "UnsupportedEncoding"
    assert code(lambda: I.image({"rendition_kind": "Color", "encoding": "None"})) == "UnsupportedEncoding"
    turned = theme("GRAY", 2, 2, 0, bytes([1, 2, 3, 4]), tlvs=[(1006, struct.pack("<I", 6)), (1006, struct.pack("<I", 1))])
    assert I.image(turned, exif=True)[..., 0].tolist() == [[3, 1], [4, 2]] and I.image(turned)[..., 0].tolist() == [[1, 2], [3, 4]]


def test_crops_from_the_lower_left():
    v = np.arange(48, dtype=np.uint8).reshape(4, 12, 1)
    rect = lambda *a: dict(zip(("x", "y", "width", "height"), a, strict=True))
    assert I.cropped(v, [rect(6, 2, 6, 2)])[..., 0].tolist() == v[:2, 6:, 0].tolist()
    assert I.cropped(v, [rect(6, 2, 6, 2), rect(1, 0, 2, 1)])[..., 0].tolist() == v[1:2, 7:9, 0].tolist()
    assert code(lambda: I.cropped(v[:4, :4], [rect(0, 2, 4, 8)])) == "DecodeFailed"


def test_deep_maps():
    one = lambda *a, **k: D.decode(D.encode(*a, **k))[0]
    assert one(D.PLAIN, D.G8, 2, 1, bytes([5, 6])).tolist() == [[[5, 5, 5, 255], [6, 6, 6, 255]]]
    assert one(D.PLAIN, D.GA88, 1, 1, bytes([5, 6])).tolist() == [[[5, 5, 5, 6]]]
    assert one(D.PLAIN, D.RGB888, 1, 1, bytes([1, 2, 3])).tolist() == [[[3, 2, 1, 255]]]
    assert one(D.LOSSLESS, D.RGBA8888, 1, 1, Z.lzfse_raw(bytes([1, 2, 3, 4]))).tolist() == [[[3, 2, 1, 4]]]
    big = np.random.default_rng(0).integers(0, 256, 64 * 80, dtype=np.uint8)
    assert (one(D.LOSSLESS, D.G8, 80, 64, Z.lzfse_raw(big.tobytes()))[..., 0] == big.reshape(64, 80)).all()
    parts = b"".join(struct.pack("<I", len(x)) + x for x in (Z.lzvn_literals(b"ab"), Z.lzvn_literals(b"cd")))
    assert D.decode(D.encode(D.LOSSLESS, D.G8, 2, 1, parts), height=2)[0][..., 0].tolist() == [[97, 98], [99, 100]]
    colors = (0xFF030201, 0x80060504)
    assert one(D.PALETTE, D.G8, 3, 1, Z.lzfse_raw(bytes([0, 1, 9])), palette=colors).tolist() == [[[3, 2, 1, 255], [6, 5, 4, 128], [0, 0, 0, 0]]]
    assert one(D.PALETTE, D.G8, 2, 1, Z.lzvn_literals(bytes([7, 8, 0, 1])), palette=colors, layout=3).tolist() == [[[3, 2, 1, 7], [6, 5, 4, 8]]]
    faults = [
        (D.encode(D.PALETTE, D.G8, 1, 1, b"", palette=()), "InvalidData"), (D.encode(D.PALETTE, D.G8, 1, 1, b"", palette=(1,), layout=9), "InvalidPaletteType"),
        (D.encode(D.PLAIN, 9, 1, 1, b"a"), "UnsupportedPixelFormat"), (D.encode(8, 1, 1, 1, b"a"), "UnsupportedDecodeType"), (D.encode(D.PLAIN, 1, 2, 2, b"a"), "InvalidData"),
        (D.encode(D.SPLIT, 1, 2, 2, b"nothing"), "LzfseDecompress"), (b"dmpX", "DekuParse"), (b"abc", "DekuParse"),
    ]
    for data, want in faults:
        assert code(lambda: D.decode(data)) == want


def split(w, h, form, kinds, samples, alpha=b""):
    coded = [2 * abs(v) + (v < 0) for v in samples]
    return alpha + bytes(kinds) + bytes(v >> 8 for v in coded) + bytes(v & 255 for v in coded)


def test_split_streams():
    raw = split(2, 2, D.G8, [2, 3], [50, 5, 3, -2])
    assert D.decode(D.encode(D.SPLIT, D.G8, 2, 2, Z.lzfse_raw(raw)))[0][..., 0].tolist() == [[50, 55], [53, 53]]
    # luma 85, chroma 128 and -85 are red 191, green 42, blue 63; the split way gives blue, green, red
    raw = split(1, 1, D.RGBA8888, [0], [85, 128, -85], alpha=bytes([200]))
    assert D.decode(D.encode(D.SPLIT, D.RGBA8888, 1, 1, Z.lzfse_raw(raw)))[0].tolist() == [[[63, 42, 191, 200]]]
    # parts: each starts anew, or goes on from the last row
    parts = [Z.lzfse_raw(split(1, 1, D.G8, [3], [9])), Z.lzfse_raw(split(1, 1, D.G8, [3], [4]))]
    data = D.encode(D.SPLIT, D.G8, 1, 2, b"".join(struct.pack("<I", len(x)) + x for x in parts))
    assert D.decode(data)[0][..., 0].tolist() == [[9], [4]] and D.decode(data, carry=True)[0][..., 0].tolist() == [[9], [13]]
    assert code(lambda: D.decode(data, height=9)) == "InvalidData"


def test_grids():
    tile = lambda v, w=1, h=1: D.encode(D.PLAIN, D.G8, w, h, bytes([v]) * (w * h))
    data = b"junk" + b"".join(D.encode_tile(x, y, 0, tile(1 + x + 2 * y)) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1)))
    assert D.decode_tiles(data)[..., 0].tolist() == [[1, 2], [3, 4]]
    uneven = D.encode_tile(5, 2, 1, tile(7, 2, 3)) + D.encode_tile(9, 2, 0, tile(8, 1, 2))
    assert D.decode_tiles(uneven)[..., 0].tolist() == [[7, 7, 8], [0, 0, 8]]
    assert code(lambda: D.decode_tiles(uneven, width=2)) == "InvalidData"
    assert code(lambda: D.tiles(b"none")) == code(lambda: D.tiles(b"KCBC123")) == code(lambda: D.tiles(b"KCBC" + bytes(40))) == "InvalidData"
    r = theme("ARGB", 2, 2, 11, b"".join(D.encode_tile(x, 0, 0, D.encode(D.PLAIN, D.RGBA8888, 1, 2, bytes([1, 2, 3, 255] * 2))) for x in (0, 1)))
    assert I.image(r).tolist() == [[[3, 2, 1, 255]] * 2] * 2
    assert code(lambda: I.image(theme("GRAY", 2, 2, 11, b"no magic"))) == "DecodeFailed"
    assert code(lambda: I.image(theme("GRAY", 2, 3, 11, (1, tile(1, 2, 1)), (1, tile(1, 2, 1))))) == "DecodeFailed"
    assert I.image(theme("GRAY", 2, 2, 11, (1, tile(1, 2, 1)), (1, tile(2, 2, 1))))[..., 0].tolist() == [[1, 1], [2, 2]]


def test_original_files():
    body = struct.pack(">I", 24) + b"ftypmif1" + bytes(12) + b"rest"
    wrap = struct.pack("<2I", 1, len(body)) + body
    assert I.original(theme("ARGB", 1, 1, 9, wrap)) == body
    for bad in (wrap[:20], wrap + b"x", wrap.replace(b"ftyp", b"mdat"), wrap.replace(b"mif1", b"isom")):
        assert code(lambda: I.heif(bad)) == "DecodeFailed"
    assert code(lambda: I.original(theme("ARGB", 1, 1, 9, wrap, wrap))) == "DecodeFailed"
    raw = {"rendition_kind": "RawData", "encoding": "PDF ", "raw": b"%PDF", "compression": None}
    assert I.original(raw) == b"%PDF" and I.original(raw | {"raw": Z.lzfse_vn(b"text")}) == b"text"
    assert code(lambda: I.original(raw | {"raw": b"bvx2"})) == "NativeFallbackUnavailable"
    assert I.original(theme("SVG ", 1, 1, 0, Z.lzfse_raw(b"<s"), b"vg>")) == b"<svg>"
    assert I.original(theme("DATA", 1, 1, 2, gzip.compress(b"zip"))) == b"zip"
    assert code(lambda: I.original(theme("ARGB", 1, 1, 0, b""))) == "UnsupportedEncoding"
    assert I.recoverable("Deepmap2") and not I.recoverable("DecodeBudgetExceeded")


def test_thumbnails_fit():
    v = np.full((100, 50, 4), 200, np.uint8)
    assert I.thumbnail(v, 25).shape == (25, 12, 4) and (I.thumbnail(v, 25) == 200).all()
    assert I.thumbnail(v, 100) is v and I.thumbnail(np.zeros((300, 1, 1), np.uint8), 10).shape == (10, 1, 1)
    assert orient(v, 6).shape == (50, 100, 4)
