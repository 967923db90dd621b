"""Pixel kernels against hand-made vectors."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from assetspark.functions import pixels


def test_premultiplied_colours_are_swizzled_and_divided():
    eight = pixels.to_rgba(bytes([10, 20, 30, 255, 32, 64, 128, 128]), "ARGB", 2, 1)
    assert eight.tolist() == [[[30, 20, 10, 255], [255, 128, 64, 128]]]
    wide = pixels.to_rgba(struct.pack("<4H", 8192, 16384, 32768, 32768), "RGBW", 1, 1)
    assert wide.tolist() == [[[65535, 32768, 16384, 32768]]]
    assert pixels.to_rgba(bytes([9, 9, 9, 0]), "ARGB", 1, 1).tolist() == [[[9, 9, 9, 0]]]


def test_small_encodings():
    assert pixels.to_rgba(struct.pack("<H", 0x7C00), "RGB5", 1, 1).tolist() == [[[255, 0, 0, 255]]]
    assert pixels.to_rgba(bytes([7]), "GRAY", 1, 1).tolist() == [[[7, 7, 7, 255]]]
    assert pixels.to_rgba(bytes([7, 8]), "GA8 ", 1, 1).tolist() == [[[7, 7, 7, 8]]]
    with pytest.raises(ValueError):
        pixels.to_rgba(b"", "JPEG", 0, 0)


def test_rows_lose_their_padding():
    assert pixels.strip_rows(b"ab__cd__", 2, 1, 4) == b"abcd"
    assert pixels.strip_rows(b"abcd", 2, 1, None) == b"abcd"
    with pytest.raises(ValueError):
        pixels.strip_rows(b"abcd", 4, 1, 2)


def test_crop_counts_from_the_lower_left():
    image = np.arange(48).reshape(4, 12, 1)
    assert (pixels.crop(image, 6, 2, 6, 2) == image[:2, 6:]).all()
    with pytest.raises(ValueError):
        pixels.crop(np.zeros((4, 4, 4)), 0, 2, 4, 8)


def test_orientation():
    image = np.array([[1, 2], [3, 4]])
    assert pixels.orient(image, 6).tolist() == [[3, 1], [4, 2]]
    assert pixels.orient(image, 1).tolist() == image.tolist()
    back = {2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}
    for turn, undo in back.items():
        assert pixels.orient(pixels.orient(image, turn), undo).tolist() == image.tolist()


def test_predictors():
    assert pixels.predict([1, 2, 3, 4, 5, 6], None, 2).tolist() == [1, 2, 3, 5, 7, 9]
    assert pixels.predict([0, 0, 0, 2, 4, 6], [10, 20, 30, 40, 50, 60], 4).tolist() == [10, 20, 30, 27, 39, 51]
    assert pixels.predict([1, 1, 1], [10, 20, 30], 3).tolist() == [11, 21, 31]
    assert pixels.predict([32767, 0, 0, 1, 0, 0], None, 2)[3] == -32768


def test_colour_lifting():
    assert pixels.ycocg(85, 128, -85).tolist() == [191, 42, 63]


def test_png_holds_the_image():
    image = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    data = pixels.png(image)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">2I", data[16:24]) == (3, 2)
    size = struct.unpack(">I", data[33:37])[0]
    rows = zlib.decompress(data[41 : 41 + size])
    assert rows == b"\0" + image[0].tobytes() + b"\0" + image[1].tobytes()
