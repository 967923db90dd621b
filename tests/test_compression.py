"""Streams against hand-made ones and against an entropy coder written for this test."""

import gzip
import random
import struct
import zlib

import numpy as np
import pytest

from assetspark.functions import compression as C
from assetspark.plans import samples


def test_lzvn_operations():
    # six literals and a match of 5 at distance 3, a match at the last distance, a long run, a long match
    data = bytes([0xE6]) + b"abcdef" + bytes([0x10, 0x03, 0xF4]) + bytes([0xE0, 0x04]) + bytes(range(20)) + bytes([0xF0, 0x00]) + b"\x0e\x16" + b"\6" + bytes(7)
    out = bytearray(b"abcdef")
    for n in (5, 4):
        for _ in range(n):
            out.append(out[-3])
    out += bytes(range(20))
    for _ in range(16):
        out.append(out[-3])
    assert C.lzvn(data, len(out)) == bytes(out)
    # literals, middle and large distances
    data = bytes([0xE0, 84]) + bytes(range(100)) + bytes([0xB0 | 0x08 | 1, 0x02 | 50 << 2 & 0xFF, 50 >> 6]) + b"Z" * 3 + bytes([0x47, 100, 0]) + b"Y" + b"\6" + bytes(7)
    out = bytearray(range(100)) + b"ZZZ"
    for _ in range((1 << 2 | 2) + 3):
        out.append(out[-50])
    out += b"Y"
    for _ in range(3):
        out.append(out[-100])
    assert C.lzvn(data, len(out)) == bytes(out)
    for bad in (b"", b"\xe5ab", b"\x1e", b"\x70", b"\xd0", bytes([0x08, 0x01]), b"\xe1a"):
        with pytest.raises(C.StreamError):
            C.lzvn(bad, 1)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 271, 272, 5000])
def test_plain_writers(n):
    data = random.Random(n).randbytes(n)
    assert C.lzvn(C.lzvn_literals(data), n) == data
    assert C.lzfse(C.lzfse_raw(data)) == data and C.lzfse(C.lzfse_vn(data)) == data
    assert C.lzfse(C.lzfse_raw(data) + b"\0\0" + C.lzfse_vn(b"more")) == data + b"more"
    assert C.gunzip(gzip.compress(data) + gzip.compress(b"end")) == data + b"end"


class Writer:
    """Bits of a payload that is read from its end."""

    def __init__(self):
        self.value = self.size = 0

    def put(self, v, n):
        self.value |= v << self.size
        self.size += n

    def done(self):
        n = -(-self.size // 8)
        return self.value.to_bytes(n, "little"), self.size - 8 * n


def shares(symbols, kinds, states):
    n = np.bincount(symbols, minlength=kinds).astype(float)
    out = np.where(n > 0, np.maximum(1, np.floor(n / max(1, n.sum()) * (states - kinds))), 0).astype(int) if n.sum() else np.zeros(kinds, int)
    out[int(np.argmax(out))] += states - out.sum()
    return out.tolist()


def coder(counts, states):
    at, out = 0, []
    for n in counts:
        k = states.bit_length() - n.bit_length() if n else 0
        out.append((n << k, k, at, n))
        at += n
    return out


def put(table, state, symbol, states, bits):
    """Encodes a symbol: writes low bits and gives the state before it."""
    least, k, at, n = table[symbol]
    full = state + states
    take = k if full >= least else k - 1
    bits.put(full & (1 << take) - 1, take)
    return at + (full >> take) - n


def value_symbol(v, extra):
    base = 0
    for s, e in enumerate(extra):
        if base <= v < base + (1 << e):
            return s, v - base, e
        base += 1 << e
    raise ValueError(v)


def freq_code(v):
    if v < 2:
        return v << 1, 2
    if v < 4:
        return 1 | (v - 2) << 2, 3
    if v < 8:
        return 3 | (v - 4) << 3, 5
    if v < 24:
        return 7 | (v - 8) << 4, 8
    return 15 | (v - 24) << 4, 14


def block(text, commands, size):
    """A packed block of literals and (run, match, distance) commands."""
    text = text + bytes(-len(text) % 4)
    kinds, extra = (20, 20, 64, 256), (C.RUN_EXTRA, C.MATCH_EXTRA, C.DISTANCE_EXTRA)
    coded = [[value_symbol(v, extra[k]) for k, v in enumerate(c)] for c in commands]
    counts = [shares([c[k][0] for c in coded], kinds[k], C.STATES[k]) for k in range(3)] + [shares(list(text), 256, 1024)]
    tables = [coder(c, s) for c, s in zip(counts, C.STATES, strict=True)]
    bits, states = Writer(), [0, 0, 0, 0]
    for k in range(len(text) - 1, -1, -1):
        states[k & 3] = put(tables[3], states[k & 3], text[k], 1024, bits)
    literal, spare = bits.done()
    bits, at = Writer(), [0, 0, 0]
    for c in reversed(coded):
        for k in (2, 1, 0):
            s, more, n = c[k]
            bits.put(more, n)
            at[k] = put(tables[k], at[k], s, C.STATES[k], bits)
    code, code_spare = bits.done()
    freq = Writer()
    for n in sum(counts, []):
        freq.put(*freq_code(n))
    head = freq.value.to_bytes(-(-freq.size // 8), "little")
    a = len(text) | len(literal) << 20 | len(commands) << 40 | spare + 7 << 60
    b = sum(s << 10 * k for k, s in enumerate(states)) | len(code) << 40 | code_spare + 7 << 60
    c = 32 + len(head) | at[0] << 32 | at[1] << 42 | at[2] << 52
    packed = struct.pack("<4sI3Q", C.PACKED, size, a, b, c) + head + literal + code
    n_payload = len(literal) + len(code)
    plain = struct.pack("<4s6Ii4Hi3H360H", C.TABLES, size, n_payload, len(text), len(commands), len(literal), len(code), spare, *states, code_spare, *at, *sum(counts, [])) + b"\0\0" + literal + code
    return packed, plain


@pytest.mark.parametrize("seed", range(12))
def test_entropy_coded_blocks(seed):
    rng = random.Random(seed)
    out, text, commands, last = bytearray(), bytearray(), [], 0
    for k in range(rng.choice([1, 5, 60, 400])):
        run = rng.choice([0, 1, 3, 15, 16, 19, 21, 40, 100]) if k else rng.randint(5, 300)
        part = bytes(rng.choice(b"aaaaabcdefgh \n") for _ in range(run)) if seed % 2 else rng.randbytes(run)
        text += part
        out += part
        match = rng.choice([0, 3, 4, 15, 20, 30, 100, 400])
        far = rng.randint(1, min(len(out), rng.choice([4, 60, 5000, 200_000])))
        commands.append((run, match, 0 if far == last and k else far))
        last = far
        for _ in range(match):
            out.append(out[-far])
    for made in block(bytes(text), commands, len(out)):
        assert C.lzfse(made + C.RAW + struct.pack("<I", 3) + b"end" + C.END) == bytes(out) + b"end"
        for cut in (20, len(made) // 2):
            with pytest.raises(C.StreamError):
                C.lzfse(made[:cut])


def test_zlib_literals_are_eight_bytes_longer():
    for data in (b"", b"1:1", b"9999:5", b"1111111:5", b"1" * 400, bytes(range(144))):
        made = C.zlib_literals(data)
        assert zlib.decompress(made) == data and len(made) == len(data) + 8


def test_sample_rasters_have_the_size_that_sql_says():
    # parts whose digits repeat, which zlib would store as matches
    for p, ln, data in ((5555, 1, b"5555:1"), (9996, 5, b"9996:5"), (99991, 5, b"99991:5"), (1111111, 5, b"1111111:5")):
        _, made = samples.rendition(p, ln, "Brand#11", 3, 0.0, 0.0)
        assert samples.kind_of(p, ln) == 1 and made.endswith(struct.pack("<I", len(data) + 8) + C.zlib_literals(data))
