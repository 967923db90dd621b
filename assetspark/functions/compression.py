"""The compressed streams of asset catalogs: LZVN, LZFSE and gzip, each from bytes to bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: What the blocks of a stream begin with.
END, RAW, TABLES, PACKED, VN = b"bvx$", b"bvx-", b"bvx1", b"bvx2", b"bvxn"
STREAM = (PACKED, VN, RAW, END)
#: Bytes before a stream, or between two of them, that are passed over.
SLACK = 8
#: Extra bits of the literal-run, match and distance symbols, in order.
RUN_EXTRA = [0] * 16 + [2, 3, 5, 8]
MATCH_EXTRA = [0] * 16 + [3, 5, 8, 11]
DISTANCE_EXTRA = [k // 4 for k in range(64)]
#: States of the tables for runs, matches, distances and literals.
STATES = (64, 64, 256, 1024)


class StreamError(ValueError):
    """The bytes are not a whole stream."""


def _repeat(out: bytearray, distance: int, length: int) -> None:
    at = len(out) - distance
    if distance <= 0 or at < 0:
        raise StreamError("a match begins before the output")
    if distance >= length:
        out += out[at : at + length]
    else:
        piece = bytes(out[at:])
        out += (piece * (length // distance + 1))[:length]


def _lzvn(data: bytes, out: bytearray) -> int:
    """Appends a stream's output; the place after its end."""
    at, distance, size = 0, 0, len(data)
    try:
        while True:
            op = data[at]
            run = match = 0
            if op >= 0xF0:  # match with the last distance
                match, at = (data[at + 1] + 16, at + 2) if op == 0xF0 else (op & 15, at + 1)
            elif op >= 0xE0:  # literals only
                run, at = (data[at + 1] + 16, at + 2) if op == 0xE0 else (op & 15, at + 1)
            elif 0xA0 <= op <= 0xBF:  # middle distance
                word = data[at + 1] | data[at + 2] << 8
                run, match, distance, at = op >> 3 & 3, ((op & 7) << 2 | word & 3) + 3, word >> 2, at + 3
            elif 0x70 <= op <= 0x7F or 0xD0 <= op <= 0xDF:
                raise StreamError(f"operation {op:#x}")
            elif op & 7 == 7:  # large distance
                run, match, distance, at = op >> 6, (op >> 3 & 7) + 3, data[at + 1] | data[at + 2] << 8, at + 3
            elif op & 7 == 6:
                if op >= 0x40:
                    run, match, at = op >> 6, (op >> 3 & 7) + 3, at + 1
                elif op == 0x06:
                    return at + 8
                elif op in (0x0E, 0x16):
                    at += 1
                    continue
                else:
                    raise StreamError(f"operation {op:#x}")
            else:
                run, match, distance, at = op >> 6, (op >> 3 & 7) + 3, (op & 7) << 8 | data[at + 1], at + 2
            if run:
                if at + run > size:
                    raise StreamError("literals run over the end")
                out += data[at : at + run]
                at += run
            if match:
                _repeat(out, distance, match)
    except IndexError:
        raise StreamError("the stream is cut off") from None


def lzvn(data: bytes, size: int) -> bytes:
    """The output of a bare LZVN stream, which has just ``size`` bytes."""
    out = bytearray()
    _lzvn(bytes(data), out)
    if len(out) != size:
        raise StreamError(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def _spread(counts: list[int], states: int, extra: list[int] | None) -> list[tuple[int, int, int, int]]:
    """A decoding table: (bits to read, bits of the value, value, next state less what is read) for each state."""
    if sum(counts) > states:
        raise StreamError("too many symbols for a table")
    out: list[tuple[int, int, int, int]] = []
    value = 0
    for symbol, n in enumerate(counts):
        more = extra[symbol] if extra else 0
        first = value if extra else symbol
        value += 1 << more
        if not n:
            continue
        wide = states.bit_length() - n.bit_length()
        split = (2 * states >> wide) - n
        for k in range(n):
            if k < split:
                out.append((wide + more, more, first, (n + k << wide) - states))
            else:
                out.append((wide - 1 + more, more, first, k - split << wide - 1))
    return out


class _Bits:
    """Bits read from a payload's end towards its start."""

    def __init__(self, data: bytes, spare: int):
        self.data, self.left = data, 8 * len(data) + spare

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise StreamError("no bits left")
        at = self.left >> 3
        return int.from_bytes(self.data[at : at + 8], "little") >> (self.left & 7) & (1 << n) - 1


def _counts(data: bytes, total: int) -> list[int]:
    """Symbol counts in their variable code of 2 to 14 bits, from the low bits up."""
    out, bits, have, at = [], 0, 0, 0
    for _ in range(total):
        while have < 14 and at < len(data):
            bits |= data[at] << have
            have, at = have + 8, at + 1
        # the low bits tell the length: x0 is 2 bits, x01 is 3, 0011 is 5, 0111 is 8, 1111 is 14
        low = bits & 31
        if not low & 1:
            n, v = 2, low >> 1 & 1
        elif not low & 2:
            n, v = 3, 2 + (low >> 2 & 1)
        elif not low & 4:
            n, v = 5, 4 + (low >> 3 & 3)
        elif not low & 8:
            n, v = 8, 8 + (bits >> 4 & 15)
        else:
            n, v = 14, 24 + (bits >> 4 & 1023)
        if n > have:
            raise StreamError("a table is cut off")
        out.append(v)
        bits, have = bits >> n, have - n
    return out


def _entropy(data: bytes, at: int, out: bytearray) -> int:
    """Appends the output of a block of entropy-coded runs, matches and literals; the place after it."""
    symbols = (20, 20, 64, 256)
    if data[at : at + 4] == PACKED:
        _, size, a, b, c = struct.unpack_from("<4sI3Q", data, at)
        field = lambda v, low, n: v >> low & (1 << n) - 1
        literals, literal_bytes, matches, literal_spare = field(a, 0, 20), field(a, 20, 20), field(a, 40, 20), field(a, 60, 3) - 7
        literal_states, code_bytes, code_spare = [field(b, 10 * k, 10) for k in range(4)], field(b, 40, 20), field(b, 60, 3) - 7
        head, states = field(c, 0, 32), [field(c, 32 + 10 * k, 10) for k in range(3)]
        counts = _counts(data[at + 32 : at + head], sum(symbols))
    else:
        _, size, _, literals, matches, literal_bytes, code_bytes, literal_spare, *rest = struct.unpack_from("<4s6Ii4Hi3H360H", data, at)
        literal_states, code_spare, states, counts = rest[:4], rest[4], rest[5:8], rest[8:]
        head = struct.calcsize("<4s6Ii4Hi3H360H") + 2
    ends = np.cumsum(symbols).tolist()
    parts = [counts[b - n : b] for b, n in zip(ends, symbols, strict=True)]
    tables = [_spread(p, s, x) for p, s, x in zip(parts, STATES, (RUN_EXTRA, MATCH_EXTRA, DISTANCE_EXTRA, None), strict=True)]
    at += head
    if at + literal_bytes + code_bytes > len(data):
        raise StreamError("a block is cut off")
    text, bits = bytearray(), _Bits(data[at : at + literal_bytes], literal_spare)
    at += literal_bytes
    table = tables[3]
    for k in range(literals):
        n, _, value, base = table[literal_states[k & 3]]
        literal_states[k & 3] = base + bits.take(n)
        text.append(value)
    bits, start, used, distance = _Bits(data[at : at + code_bytes], code_spare), len(out), 0, 0
    for _ in range(matches):
        found = []
        for k in range(3):
            n, more, value, base = tables[k][states[k]]
            read = bits.take(n)
            states[k] = base + (read >> more)
            found.append(value + (read & (1 << more) - 1))
        run, match, far = found
        distance = far or distance
        out += text[used : used + run]
        used += run
        if match:
            _repeat(out, distance, match)
    if len(out) - start < size:  # what follows the last match
        out += text[used : used + size - (len(out) - start)]
    if len(out) - start != size:
        raise StreamError(f"{len(out) - start} bytes instead of {size}")
    return at + code_bytes


def _stream(data: bytes, at: int, out: bytearray) -> int:
    """Appends the output of the stream that begins at ``at``; the place after its end."""
    while True:
        kind = data[at : at + 4]
        try:
            if kind == END:
                return at + 4
            if kind == RAW:
                (size,) = struct.unpack_from("<I", data, at + 4)
                if at + 8 + size > len(data):
                    raise StreamError("a block is cut off")
                out += data[at + 8 : at + 8 + size]
                at += 8 + size
            elif kind == VN:
                size, length = struct.unpack_from("<2I", data, at + 4)
                part = bytearray()
                _lzvn(data[at + 12 : at + 12 + length], part)
                if len(part) != size:
                    raise StreamError(f"{len(part)} bytes instead of {size}")
                out += part
                at += 12 + length
            elif kind in (PACKED, TABLES):
                at = _entropy(data, at, out)
            else:
                raise StreamError("no block magic")
        except (struct.error, IndexError):
            raise StreamError("a block is cut off") from None


def is_stream(data: bytes) -> bool:
    return bytes(data[:4]) in STREAM


def lzfse(data: bytes) -> bytes:
    """The output of one stream or of several in a row; a few bytes before each are passed over."""
    data, out, at = bytes(data), bytearray(), 0
    while True:
        begin = next((k for k in range(at, min(len(data), at + SLACK + 1)) if data[k : k + 4] in (*STREAM, TABLES)), None)
        if begin is None:
            if at == 0:
                raise StreamError("no stream")
            return bytes(out)
        at = _stream(data, begin, out)
        if at >= len(data):
            return bytes(out)


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out, rest = [], bytes(data)
    while rest:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(rest) + member.flush())
        except zlib.error as e:
            raise StreamError(str(e)) from None
        if not member.eof:
            raise StreamError("a member is cut off")
        rest = member.unused_data
    return b"".join(out)


def lzvn_literals(data: bytes) -> bytes:
    """An LZVN stream that holds ``data`` as it is."""
    out, at = bytearray(), 0
    while at < len(data):
        run = data[at : at + 271]
        out += bytes([0xE0 | len(run)]) if len(run) < 16 else bytes([0xE0, len(run) - 16])
        out += run
        at += len(run)
    return bytes(out) + b"\6" + bytes(7)


def lzfse_raw(data: bytes) -> bytes:
    """An LZFSE stream that holds ``data`` as it is."""
    return RAW + struct.pack("<I", len(data)) + data + END


def lzfse_vn(data: bytes) -> bytes:
    """An LZFSE stream of one LZVN block."""
    body = lzvn_literals(data)
    return VN + struct.pack("<2I", len(data), len(body)) + body + END


def zlib_literals(data: bytes) -> bytes:
    """A zlib stream of fixed codes and no matches that holds ``data``, of bytes below 144, in eight bytes more."""
    bits, at = 0b011, 3  # the last block, fixed codes
    for byte in data:
        bits |= int(f"{byte + 0x30:08b}"[::-1], 2) << at
        at += 8
    # seven zero bits end the block
    return b"\x78\x9c" + bits.to_bytes((at + 14) // 8, "little") + struct.pack(">I", zlib.adler32(data))
