"""The block store that asset catalogs are kept in: reading and writing.

All numbers are big-endian.  A store has a table of blocks, named blocks, and
trees whose leaves are chained from left to right.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator


class StoreError(ValueError):
    """The bytes are not a well-formed store."""


class Store:
    """A store over bytes in memory; blocks are slices and nothing is copied."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if bytes(self._cut(0, 8)) != b"BOMStore":
            raise StoreError("no store magic")
        self.version, self.block_count, index, index_size, names, names_size = struct.unpack(">6I", self._cut(8, 24))
        table = self._cut(index, index_size)
        (count,) = struct.unpack_from(">I", table)
        self.blocks = [struct.unpack_from(">2I", table, 4 + 8 * k) for k in range(count)]
        found = self._cut(names, names_size)
        (count,), at = struct.unpack_from(">I", found), 4
        self.names: list[tuple[str, int]] = []
        for _ in range(count):
            block, size = struct.unpack_from(">IB", found, at)
            self.names.append((bytes(found[at + 5 : at + 5 + size]).decode(errors="replace").rstrip("\0"), block))
            at += 5 + size

    def _cut(self, at: int, size: int) -> memoryview:
        if at < 0 or size < 0 or at + size > len(self.data):
            raise StoreError(f"range {at}+{size} is outside of {len(self.data)} bytes")
        return self.data[at : at + size]

    def block(self, index: int) -> memoryview:
        if not 0 <= index < len(self.blocks):
            raise StoreError(f"no block {index}")
        return self._cut(*self.blocks[index])

    def named(self, name: str) -> memoryview:
        """The first block of that name."""
        for known, index in self.names:
            if known == name:
                return self.block(index)
        raise StoreError(f"no block named {name}")

    def leaves(self, name: str) -> Iterator[tuple[memoryview, memoryview]]:
        """(key, value) of a tree's leaves in order; an inner node without children ends it."""
        head = self.named(name)
        if bytes(head[:4]) != b"tree":
            raise StoreError(f"{name} is no tree")
        (at,) = struct.unpack_from(">I", head, 8)
        while True:
            node = self.block(at)
            leaf, count, forward, _ = struct.unpack_from(">2H2I", node)
            if leaf:
                break
            if not count:
                return
            (at,) = struct.unpack_from(">I", node, 12)
        while True:
            for k in range(count):
                value, key = struct.unpack_from(">2I", node, 12 + 8 * k)
                yield self.block(key), self.block(value)
            if not forward:
                return
            node = self.block(forward)
            _, count, forward, _ = struct.unpack_from(">2H2I", node)


class Writer:
    """Builds a store; trees get leaves of at most ``leaf`` entries."""

    def __init__(self, leaf: int = 64):
        self.leaf = leaf
        self.blocks: list[bytes] = [b""]
        self.names: list[tuple[str, int]] = []

    def add(self, data: bytes, name: str | None = None) -> int:
        self.blocks.append(data)
        if name is not None:
            self.names.append((name, len(self.blocks) - 1))
        return len(self.blocks) - 1

    def tree(self, name: str, entries: list[tuple[bytes, bytes]]) -> None:
        cells = [(self.add(value), self.add(key)) for key, value in entries]
        parts = [cells[k : k + self.leaf] for k in range(0, len(cells), self.leaf)] or [[]]
        first = len(self.blocks)
        for k, part in enumerate(parts):
            head = struct.pack(">2H2I", 1, len(part), first + k + 1 if k + 1 < len(parts) else 0, first + k - 1 if k else 0)
            self.add(head + b"".join(struct.pack(">2I", *c) for c in part))
        root = first
        if len(parts) > 1:
            cells_ = b"".join(struct.pack(">2I", first + k, 0) for k in range(len(parts)))
            root = self.add(struct.pack(">2H2I", 0, len(parts), 0, 0) + cells_)
        self.add(b"tree" + struct.pack(">4IB", 1, root, 4096, len(entries), 0), name)

    def data(self) -> bytes:
        at, index, body = 32, [], []
        for block in self.blocks:
            index.append(struct.pack(">2I", at if block else 0, len(block)))
            body.append(block)
            at += len(block)
        table = struct.pack(">I", len(index)) + b"".join(index)
        named = struct.pack(">I", len(self.names)) + b"".join(struct.pack(">IB", i, len(n.encode())) + n.encode() for n, i in self.names)
        head = b"BOMStore" + struct.pack(">6I", 1, len(self.blocks) - 1, at, len(table), at + len(table), len(named))
        return head + b"".join(body) + table + named
