"""Asset-catalog archives: from bytes to rows, and from rows to bytes.

Numbers inside the blocks are little-endian.
"""

from __future__ import annotations

import struct
from typing import Any

from .bom import Store, StoreError, Writer

IDENTIFIER = 17
INTERNAL_REFERENCE = 1003
REFERENCE_TLV = 1010
#: magic, version, flags, width, height, scale factor, encoding, colour model, modification time, layout, name, TLV length, bitmaps, zero, payload length.
CSI = struct.Struct("<4s5I4s3I128s4I")


def text(raw: bytes) -> str:
    """Lossy UTF-8 without trailing NULs."""
    return bytes(raw).decode(errors="replace").rstrip("\0")


def cut(data: Any, at: int, size: int) -> Any:
    """A slice that must be there whole."""
    if at + size > len(data):
        raise StoreError(f"range {at}+{size} is outside of {len(data)} bytes")
    return data[at : at + size]


def key_format(block: bytes) -> list[int]:
    magic, _, count = struct.unpack_from("<4s2I", block)
    if magic != b"tmfk":
        raise StoreError("no key format")
    tags = [struct.unpack_from("<H", block, 12 + 4 * k)[0] for k in range(count)]
    if IDENTIFIER not in tags:
        raise StoreError("the key format has no identifier")
    return tags


def header(block: bytes, extended: bytes) -> dict[str, Any]:
    magic, core, storage, stamp, count, main, version, uuid, checksum, schema, space, semantics = struct.unpack_from("<4s4I128s256s16s4I", block)
    if magic != b"RATC" or extended[:4] != b"META":
        raise StoreError("no archive header")
    more = [text(extended[4 + 256 * k : 260 + 256 * k]) for k in range(4)]
    return {
        "coreui_version": core, "storage_version": storage, "storage_timestamp": stamp, "rendition_count": count, "main_version": text(main),
        "version_string": text(version), "uuid": uuid, "checksum": checksum, "schema_version": schema, "color_space": space, "key_semantics": semantics,
        "thinning_arguments": more[0], "deployment_version": more[1], "deployment_platform": more[2], "authoring_tool": more[3],
    }


def _chunks(data: bytes) -> tuple[int, list[tuple[int, int | None, bytes]]]:
    version, compression, size = struct.unpack_from("<3I", data, 4)
    if version in (0, 2):
        return compression, [(0, None, cut(data, 16, size))]
    if version not in (1, 3):
        raise StoreError(f"raster version {version}")
    out, at = [], 16
    for k in range(size):
        _, _, _, height, length = struct.unpack_from("<5I", data, at)
        out.append((k, height, cut(data, at + 20, length)))
        at += 20 + length
    return compression, out


def payload(data: memoryview, whole: bool = True) -> dict[str, Any]:
    """The payload by its magic; absent values are null, and so are bytes unless ``whole``."""
    keep = bytes if whole else lambda _: None
    out: dict[str, Any] = {"rendition_kind": "None", "compression": None, "color_space": None, "components": None, "raw": None, "chunks": None, "sizes": None, "payload_tag": None}
    if not len(data):
        return out
    magic = bytes(data[:4])
    if magic == b"RLOC":
        _, space, n = struct.unpack_from("<3I", data, 4)
        return out | {"rendition_kind": "Color", "color_space": space & 0xFFFF, "components": list(struct.unpack_from(f"<{n}d", data, 16))}
    if magic == b"DWAR":
        (size,) = struct.unpack_from("<I", data, 8)
        return out | {"rendition_kind": "RawData", "raw": keep(cut(data, 12, size))}
    if magic == b"MLEC":
        compression, chunks = _chunks(data)
        return out | {"rendition_kind": "ThemeCBCK", "compression": compression, "chunks": [{"no": k, "height": h, "data": keep(d)} for k, h, d in chunks]}
    if magic == b"SISM":
        (n,) = struct.unpack_from("<I", data, 8)
        sizes = [struct.unpack_from("<2I2H", data, 12 + 12 * k) for k in range(n)]
        return out | {"rendition_kind": "MultisizeImageSet", "sizes": [dict(zip(("width", "height", "index", "idiom"), s, strict=True)) for s in sizes]}
    (size,) = struct.unpack_from("<I", data, 8)
    return out | {"rendition_kind": "Unknown", "payload_tag": magic.decode("latin-1"), "raw": keep(cut(data, 12, size))}


def reference(tlvs: list[dict[str, Any]], tags: list[int]) -> dict[str, Any] | None:
    """The first reference TLV: its rectangle, layout and target key, or why it has none."""
    body = next((t["body"] for t in tlvs if t["tag"] == REFERENCE_TLV), None)
    if body is None:
        return None
    _, _, x, y, w, h, layout, size = struct.unpack_from("<6IHI", body)
    raw, key, error = cut(body, 30, size), [0] * len(tags), None
    for at in range(0, len(raw) - 3, 4):
        attr, value = struct.unpack_from("<2H", raw, at)
        if (attr, value) == (0, 0):
            break
        if attr not in tags:
            error = "UnknownAttribute"
            break
        key[tags.index(attr)] = value
    if error is None and len(raw) % 4:
        error = "MalformedKey"
    return {"x": x, "y": y, "width": w, "height": h, "layout": layout, "key": None if error else key, "error": error}


def rendition(order: int, key: bytes, value: bytes, tags: list[int], payloads: bool = True) -> dict[str, Any]:
    if bytes(value[:4]) != b"ISTC" or len(value) < CSI.size:
        raise StoreError("no rendition header")
    _, version, flags, width, height, scale, encoding, model, mtime, layout, name, tlv_size, _, _, size = CSI.unpack_from(value)
    tlvs, at, end = [], CSI.size, CSI.size + tlv_size
    while at < end:
        tag, length = struct.unpack_from("<2I", value, at)
        if at + 8 + length > end:
            raise StoreError("a TLV runs over its end")
        tlvs.append({"tag": tag, "body": bytes(value[at + 8 : at + 8 + length])})
        at += 8 + length
    values = list(struct.unpack(f"<{len(tags)}H", key[: 2 * len(tags)]))
    return {
        "rend_ord": order, "key_values": values, "identifier": values[tags.index(IDENTIFIER)], "attrs": [{"tag": t, "val": v} for t, v in zip(tags, values, strict=True)],
        "version": version, "flags": flags, "width": width, "height": height, "scale_factor": scale, "encoding": text(encoding[::-1]) or "None", "color_model": model,
        "modification_time": mtime, "layout": layout, "rendition_name": text(name), "tlvs": tlvs, "tlv_length": tlv_size, "rendition_length": size,
        "reference": reference(tlvs, tags), **payload(cut(value, end, size), payloads),
    }


def parse(data: Any, parts: tuple[str, ...] = ("document", "key_format", "appearance", "facet", "rendition"), payloads: bool = True) -> dict[str, list[Any]]:
    """The records of an archive's ``parts``; any malformed one fails the whole."""
    store = Store(data)
    tags = key_format(bytes(store.named("KEYFORMAT")))
    out: dict[str, list[Any]] = {}
    if "document" in parts:
        out["document"] = [header(bytes(store.named("CARHEADER")), bytes(store.named("EXTENDED_METADATA")))]
    if "key_format" in parts:
        out["key_format"] = [tags]
    if "appearance" in parts:
        out["appearance"] = [{"name": text(k), "value": bytes(v)} for k, v in store.leaves("APPEARANCEKEYS")]
    if "facet" in parts:
        facets: dict[str, dict[str, Any]] = {}
        for key, value in store.leaves("FACETKEYS"):
            x, y, n = struct.unpack_from("<3H", value)
            attrs = [dict(zip(("tag", "val"), struct.unpack_from("<2H", value, 6 + 4 * k), strict=True)) for k in range(n)]
            name = text(key)
            # of equal names the last counts
            facets[name] = {"facet_name": name, "x": x, "y": y, "attrs": attrs, "identifier": next((a["val"] for a in attrs if a["tag"] == IDENTIFIER), None)}
        out["facet"] = [facets[name] for name in sorted(facets)]
    if "rendition" in parts:
        out["rendition"] = [rendition(k, key, value, tags, payloads) for k, (key, value) in enumerate(store.leaves("RENDITIONS"))]
    return out


def encode_tlv(tag: int, body: bytes) -> bytes:
    return struct.pack("<2I", tag, len(body)) + body


def encode_reference(rect: tuple[int, int, int, int], layout: int, pairs: list[tuple[int, int]], more: bytes = b"") -> bytes:
    key = b"".join(struct.pack("<2H", *p) for p in [*pairs, (0, 0)]) + more
    return encode_tlv(REFERENCE_TLV, b"INLK" + struct.pack("<5IHI", 0, *rect, layout, len(key)) + key)


def encode_color(space: int, components: list[float]) -> bytes:
    return b"RLOC" + struct.pack(f"<3I{len(components)}d", 1, space, len(components), *components)


def encode_raw(data: bytes) -> bytes:
    return b"DWAR" + struct.pack("<2I", 0, len(data)) + data


def encode_raster(compression: int, data: bytes) -> bytes:
    return b"MLEC" + struct.pack("<3I", 0, compression, len(data)) + data


def encode_parts(compression: int, parts: list[tuple[int, bytes]]) -> bytes:
    """A raster of several chunks, each with its height."""
    return b"MLEC" + struct.pack("<3I", 1, compression, len(parts)) + b"".join(b"KCBC" + struct.pack("<4I", 0, 0, h, len(d)) + d for h, d in parts)


def encode_unknown(tag: bytes, data: bytes) -> bytes:
    return tag + struct.pack("<2I", 0, len(data)) + data


def encode_sizes(sizes: list[tuple[int, int, int, int]]) -> bytes:
    return b"SISM" + struct.pack("<2I", 1, len(sizes)) + b"".join(struct.pack("<2I2H", *s) for s in sizes)


def encode_rendition(width: int, height: int, scale: int, encoding: str, layout: int, name: str, tlvs: bytes, body: bytes) -> bytes:
    code = encoding.encode()[::-1] if encoding != "None" else b"\0\0\0\0"
    return CSI.pack(b"ISTC", 1, 0, width, height, scale, code, 1, 0, layout, name.encode(), len(tlvs), 0, 0, len(body)) + tlvs + body


def encode(tags: list[int], facets: list[tuple[str, list[tuple[int, int]]]], renditions: list[tuple[list[int], bytes]], platform: str = "ios") -> bytes:
    """An archive of these facets and renditions, in the order given."""
    store = Writer()
    store.add(struct.pack("<4s4I128s256s16s4I", b"RATC", 971, 17, 0, len(renditions), b"main", b"version", bytes(16), 0, 2, 1, 2), "CARHEADER")
    store.add(b"META" + b"".join(v.encode().ljust(256, b"\0") for v in ("", "15.0", platform, "tool")), "EXTENDED_METADATA")
    store.add(b"tmfk" + struct.pack("<2I", 0, len(tags)) + b"".join(struct.pack("<2H", t, 0) for t in tags), "KEYFORMAT")
    store.tree("APPEARANCEKEYS", [(b"UIAppearanceAny", struct.pack("<H", 0))])
    store.tree("FACETKEYS", [(n.encode(), struct.pack("<3H", 0, 0, len(a)) + b"".join(struct.pack("<2H", *p) for p in a)) for n, a in facets])
    store.tree("RENDITIONS", [(struct.pack(f"<{len(tags)}H", *k), v) for k, v in renditions])
    return store.data()
