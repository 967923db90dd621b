"""Names of the numbers in an archive, in the reports' spelling and in the browser's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts.
LAYOUTS = {
    6: "Gradient", 7: "Effect", 9: "Vector", 10: "OnePartFixedSize", 11: "OnePartTile", 12: "OnePartScale",
    20: "ThreePartHorizontalTile", 21: "ThreePartHorizontalScale", 22: "ThreePartHorizontalUniform",
    23: "ThreePartVerticalTile", 24: "ThreePartVerticalScale", 25: "ThreePartVerticalUniform",
    30: "NinePartTile", 31: "NinePartScale", 32: "NinePartHorizontalUniformVerticalScale", 33: "NinePartHorizontalScaleVerticalUniform", 34: "NinePartEdgesOnly",
    40: "SixPart", 50: "AnimationFilmstrip",
    1000: "Data", 1001: "ExternalLink", 1002: "LayerStack", 1003: "InternalReference", 1004: "PackedImage", 1005: "NameList", 1006: "UnknownAddObject", 1007: "Texture",
    1008: "TextureImage", 1009: "Color", 1010: "MultisizeImage", 1012: "LayerReference", 1013: "ContentRendition", 1014: "RecognitionObject",
}
#: Colour spaces.
COLOR_SPACES = {1: "srgb", 2: "gray-gamma-2.2", 3: "display-p3", 4: "extended-srgb", 5: "extended-linear-srgb", 6: "extended-gray", 257: "system-srgb"}
#: Colour models.
COLOR_MODELS = {0: "None", 1: "RGB", 2: "Monochrome", 3: "RGB0", 4: "RGBP3"}
#: Idioms.
IDIOMS = {0: "universal", 1: "phone", 2: "pad", 3: "tv", 4: "car", 5: "watch", 6: "marketing"}
#: Compressions.
COMPRESSIONS = {0: "Uncompressed", 1: "RLE", 2: "Zip", 3: "LZVN", 4: "LZFSE", 5: "JPEG+LZFSE", 6: "Blurred", 7: "ASTC", 8: "PaletteImg", 9: "HEVC", 10: "Deepmap+LZFSE", 11: "Deepmap2"}
#: Encodings.
ENCODINGS = {
    "None": "None", "ARGB": "ARGB", "DATA": "Data", "GRAY": "GRAY", "JPEG": "JPEG", "PDF ": "PDF", "WEBP": "WEBP", "RGBW": "ARGB16", "GA16": "GA16", "GA8 ": "GA8",
    "RGB5": "RGB5", "SVG ": "SVG", "HEIF": "HEIF",
}
#: Attributes that a rendition's report names, by tag.
REPORTED = {
    "Idiom": 15, "AttributeScale": 12, "Element": 1, "Part": 2, "State": 10, "Layer": 11, "Value": 6, "Direction": 4, "DisplayGamut": 24, "Subtype": 16,
    "HorizontalSizeClass": 20, "VerticalSizeClass": 21, "DeploymentTarget": 25, "ThemeAppearance": 7, "GlyphWeight": 26, "GlyphSize": 27,
}


def named(value: Column, names: dict, other: Column | str | None = None) -> Column:
    """The name of a value; ``other`` for one without."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    found = F.element_at(table, value if isinstance(next(iter(names)), str) else value.cast("int"))
    return found if other is None else F.coalesce(found, F.lit(other) if isinstance(other, str) else other)


def kebab(name: str) -> str:
    return "".join("-" + c.lower() if c.isupper() and k else c.lower() for k, c in enumerate(name))


def layout(value: Column) -> Column:
    return named(value, LAYOUTS, "Unknown")


def layout_kebab(value: Column) -> Column:
    return named(value, {k: kebab(v) for k, v in LAYOUTS.items()}, "unknown")


def encoding(value: Column) -> Column:
    return named(value, ENCODINGS, F.concat(F.lit("Unknown("), value, F.lit(")")))


def encoding_lower(value: Column) -> Column:
    return named(value, {k: v.lower() for k, v in ENCODINGS.items()}, "unknown")


def number(raw: Column, at: int | Column = 0, size: int = 4) -> Column:
    """A little-endian number at an offset of a binary; null where the bytes are not all there."""
    start = at if isinstance(at, Column) else F.lit(at)
    digits = F.concat(*[F.hex(F.substring(raw, start + k + 1, F.lit(1))) for k in range(size - 1, -1, -1)])
    return F.when(F.length(raw) >= start + size, F.conv(digits, 16, 10).cast("long"))
