"""Path, file-name, identifier and colour text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))


def _unsafe(path: Column) -> Column:
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def relative_path(path: Column) -> Column:
    """The path of its plain components; null if it is empty, absolute or climbs."""
    return F.when(~_unsafe(path) & (F.size(_parts(path)) > 0), F.array_join(_parts(path), "/"))


def file_name(path: Column) -> Column:
    """The last plain component; null as in ``relative_path``."""
    return F.when(~_unsafe(path) & (F.size(_parts(path)) > 0), F.element_at(_parts(path), -1))


def extension(name: Column) -> Column:
    """What follows the last dot of the last component, unless it starts with it; else empty."""
    return F.regexp_extract(name, r"[^/]\.([^./]*)$", 1)


def with_extension(name: Column, suffix: Column, ending: Column) -> Column:
    """``name`` with the suffix before its extension, and with that ending."""
    ext = extension(name)
    bare = F.when(ext != "", F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    marked = F.concat(bare, F.when(bare.endswith(suffix), "").otherwise(suffix))
    same = F.lower(ext) == F.lower(ending)
    # an ending replaces what follows the last dot, which may be a dot of the stem
    cut = F.when(ext != "", marked).otherwise(F.when(extension(marked) != "", F.regexp_replace(marked, r"\.[^.]*$", "")).otherwise(marked))
    return F.when(ending == "", F.concat(marked, F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))).when(same, F.concat(marked, F.lit("."), ext)).otherwise(F.concat(cut, F.lit("."), ending))


def uuid(raw: Column) -> Column:
    """Sixteen bytes as upper-case 8-4-4-4-12."""
    return F.regexp_replace(F.upper(F.hex(raw)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def css_color(space: Column, components: Column) -> Column:
    """A colour's CSS text; components are clamped to 0..1, missing ones are 0, or 1 for alpha."""
    part = lambda k, default: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.get(components, F.lit(k)), F.lit(default))))
    byte = lambda c: F.floor(c * 255 + 0.5).cast("string")
    four = lambda c: F.format_string("%.4f", c)
    r, g, b, a = part(0, 0.0), part(1, 0.0), part(2, 0.0), part(3, 1.0)
    gray = byte(part(0, 0.0))
    return (
        F.when(space.isin(2, 6), F.concat(F.lit("rgba("), gray, F.lit(", "), gray, F.lit(", "), gray, F.lit(", "), four(part(1, 1.0)), F.lit(")")))
        .when(space == 3, F.concat(F.lit("color(display-p3 "), four(r), F.lit(" "), four(g), F.lit(" "), four(b), F.lit(" / "), four(a), F.lit(")")))
        .otherwise(F.concat(F.lit("rgba("), byte(r), F.lit(", "), byte(g), F.lit(", "), byte(b), F.lit(", "), four(a), F.lit(")")))
    )
