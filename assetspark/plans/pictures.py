"""Archives of small pictures, one for each part, whose pixels SQL can say: every way of storing them once."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compression as Z
from ..functions import deepmap as D
from ..operators import payloads
from ..sources import archive as A
from ..sources.reader import Catalog

#: Parts of an archive; ways of storing a picture.
PARTS, WAYS = 256, 14
TAGS = [17, 12]


def _gray(p: int) -> list[int]:
    return [(p + 37 * i) % 256 for i in range(4)]


def picture(p: int) -> tuple[str, bytes, bytes]:
    """Encoding, TLVs and payload of the two by two picture of a part."""
    way, g = p % WAYS, _gray(p)
    alpha = 255 if p // WAYS % 2 == 0 else 128
    wide = lambda v: v * 256 + 17
    if way == 0:
        return "ARGB", b"", A.encode_raster(0, b"".join(bytes([v, v * 3 % 256, v * 5 % 256, alpha]) for v in g))
    if way == 1:
        return "GRAY", b"", A.encode_parts(2, [(1, gzip.compress(bytes(g[:1]), mtime=0) + gzip.compress(bytes(g[1:2]), mtime=0)), (1, gzip.compress(bytes(g[2:]), mtime=0))])
    if way == 2:
        return "GA8 ", b"", A.encode_raster(3, Z.lzvn_literals(b"".join(bytes([v, v * 7 % 256]) for v in g)))
    if way == 3:
        five = [(p * 97 + 1031 * i) % 65536 for i in range(4)]
        rows = struct.pack("<2H2x", *five[:2]) + struct.pack("<2H2x", *five[2:])
        return "RGB5", A.encode_tlv(1007, struct.pack("<I", 6)), A.encode_raster(4, Z.lzfse_raw(rows))
    if way == 4:
        return "GA16", b"", A.encode_raster(0, b"".join(struct.pack("<2H", wide(v), 65535 - wide(v)) for v in g))
    if way == 5:
        return "RGBW", b"", A.encode_raster(0, b"".join(struct.pack("<4H", wide(v), wide(v * 3 % 256), wide(v * 5 % 256), 65535) for v in g))
    if way == 6:
        return "GRAY", b"", A.encode_raster(11, D.encode(D.PLAIN, D.G8, 2, 2, bytes(g)))
    color = [bytes([v, v * 3 % 256, v * 5 % 256, 255]) for v in g]
    if way == 7:
        tiles = [D.encode_tile(x, 0, 0, D.encode(D.LOSSLESS, D.RGBA8888, 1, 2, Z.lzvn_literals(color[x] + color[2 + x]))) for x in (0, 1)]
        return "ARGB", b"", A.encode_raster(11, b"".join(tiles))
    if way == 8:
        entries = tuple(int.from_bytes(c, "little") for c in color)
        return "GRAY", b"", A.encode_raster(11, D.encode(D.PALETTE, D.G8, 2, 2, Z.lzfse_vn(bytes(range(4))), palette=entries))
    if way == 9:
        steps = [p % 50 + 50, 5, 3, -2]
        coded = [2 * abs(v) + (v < 0) for v in steps]
        raw = bytes([2, 3]) + bytes(v >> 8 for v in coded) + bytes(v & 255 for v in coded)
        part = Z.lzfse_raw(raw)
        return "GRAY", b"", A.encode_raster(11, D.encode(D.SPLIT, D.G8, 2, 2, struct.pack("<I", len(part)) + part))
    text = f"picture {p}".encode()
    if way == 10:
        body = struct.pack(">I", 24) + b"ftypxxxx" + bytes(4) + b"abcdheic" + text
        return "ARGB", b"", A.encode_raster(9, struct.pack("<2I", 1, len(body)) + body)
    if way == 11:
        return "DATA", b"", A.encode_raw(Z.lzfse_vn(text))
    if way == 12:
        return "JPEG", b"", A.encode_raster(0, text)
    return "ARGB", b"", A.encode_raster(1, text)


def _encode(rows: pd.DataFrame) -> pd.DataFrame:
    parts = rows.sort_values("p_partkey")
    facets = [(f"{r.p_name}#{r.p_partkey}", [(17, int(r.p_partkey) % PARTS)]) for r in parts.itertuples()]
    made = []
    for r in parts.itertuples():
        p = int(r.p_partkey)
        encoding, tlvs, body = picture(p)
        made.append(([p % PARTS, 1], A.encode_rendition(2, 2, 100, encoding, 12, f"picture{p}.png", tlvs, body)))
    return pd.DataFrame({"archive_id": [parts["archive"].iloc[0]], "content": [A.encode(TAGS, facets, made)]})


@lru_cache(maxsize=4)
def _opened(spark: SparkSession, session: str, sf_dir: str) -> Catalog:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    rows = part.withColumn("archive", F.concat(F.lit("p"), F.floor(F.col("p_partkey") / PARTS).cast("string")))
    return Catalog(rows.groupBy("archive").applyInPandas(_encode, "archive_id string, content binary"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return _opened(spark, spark.sparkContext.applicationId, sf_dir)


def _named(catalog_: Catalog, rows: DataFrame) -> DataFrame:
    """``rows`` by the name of their rendition instead of their id."""
    from ..operators.catalog import entries

    return rows.join(entries(catalog_).select("archive_id", "asset_id", "rendition_name"), ["archive_id", "asset_id"])


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return _named(c, payloads.pictures(c)).where("error_code IS NULL").select("archive_id", "rendition_name", F.col("p_width").cast("long").alias("width"), F.hex("data").alias("rgba"))


def _faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return _named(c, payloads.pictures(c, "png")).where("error_code IS NOT NULL").select("archive_id", "rendition_name", "error_code")


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.decoded(catalog(spark, sf_dir), limit=8)
    return found.groupBy("archive_id", F.coalesce("error_code", F.lit("fine")).alias("outcome")).agg(F.count("*").alias("n"))


def _originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return _named(c, payloads.originals(c)).select("archive_id", "rendition_name", F.hex("data").alias("data"), "error_code")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.tiles(catalog(spark, sf_dir))
    return found.select("archive_id", "rend_ord", *[F.col(c).cast("long").alias(c) for c in ("column", "row", "width", "height", "x", "y")])


def _downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.download_payloads(catalog(spark, sf_dir))
    return found.select("archive_id", "suggested_file_name", F.substring(F.hex("data"), 1, 16).alias("head"), "error_code")


def _displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payloads.display_payloads(catalog(spark, sf_dir))
    return found.groupBy("archive_id", "kind", "error_code").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "picture_rgba": _pictures, "picture_faults": _faults, "decode_budget": _budget, "original_bytes": _originals, "tile_grid": _tiles,
        "download_payloads": _downloads, "display_payloads": _displays,
    }


#: Pixels by way; v is a grey value, c one of blue, green and red, w a 16-bit value.
SQL = """WITH base AS (SELECT 'p' || (p_partkey // 256) AS archive_id, p_partkey AS p, p_partkey % 14 AS way, 'picture' || p_partkey || '.png' AS rendition_name,
    row_number() OVER (PARTITION BY p_partkey // 256 ORDER BY p_partkey) - 1 AS rend_ord, CASE WHEN p_partkey // 14 % 2 = 0 THEN 255 ELSE 128 END AS alpha FROM part),
  px AS (SELECT *, unnest([0, 1, 2, 3]) AS i FROM base),
  g AS (SELECT *, (p + 37 * i) % 256 AS v, (p * 97 + 1031 * i) % 65536 AS five FROM px),
  b AS (SELECT *, v * 3 % 256 AS v3, v * 5 % 256 AS v5, v * 256 + 17 AS w FROM g),
  c AS (SELECT *, CASE way
      WHEN 0 THEN [least(255, (v5 * 255 + alpha // 2) // alpha), least(255, (v3 * 255 + alpha // 2) // alpha), least(255, (v * 255 + alpha // 2) // alpha), alpha]
      WHEN 1 THEN [v, v, v, 255] WHEN 2 THEN [v, v, v, v * 7 % 256]
      WHEN 3 THEN [five // 1024 % 32 * 8 + five // 1024 % 32 // 4, five // 32 % 32 * 8 + five // 32 % 32 // 4, five % 32 * 8 + five % 32 // 4, 255]
      WHEN 4 THEN [(w + 128) // 257, (w + 128) // 257, (w + 128) // 257, (65535 - w + 128) // 257]
      WHEN 5 THEN [(v5 * 256 + 17 + 128) // 257, (v3 * 256 + 17 + 128) // 257, (w + 128) // 257, 255]
      WHEN 6 THEN [v, v, v, 255] WHEN 7 THEN [v5, v3, v, 255] WHEN 8 THEN [v5, v3, v, 255]
      WHEN 9 THEN list_value(1, 1, 1, 0) END AS rgba,
      CASE WHEN way = 9 THEN p % 50 + 50 + [0, 5, 3, 3][i + 1] END AS step FROM b),
  d AS (SELECT *, CASE WHEN way = 9 THEN [step, step, step, 255] ELSE rgba END AS q FROM c)
"""


def oracle_sql() -> dict[str, str]:
    hexed = "string_agg(printf('%02X%02X%02X%02X', q[1], q[2], q[3], q[4]), '' ORDER BY i)"
    text = "hex(encode('picture ' || p))"
    return {
        "picture_rgba": SQL + f"SELECT archive_id, rendition_name, 2 AS width, {hexed} AS rgba FROM d WHERE way < 10 GROUP BY archive_id, rendition_name",
        "picture_faults": SQL + "SELECT archive_id, rendition_name, CASE WHEN way IN (11, 12) THEN 'UnsupportedEncoding' ELSE 'UnsupportedCompression' END AS error_code FROM base WHERE way >= 10",
        "decode_budget": SQL + """SELECT archive_id, CASE WHEN way IN (10, 13) THEN 'UnsupportedCompression' WHEN way IN (1, 2) THEN 'fine' WHEN way = 12 AND length('picture ' || p) <= 8 THEN 'fine' ELSE 'DecodeBudgetExceeded' END AS outcome, count(*) AS n
          FROM base GROUP BY ALL""",
        "original_bytes": SQL + f"""SELECT archive_id, rendition_name, CASE way WHEN 10 THEN '0000001866747970787878780000000061626364' || '68656963' || {text} WHEN 11 THEN {text} WHEN 12 THEN {text} END AS data,
          CASE WHEN way IN (10, 11, 12) THEN NULL ELSE 'UnsupportedEncoding' END AS error_code FROM base""",
        "tile_grid": SQL + 'SELECT archive_id, rend_ord, k AS "column", 0 AS "row", 1 AS width, 2 AS height, k AS x, 0 AS y FROM (SELECT *, unnest([0, 1]) AS k FROM base WHERE way = 7)',
        "download_payloads": SQL + f"""SELECT archive_id, CASE way WHEN 10 THEN 'picture' || p || '.heic' WHEN 11 THEN 'picture' || p || '.png' WHEN 12 THEN 'picture' || p || '.jpg' ELSE 'picture' || p || '.png' END AS suggested_file_name,
          CASE WHEN way = 10 THEN '0000001866747970' WHEN way IN (11, 12) THEN substr({text}, 1, 16) WHEN way < 10 THEN '89504E470D0A1A0A' END AS head, CASE WHEN way = 13 THEN 'UnsupportedCompression' END AS error_code FROM base""",
        "display_payloads": SQL + """SELECT archive_id, CASE WHEN way = 13 THEN NULL WHEN way < 10 THEN 'canvas-rgba' WHEN way = 12 THEN 'img-binary' ELSE 'download-only' END AS kind, CASE WHEN way = 13 THEN 'UnsupportedCompression' END AS error_code,
          count(*) AS n, CAST(sum(CASE WHEN way < 10 THEN 16 WHEN way = 12 THEN length('picture ' || p) END) AS BIGINT) AS bytes FROM base GROUP BY ALL""",
    }
