"""Language identification by compression (operator 4).

Each language gets a zstandard raw-content dictionary of pieces of sample texts,
taken by hash from anywhere in them.  A text goes to the language whose dictionary compresses the whole of it best; how much
better than the next one gives the score, and a narrow margin marks the verdict
as rejected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, scratched, table

#: Training texts a language at most, one for each slot of a hash of the id; bytes of a dictionary; languages learned.
SLOTS, DICTIONARY, LANGUAGES = 256, 1 << 18, 256
#: Compression level; margin, as a share of the compressed size, at which a verdict is rejected and the scale of the score.
LEVEL, NARROW, SCALE = 6, 0.01, 0.05
#: A piece ends at one word in so many, chosen by the word; letters of a word that are never divided.
PIECE, LETTERS = 16, 64
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Lower-case letters with single blanks between runs of them; empty where the text has no letter."""
    return _OTHER.sub(" ", text.lower()).strip() if any(map(str.isalpha, text)) else ""


def pieces(text: str) -> list[str]:
    """``normal`` text in pieces that end at words chosen by content, so equal passages give equal pieces wherever they stand."""
    out, some = [], []
    for word in normal(text).split():
        for at in range(0, len(word), LETTERS):
            some.append(part := word[at : at + LETTERS])
            if zlib.crc32(part.encode()) % PIECE == 0 or len(some) == 4 * PIECE:
                out.append(" ".join(some))
                some = []
    return out + [" ".join(some)] * bool(some)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


@scratched
def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language, from at most ``SLOTS`` texts of it.

    Of more than ``LANGUAGES`` values of the language column those with the most
    filled slots are learned, so what is sent around and collected is bounded.

    Rows with a null text or language, texts without a letter, and the held-out
    ones, are not used.  The text of a slot is the one of the smallest hash, found
    by map-side minima, so a language with a third of all rows costs no more than a
    small one.  Chosen texts are read whole.  Of their distinct pieces those found
    in one language only are used (all, where a language has none of its own), in
    order of their hash and as many of each text until the dictionary is full.
    """
    rank = F.xxhash64(F.col(id_col), F.lit(5))
    chosen = (
        docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)))
        .where(F.col(text_col).rlike(r"\p{L}"))
        .groupBy(F.col(lang_col).cast("string").alias("lang"), F.pmod(rank, F.lit(SLOTS)).alias("slot"))
        .agg(F.min(F.struct(rank.alias("h"), F.col(id_col).alias("id"))).alias("m"))
        .select("lang", "m.id")
    )
    chosen = saved(chosen)
    most = [r["lang"] for r in chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    chosen = chosen.where(F.col("lang").isin(most))  # at most LANGUAGES * SLOTS rows
    picked = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), ["id", "lang"])

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                some = sorted(set(pieces(text or "")))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), batch.schema.field(0).type), pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string())], names=["id", "lang", "piece"])

    kind = picked.schema["id"].dataType.simpleString()
    divided = picked.select("id", "lang", "text").mapInArrow(divide, f"id {kind}, lang string, piece string")
    # one text of each language holds a piece, however many do
    owned = divided.groupBy("piece", "lang").agg(F.min("id").alias("id")).groupBy("piece").agg(F.collect_list(F.struct("lang", "id")).alias("at"))
    known = saved(owned.select("piece", (F.size("at") == 1).alias("own"), F.inline("at")))
    learned = [r["lang"] for r in known.where("own").select("lang").distinct().collect()]
    known = known.where(F.col("own") | ~F.col("lang").isin(learned)).withColumn("bytes", F.octet_length("piece") + 1)
    order = Window.partitionBy("lang", "id").orderBy(F.xxhash64("piece"), "piece")
    ranked = known.withColumns({"k": F.row_number().over(order), "before": F.sum("bytes").over(order) - F.col("bytes")})
    # nothing beyond the first full dictionary of a text can be used; levels keep what is collected near its size
    total: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.where(F.col("before") < DICTIONARY).groupBy("lang", "k").agg(F.sum("bytes").alias("bytes")).collect():
        total.setdefault(r["lang"], []).append((r["k"], r["bytes"]))
    out = {}
    for lang, levels in sorted(total.items()):
        size = last = 0
        for last, more in sorted(levels):
            size += more
            if size >= DICTIONARY:
                break
        some = ranked.where((F.col("lang") == lang) & (F.col("k") <= last)).select("k", "piece").collect()
        data, size = [], 0
        for _, piece in sorted((r["k"], r["piece"]) for r in some):
            if size + len(piece.encode()) + 1 > DICTIONARY:
                break
            data.append(piece)
            size += len(piece.encode()) + 1
        out[lang] = " ".join(data).encode()
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected) for each row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or no language
    was learned.  Equal sizes go to the language first in order.  Only id and
    text are read; rows are judged one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coders = []
        for lang, data in sorted(dictionaries.items()):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False)))
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = normal(text or "").encode()
                if not data or not coders:
                    out.append((_is_held(key), "und", 0.0, True))
                    continue
                sizes = sorted((len(c.compress(data)), lang) for lang, c in coders)
                margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
                out.append((_is_held(key), sizes[0][1], min(1.0, margin / SCALE), margin < NARROW))
            held, lang, score, narrow = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(narrow, pa.bool_())],
                names=[id_col, "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def _is_held(key) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
