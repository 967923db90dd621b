"""The corpus pipeline: from raw documents to packed sequences.

Stages, in order: quality rules, near-duplicate removal, removal of repeated
byte strings, redaction of secrets, packing.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetspark.llm import minhash, packing, quality, repeats, secrets
from assetspark.llm.common import release, saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject.

    Null and empty texts fail the base rules; repeated rows all get one verdict.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    judged = quality.judge(rows, quality.rules_for(spark, sf_dir))
    # a generator, as a filter would be pushed below the counts and make them twice
    return judged.select(F.inline(F.filter(F.array("_row"), lambda _: F.col("kept"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows are judged by id and text: one row of equal ones stays, and a row whose
    id another text has too stays if its own text is in no other group.  Rows
    without words are near nothing and stay.
    """
    return minhash.deduplicate(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that occur twice; none of them goes, null texts stay null."""
    return repeats.remove_repeats(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose secrets are masked; none of them goes, null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null text is an empty one."""
    import public_tokenizers

    return packing.digest(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("secret_redaction", secret_redaction),
    ("packing", pack),
]

#: SQL cannot express the learned list, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if before:
            release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
