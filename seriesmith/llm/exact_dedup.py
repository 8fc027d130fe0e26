"""Exact deduplication by 128-bit content hash, with bytes compared.

Rows are grouped by (MD5, text): tasks first fold their own copies, so a hot
group sends one row per task, and grouping by the text itself compares the
bytes inside each hash group. What comes out is one small row per class of
equal texts; the documents themselves then move only as (id, hash).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import fold_ascii, stage, text_or_empty


def content_hash(text: Column) -> Column:
    """MD5 of the text's UTF-8 bytes, 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "min",
    normalize: Callable[[Column], Column] = fold_ascii,
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest ("min") or the largest ("max") id of a
    class of equal texts stays. Null texts count as empty texts, and all empty
    texts form one class. Null ids never win against other ids; a class with
    null ids only has keep_id null and all its rows kept. Rows that repeat the
    kept id with the same text are the same document and are all kept. An
    empty table gives an empty result. Other columns of ``df`` are not read.

    Two texts with one hash are told apart: where any hash has more than one
    class, the documents are joined to the classes by the text as well.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = df.select(
        F.col(id_col).alias("doc_id"), normalize(text_or_empty(text_col)).alias("t")
    ).select("doc_id", "t", hash_of(F.col("t")).alias("h"))
    folded = rows.groupBy("h", "t").agg(
        best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    facts = ["keep_id", "group_size", F.sha2("t", 256).alias("text_sha256")]
    classes = stage(folded.select("h", *facts), "dedup-classes")
    collides = not classes.groupBy("h").count().filter("count > 1").isEmpty()
    if collides:
        classes = stage(folded.select("h", "t", *facts), "dedup-classes-texts")
        joined = rows.join(classes, ["h", "t"])
    else:
        joined = rows.select("doc_id", "h").join(classes, "h")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
