"""Merkle-tree document fingerprints.

A text is cut into paragraphs (lines and sentences, long ones into pieces of
at most 64 code points); each paragraph hashes to a 64-bit leaf. Leaves whose
hash is divisible by 8 open a new section, so that an edit moves no section
border elsewhere. A section hashes its leaves, the root hashes the sections.
Equal roots mean equal texts; sections and leaves that differ locate an edit.
All of it is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ._shared import text_or_empty

#: Up to 64 code points of a paragraph with the marks that end it.
PARAGRAPH = r"[^\n.!?]{1,64}[\n.!?]*|[\n.!?]+"
#: One leaf in so many opens a section.
SECTION = 8
#: Cells of the id histogram (2**CELL_BITS quantiles), the error of their
#: ranks as a part of all rows, and text bytes aimed at for a neighbour bucket.
CELL_BITS, CELL_ERROR, BUCKET_BYTES = 14, 1 / 200_000, 8 << 20


def leaves(text: Column) -> Column:
    """64-bit hashes of the paragraphs, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))


def _tree(leaf: Column) -> Column:
    """The leaves as 16 hex digits each, ``|`` before each section's first."""
    return F.array_join(
        F.transform(
            leaf,
            lambda x: F.concat(F.when(x % SECTION == 0, F.lit("|")).otherwise(F.lit("")), F.lpad(F.lower(F.hex(x)), 16, "0")),
        ),
        "",
    )


def _rooted(tree: Column) -> Column:
    sections = F.transform(F.split(tree, r"\|"), lambda s: F.hex(F.xxhash64(s)))
    return F.concat(F.md5(F.array_join(sections, ",").cast("binary")), F.lit(":"), tree)


def fingerprint(text: Column) -> Column:
    """``root:tree``: the root's 32 hex digits, then leaves by section."""
    return _rooted(_tree(leaves(text)))


def root(print_: Column) -> Column:
    """Root of a fingerprint; equal for equal texts."""
    return F.substring_index(print_, ":", 1)


def print_leaves(print_: Column) -> Column:
    """Leaves (16 hex digits each) of a fingerprint, in order."""
    flat = F.replace(F.substring(print_, 34, 1 << 30), F.lit("|"), F.lit(""))
    return F.filter(F.split(F.regexp_replace(flat, "(.{16})", "$1 "), " "), lambda x: x != "")


def likeness(a: Column, b: Column) -> Column:
    """Dice likeness (0 to 1) of two leaf arrays, by distinct leaves.

    Two empty trees are alike (1.0).
    """
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(2.0 * both / all_)


def differing_leaves(a: Column, b: Column) -> Column:
    """Positions in ``a`` of leaves that ``b`` lacks: where an edit lies."""
    return F.filter(
        F.transform(a, lambda x, i: F.when(~F.array_contains(b, x), i)), lambda i: i.isNotNull()
    )


def with_next(df: DataFrame, id_col: str, size: Column, columns: list[str]) -> DataFrame:
    """Add ``next_<c>`` of the next row by descending id, the first's to the last.

    Rows are dealt by a byte-balanced histogram over approximate quantiles of
    the ids (2**CELL_BITS cells, so the map that is broadcast never has more
    rows, and no gap or far id crowds a cell), sorted inside buckets, and the
    first row of each bucket is copied behind the last of the one before. No
    window spans the whole table, and each row moves once. Ids are integers.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    top = 1 << CELL_BITS
    ranks = F.array_distinct(F.percentile_approx(id_col, [i / top for i in range(1, top)], int(1 / CELL_ERROR)))
    # quantiles are few and go along with every row's task as one value
    cuts = df.agg(F.coalesce(ranks, F.array().cast("array<bigint>")).cast("array<bigint>").alias("_cuts"))
    df = df.crossJoin(F.broadcast(cuts))
    # how many quantiles are not above the id, by halving
    found = F.aggregate(
        F.array(*(F.lit(1 << k) for k in reversed(range(CELL_BITS)))),
        F.lit(0),
        lambda below, step: below + F.when(F.get("_cuts", below + step - 1) <= F.col(id_col), step).otherwise(0),
    )
    # nulls come last in descending order: below every id
    df = df.withColumn("_cell", F.when(F.col(id_col).isNull(), -1).otherwise(found)).drop("_cuts")
    cell = F.col("_cell")
    by_cell = df.groupBy(cell.alias("_cell")).agg(F.sum(size).alias("b"), F.max(id_col).alias("top"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("_cell")  # over at most 2**CELL_BITS + 1 rows
    raw = by_cell.withColumn("raw", F.floor(F.sum("b").over(order) / BUCKET_BYTES))
    dense = raw.withColumn("_bucket", (F.dense_rank().over(Window.orderBy("raw")) - 1).cast("int"))
    tops = dense.groupBy("_bucket").agg(F.max("_cell").alias("_cell"))
    count = F.max("_bucket").over(Window.partitionBy(F.lit(0))) + 1
    map_ = (
        dense.withColumn("_buckets", count)
        .join(F.broadcast(tops.withColumnRenamed("_cell", "_last")), "_bucket")
        .select("_cell", "_bucket", "_buckets", F.when(F.col("_cell") == F.col("_last"), F.col("top")).alias("_top"), (F.col("_cell") == F.col("_last")).alias("_at_top"))
    )
    is_head = F.col("_at_top") & F.col(id_col).eqNullSafe(F.col("_top"))
    dealt = (
        df.join(F.broadcast(map_), "_cell")
        .withColumn(
            "_to",
            F.when(
                is_head,
                F.array(
                    F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")),
                    F.struct(F.pmod(F.col("_bucket") + 1, F.col("_buckets")).alias("b"), F.lit(1).alias("g")),
                ),
            ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")))),
        )
        .withColumn("_to", F.explode("_to"))
        .select(id_col, *columns, F.col("_to.b").alias("_b"), F.col("_to.g").alias("_g"))
    )
    w = Window.partitionBy("_b").orderBy("_g", F.desc_nulls_last(id_col), columns[0])
    following = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return following.filter("_g = 0").drop("_b", "_g")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, and compare with the next.

    The edited text has its last floor(n_chars / 3) code points replaced by
    the first as many (or all) of the next row's text by descending id; after
    the last row comes the first. Null texts count as empty; null ids come
    last; rows of one id follow each other by text. A single row is its own
    next. Gives doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next; an empty table gives none.
    """
    base = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    sized = F.octet_length("t").cast("long") + 64
    linked = with_next(base.withColumn("l", leaves(F.col("t"))), "doc_id", sized, ["t", "l"])
    n = F.char_length("t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("t"), F.lit(1), n - third), F.substring(F.col("next_t"), F.lit(1), third)
    )
    made = linked.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("e"), "l", F.col("next_l").alias("m"))
    made = made.select(
        "doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"), "l", "m", leaves(F.col("e")).alias("d")
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _rooted(_tree(F.col("l"))).alias("fingerprint"),
        _rooted(_tree(F.col("d"))).alias("edited_fingerprint"),
        likeness(F.col("l"), F.col("d")).alias("near_edited"),
        likeness(F.col("l"), F.col("m")).alias("near_next"),
    )
