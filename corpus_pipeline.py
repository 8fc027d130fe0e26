"""Corpus pipeline: filter, deduplicate and pack ``documents``.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
gives what it keeps, with the columns of ``documents``; the last gives the
packed pieces. Between stages the documents are written and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.llm._shared import fold_ascii, release, stage, staged_so_far, text_or_empty
from seriesmith.llm.exact_dedup import exact_dedup
from seriesmith.llm.language import identify, train_trigrams
from seriesmith.llm.packing import pack_documents
from seriesmith.llm.queries import tokenizer_path
from seriesmith.llm.shingle_copies import near_copies
from seriesmith.llm.toxicity import score_column

#: SQL can't express the model-based stages.
ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame, key: Column | None = None) -> DataFrame:
    """``docs`` less the rows named in ``dropped(_id, _key)``; null ids match.

    The key tells apart rows that share an id.
    """
    keyed = docs.withColumn("_key", key if key is not None else F.lit(0))
    match = keyed["doc_id"].eqNullSafe(dropped["_id"]) & (keyed["_key"] == dropped["_key"])
    return keyed.join(dropped, match, "left_anti").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without letters and those of no likely language."""
    key = F.xxhash64("text")
    found = identify(
        docs.withColumn("_key", key), train_trigrams(docs, "text", "lang"), id_col="doc_id", text_col="text", host=F.col("source"), carry=["_key"]
    )
    return _without(docs, found.filter("not kept").select(F.col("doc_id").alias("_id"), "_key").distinct(), key)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that the classifier scores 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return score_column(docs, labels, "doc_id", "text", others).filter("score < 0.5").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest id stays."""
    key = F.sha2(fold_ascii(text_or_empty("text")), 256)
    copies = exact_dedup(docs, keep="min").filter("not kept")
    return _without(docs, copies.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key")).distinct(), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at similarity 0.8 or more, the smallest id stays.

    SimHash proposes links, MinHash those beyond its radius; all are checked exactly.
    """
    copies = near_copies(docs).filter("node <> component")
    return _without(docs, copies.select(F.col("node").alias("_id"), F.lit(0).alias("_key")).distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 2048 tokens."""
    return pack_documents(spark, docs, tokenizer_path())


STAGES = [
    ("language", keep_known_languages),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages.

    What a stage read and staged is deleted once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = staged_so_far()
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, mark, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
