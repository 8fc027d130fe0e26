"""The subpackage's queries over the shared test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .exact_dedup import exact_dedup
from .fingerprints import fingerprint_edits
from .language import identify_corpus, identify_pages
from .lm_scoring import score_documents
from .packing import pack_documents
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .toxicity import score_toxicity
from .warc import archive_round_trip


def tokenizer_path() -> str:
    """Place of the byte-level BPE file among the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives and read them back through the index."""
    return archive_round_trip(spark, _table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def vocabulary_path() -> str:
    """Place of the 32k-piece vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal log-probabilities of all documents."""
    return score_documents(spark, _table(spark, sf_dir, "documents"), vocabulary_path(), class_col="lang")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents and pages, by text, markup, address and host."""
    return identify_corpus(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages, by text, markup, address and host."""
    return identify_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard all documents by bytes, equal texts together."""
    return shard_by_bytes(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return encode_documents(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of every document and its edited text."""
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents' tokens into windows of 2048."""
    return pack_documents(spark, _table(spark, sf_dir, "documents"), tokenizer_path())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts; the largest id of a class stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="max")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_warc,
        op3_simhash,
        op4_lm_scoring,
        op5_language,
        language_of_pages,
        op6_sharding,
        op7_bpe,
        op8_fingerprints,
        op9_packing,
        op10_exact_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
        ), k AS (
            SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS keeper FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
            CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM k""",
    "op10_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM t JOIN g USING (t)""",
}
