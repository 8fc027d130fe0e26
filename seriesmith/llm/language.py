"""Language identification by Bayesian evidence fusion.

Sources of evidence are multiplied (their logarithms added) for each
language: the likelihood of the text under hashed character trigrams; the
declared markup language; the address suffix (the host's last label) and a
two-letter first folder of the path; and the prior of the host. How far
declarations, suffixes and folders can be trusted is counted against what the
text alone says, by grouped aggregation. Host priors are smoothed towards the
domain's, the domain's towards the whole table's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stage
from .ngrams import bounded, hashes, laid_out, position_sums

LENGTH, HASH_BITS = 3, 16
#: The text's log-likelihood counts as if it had at most so many trigrams.
TRIGRAMS = 64
#: Pseudo-counts that carry a domain's prior into a host's, and so on.
SMOOTH = 10.0
#: A row is kept if its language is at least so probable.
LEAST = 0.5


def train_trigrams(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their [2**HASH_BITS, languages] log-probabilities.

    Counts cover all rows with a language, and every label is a language. Tasks
    send at most 2**HASH_BITS sums of each language that they meet.
    """
    labels = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("l")).distinct()
    names = sorted(r["l"] for r in labels.collect())
    if not names:
        return [], np.zeros((1 << HASH_BITS, 0), np.float32)
    place = {l: i for i, l in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = defaultdict(lambda: np.zeros(1 << HASH_BITS, np.int64))
        for b in batches:
            lang = np.array([place.get(x, -1) for x in b.column(1).to_pylist()])
            for k in np.unique(lang[lang >= 0]).tolist():
                texts = [t.as_py() for t, x in zip(b.column(0), lang) if x == k]
                for codes, starts, _ in laid_out(texts, LENGTH - 1):
                    if len(codes) >= LENGTH:
                        h, inside = hashes(codes, LENGTH, HASH_BITS), np.zeros(len(codes) + 1, np.int64)
                        first, stop = bounded(starts, len(codes), LENGTH)
                        np.add.at(inside, first, 1)
                        np.add.at(inside, stop, -1)
                        seen[k] += np.bincount(h[np.cumsum(inside)[: len(h)] > 0], minlength=1 << HASH_BITS)
        for k, own in seen.items():
            g = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k), pa.int32()), pa.array(g, pa.int32()), pa.array(own[g], pa.int64())], ["k", "g", "n"])

    sums = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).mapInArrow(run, "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n"))
    counts = np.full((1 << HASH_BITS, len(names)), 0.1)
    for r in sums.toLocalIterator():
        counts[r["g"], r["k"]] += r["n"]
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_evidence(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([texts, languages] log-likelihoods, number of trigrams with a letter)."""
    languages = table.shape[1]
    logs, size = np.zeros((len(texts), languages)), np.zeros(len(texts))
    for codes, starts, index in laid_out(texts, LENGTH - 1):
        if len(codes) < LENGTH:
            continue
        first, stop = bounded(starts, len(codes), LENGTH)
        h = hashes(codes, LENGTH, HASH_BITS)
        letters = codes[1 : len(h) + 1] != 32
        np.add.at(size, index, position_sums(letters, first, stop))
        for k in range(languages):
            np.add.at(logs[:, k], index, position_sums(table[h, k] * letters, first, stop))
    return logs * (np.minimum(size, TRIGRAMS) / np.maximum(size, 1))[:, None], size


def _trust(seen: DataFrame, value: str, languages: int) -> DataFrame | None:
    """(value, _trusted): log P(value | language) as an array by language, from (value, best, n)."""
    rows = seen.filter(F.col(value).isNotNull() & F.col("best").isNotNull())
    each = [(F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(0)) + 0.5).alias(f"n{k}") for k in range(languages)]
    counts = stage(rows.groupBy(value).agg(*each), "language-trust")
    totals = counts.agg(*(F.sum(f"n{k}") for k in range(languages))).first()
    if totals[0] is None:
        return None
    return counts.select(value, F.array(*(F.log(F.col(f"n{k}") / F.lit(float(t))) for k, t in enumerate(totals))).alias("_trusted"))


def identify(
    rows: DataFrame,
    model: tuple[list[str], np.ndarray],
    *,
    id_col: str,
    text_col: str,
    host: Column | None = None,
    domain: Column | None = None,
    declared: Column | None = None,
    suffix: Column | None = None,
    folder: Column | None = None,
    carry: list[str] | None = None,
    least: float = LEAST,
) -> DataFrame:
    """Language of every row from its text and what else is known of it.

    Gives the id, the ``carry`` columns, language, confidence,
    text_language, n_letters and kept. Evidence that is null (or not given) is left out.
    Texts without a letter, null texts among them, are never kept and have
    language ``und`` unless a declaration, suffix, folder or host speaks for one; ties
    go to the language first in the alphabet. Without languages all is
    ``und``.
    """
    names, table = model
    none = F.lit(None).cast("string")
    carry = carry or []
    picked = rows.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.coalesce(host if host is not None else none, F.lit("")).alias("_host"),
        F.coalesce(domain if domain is not None else none, F.lit("")).alias("_domain"),
        (declared if declared is not None else none).alias("_declared"),
        (suffix if suffix is not None else none).alias("_suffix"),
        (folder if folder is not None else none).alias("_folder"),
        *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)),
    )
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logs, size = text_evidence(b.column(1).to_pylist(), shared.value)
            keep = [i for i in range(b.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in keep), pa.array(list(logs), pa.list_(pa.float64())), pa.array(size.astype(np.int64))],
                [*(b.schema.names[i] for i in keep), "_logs", "n_letters"],
            )

    kept_fields = [f for f in picked.schema if f.name != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields)
    read = stage(picked.mapInArrow(run, f"{schema}, _logs array<double>, n_letters long"), "language-evidence")
    label = F.array(*(F.lit(x) for x in names)) if names else F.array(F.lit("und"))
    first_best = lambda logs: (F.array_position(logs, F.array_max(logs)) - 1).cast("int")
    read = read.withColumn("best", F.when((F.col("n_letters") > 0) & F.lit(bool(names)), first_best(F.col("_logs"))))
    out_cols = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]
    if not names:
        return read.select(F.col("_id").alias(id_col), *out_cols, F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), "n_letters", F.lit(False).alias("kept"))

    # counts of what the texts say, by host, domain and in all
    hosts = stage(
        read.filter("best is not null").groupBy("_host", "_domain", "_declared", "_suffix", "_folder", "best").agg(F.count(F.lit(1)).alias("n")), "language-counts"
    )
    each = [F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in range(len(names))]
    whole = hosts.agg(*each).first()
    totals = [float(x or 0) + 1.0 for x in whole]
    base = F.array(*(F.lit(t / sum(totals)) for t in totals))

    def smoothed(above: Column) -> Column:
        n = F.array(*(F.col(f"n{k}") for k in range(len(names))))
        total = sum((F.col(f"n{k}") for k in range(len(names))), F.lit(0.0))
        return F.zip_with(n, above, lambda x, p: (x + SMOOTH * p) / (total + SMOOTH))

    domains = hosts.groupBy("_domain").agg(*each).select("_domain", smoothed(base).alias("_above"))
    priors = stage(
        hosts.groupBy("_host", "_domain").agg(*each).join(domains, "_domain").select("_host", "_domain", smoothed(F.col("_above")).alias("_prior")), "language-priors"
    )
    joined = read.join(priors, ["_host", "_domain"], "left")
    joined = joined.withColumn("_sum", F.zip_with("_logs", F.coalesce("_prior", base), lambda x, p: x + F.log(p)))
    for given, value in ((declared, "_declared"), (suffix, "_suffix"), (folder, "_folder")):
        trusted = _trust(hosts, value, len(names)) if given is not None else None
        if trusted is not None:
            none_known = F.array_repeat(F.lit(0.0), len(names))
            joined = joined.join(trusted, value, "left").withColumn("_sum", F.zip_with("_sum", F.coalesce("_trusted", none_known), lambda x, y: x + y)).drop("_trusted")
    weight = F.aggregate("_sum", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.array_max("_sum")))
    known = (F.col("n_letters") > 0) | F.col("_declared").isNotNull() | F.col("_suffix").isNotNull() | F.col("_folder").isNotNull()
    made = joined.select(
        F.col("_id").alias(id_col),
        *out_cols,
        F.when(known, F.element_at(label, first_best(F.col("_sum")) + 1)).otherwise("und").alias("language"),
        F.when(known, 1.0 / weight).otherwise(0.0).alias("confidence"),
        F.element_at(label, F.col("best") + 1).alias("text_language"),
        "n_letters",
    )
    return made.withColumn("kept", (F.col("n_letters") > 0) & (F.col("confidence") >= least))


#: Markup language of a page, and the parts of its address.
HTML_LANG = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"
SUFFIX = r"\.([a-z][a-z0-9-]*)\.?$"
FOLDER = r"^[^/]*//[^/]+/([a-zA-Z]{2})(?=/|$)"


def identify_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Languages of ``documents``: trained on their labels, the source as host.

    A row's text and lang are among the trigram counts that it is scored
    with; beyond that its lang is no evidence.
    """
    model = train_trigrams(docs, "text", "lang")
    return identify(docs, model, id_col="doc_id", text_col="text", host=F.col("source"), least=least)


def _page_rows(pages: DataFrame) -> DataFrame:
    """page_id, _body, and the evidence beside it: _host, _domain, _declared, _suffix, _folder."""
    host = F.lower(F.regexp_extract(F.col("url"), HOST, 1))
    html = F.col("html")
    known = lambda c: F.nullif(c, F.lit(""))
    return pages.select(
        "page_id",
        F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ").alias("_body"),
        known(host).alias("_host"),
        F.substring_index(host, ".", -2).alias("_domain"),
        known(F.lower(F.regexp_extract(html, HTML_LANG, 1))).alias("_declared"),
        known(F.regexp_extract(host, SUFFIX, 1)).alias("_suffix"),
        known(F.lower(F.regexp_extract(F.col("url"), FOLDER, 1))).alias("_folder"),
    )


def _fused(rows: DataFrame, docs: DataFrame, id_col: str, least: float, carry: list[str] | None = None) -> DataFrame:
    """Languages of such rows by all evidence, trained on the documents' labels."""
    given = {c: F.col(f"_{c}") for c in ("host", "domain", "declared", "suffix", "folder")}
    return identify(rows, train_trigrams(docs, "text", "lang"), id_col=id_col, text_col="_body", carry=carry, least=least, **given)


def identify_pages(pages: DataFrame, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Languages of web pages from text, markup, address suffix, folder and host."""
    return _fused(_page_rows(pages), docs, "page_id", least)


def identify_corpus(docs: DataFrame, pages: DataFrame, least: float = LEAST) -> DataFrame:
    """Languages of documents and pages by one model: doc_id or page_id, the other null.

    Pages bring markup, address suffix, folder, host and domain; documents
    have their source as host. All count in the same priors.
    """
    of_docs = docs.select("doc_id", F.col("text").alias("_body"), F.col("source").alias("_host"))
    rows = of_docs.unionByName(_page_rows(pages), allowMissingColumns=True)
    return _fused(rows, docs, "doc_id", least, ["page_id"])
