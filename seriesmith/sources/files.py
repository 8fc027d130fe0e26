"""Readers: PCM audio, manifests, job logs, JSON documents, listings."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Samples of a block, and bytes of a file's head.
BLOCK, HEAD = 1 << 19, 1 << 16
MANIFEST = "id string, mode string, tree string, rel_dir string, src string, name string, duration_sec string, size string, mtime string, dest string"


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, [frame, channel] floats in -1..1) of 8, 16, 24 or 32-bit PCM."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return rate, x.reshape(-1, channels)


def audio_header(data: bytes) -> tuple[int, int, int] | None:
    """(rate, channels, frames) from the head of a WAV, AIFF or FLAC file; None for any other."""
    if data[:4] == b"fLaC" and len(data) >= 26:
        word = int.from_bytes(data[18:26], "big")
        return word >> 44, (word >> 41 & 7) + 1, word & (1 << 36) - 1
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at, rate, channels, width = 12, 0, 0, 0
        while at + 8 <= len(data):
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name == b"fmt ":
                channels, rate, width = int.from_bytes(data[at + 10 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 16], "little"), int.from_bytes(data[at + 20 : at + 22], "little")
            if name == b"data" and width:
                return rate, channels, size // width
            at += 8 + size + size % 2
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        at = 12
        while at + 26 <= len(data):
            size = int.from_bytes(data[at + 4 : at + 8], "big")
            if data[at : at + 4] == b"COMM":
                exponent, mantissa = int.from_bytes(data[at + 16 : at + 18], "big"), int.from_bytes(data[at + 18 : at + 26], "big")
                return int(mantissa * 2.0 ** (exponent - 16383 - 63)), int.from_bytes(data[at + 8 : at + 10], "big"), int.from_bytes(data[at + 10 : at + 14], "big")
            at += 8 + size + size % 2
    return None


def audio_files(spark: SparkSession, path: str, glob: str = "*.{wav,flac,aif,aiff}") -> DataFrame:
    """path, stem, ext, rate, channels, frames and seconds of audio files; 0 seconds if unreadable.

    Only files' heads are looked at; no sample is decoded.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    head = files.select("path", F.substring("content", 1, HEAD).alias("head"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [audio_header(bytes(h)) for h in pdf["head"]]
            for i, c in enumerate(("rate", "channels", "frames")):
                pdf[c] = pd.array([f and f[i] for f in found], dtype="Int64")
            yield pdf[["path", "rate", "channels", "frames"]]

    read = head.mapInPandas(run, "path string, rate long, channels long, frames long")
    return read.select(
        "path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "rate", "channels", "frames",
        F.coalesce(F.try_divide("frames", "rate"), F.lit(0.0)).alias("seconds"),
    )


def preferred_stems(files: DataFrame, prefix: str = "drums_", whole: str = "full") -> DataFrame:
    """One file for each kind of stem (``<prefix><kind>``), FLAC before WAV, the composite left out: kind, path."""
    kind = F.regexp_extract("stem", f"^{prefix}(.+)$", 1)
    own = files.withColumn("kind", kind).filter((F.col("kind") != "") & (F.col("kind") != whole) & F.col("ext").isin("flac", "wav"))
    best = F.min(F.struct(F.when(F.col("ext") == "flac", 0).otherwise(1).alias("r"), "path"))
    return own.groupBy("kind").agg(best["path"].alias("path"))


def read_audio(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """samples(stem, block_ix, start, sr, ch, pcm) of a folder's WAV files, in blocks of mono sums.

    Files that can't be decoded give one row with a null rate.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["stem", "block_ix", "start", "sr", "ch", "pcm"]
        for pdf in batches:
            for stem, content in zip(pdf.stem, pdf.content):
                try:
                    rate, x = decode_wav(content)
                except (wave.Error, EOFError, KeyError):
                    yield pd.DataFrame([(stem, 0, 0, None, None, None)], columns=cols)
                    continue
                mono = x.mean(axis=1)
                for i, a in enumerate(range(0, max(1, len(mono)), BLOCK)):
                    yield pd.DataFrame([(stem, i, a, rate, x.shape[1], mono[a : a + BLOCK])], columns=cols)

    return named.mapInPandas(run, "stem string, block_ix int, start long, sr int, ch int, pcm array<float>")


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A tab-separated manifest whose header must be the schema's names."""
    read = spark.read.option("sep", "\t").option("quote", "")
    header = read.option("header", "true").csv(path).columns
    wanted = StructType.fromDDL(schema).names
    if header != wanted:
        raise ValueError(f"the manifest's columns are {header}, not {wanted}")
    return read.option("header", "true").schema(schema).csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def read_log(spark: SparkSession, path: str, schema: str = "ts string, id string, status string, secs double, error string") -> DataFrame:
    """An append-only log of JSON lines; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_documents(spark: SparkSession, path: str, schema: str, *, version: int, kind: str) -> DataFrame:
    """Whole JSON documents with a state: present, newer, older or unreadable.

    ``schema`` must have kind and version fields.
    """
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc"))
    ok = (F.col("doc.kind") == kind) & F.col("doc.version").isNotNull()
    state = F.when(~F.coalesce(ok, F.lit(False)), "unreadable").when(F.col("doc.version") > version, "newer").when(F.col("doc.version") < version, "older").otherwise("present")
    return raw.withColumn("state", state)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, folder, name, ext, size, mtime of files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+?)(\.[^./]+)?$", 1).alias("name"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").cast("long").alias("mtime"),
    )
