"""Shared storage and column helpers of the subpackage."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Only where a local session leaves it unset (tests) a temporary folder of
    this process is used instead; a cluster's session must set it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="seriesmith-"))


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage on storage that outlives executors, and lets joins
    on the result start from plain exchanges, which adaptive execution can
    split when a key is hot.
    """
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    """A mark to give to ``release``."""
    return len(_STAGED)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what was staged after the mark, but for the files that ``keep`` reads.

    Whoever writes a result calls this afterwards: results are lazy, and read
    what their operators staged.
    """
    kept = [f for df in keep for f in df.inputFiles()]
    jvm = spark.sparkContext._jvm
    for path in _STAGED[since:]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if not any(path.split(":", 1)[-1].lstrip("/") in f for f in kept):
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _STAGED.remove(path)


def text_or_empty(col: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    Pure ASCII texts take the JVM's fast path; others are translated letter
    by letter, so that accented capitals stay as they are.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
