"""WARC archives: write records, index them, read selected records by range.

Writers put one archive per task into a shared folder and return the index
(file, offset, length, URL, digest, ...) as rows. A retried task writes a
file of another name, and only the rows of the attempt that Spark commits
name its file, so lost executors leave at most unread files behind. Readers
sort the index rows of a file by offset, join neighbouring ranges into one
read and cut the records out of it. Files are opened through Arrow's file
systems, so the folder may be on any store they know.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit, urlunsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import stage, staged_path, text_or_empty

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smallest payload that is written once and revisited, in bytes.
REVISIT_BYTES = 1000
#: Ranges at most so far apart are read at once, up to so many bytes a read.
GAP, READ = 64 << 10, 8 << 20
#: Bytes of archives that a reading task is meant for.
TASK_BYTES = 16 << 20

INDEX = "page_id long, url string, record_type string, refers_to long, digest string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _target(url: str | None, page_id: int | None) -> str:
    """The URL in ASCII without blanks or line ends; null or empty: a urn."""
    if not url:
        return f"urn:page:{page_id}"
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]-._")


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One WARC record with its closing blank lines.

    A response holds the HTTP headers and the payload; a revisit the HTTP
    headers only, with the id of the record that has the payload.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if record_type == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one whole record."""
    def headers(block: bytes) -> dict[str, str]:
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in block.decode().split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record at this offset")
    warc = headers(head)
    length = int(warc["content-length"])
    block, end = rest[:length], rest[length:]
    if end != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write ``plan`` (page_id, url, html, digest, record_type, refers_to); the index.

    One archive per task; the result must be materialised once (``stage``).
    """
    names = [x.split()[0] for x in INDEX.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        at = 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None:
                    where, base = _opened(folder)
                    where.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc"
                    path, out = f"{folder}/{name}", where.open_output_stream(f"{base}/{name}")
                raw = record_bytes(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["record_type"], r["refers_to"])
                out.write(raw)
                rows.append((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["digest"], path, at, len(raw)))
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names
                )
        if out is not None:
            out.close()

    return plan.select("page_id", "url", "html", "digest", "record_type", "refers_to").mapInArrow(write, INDEX)


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """(offset, end, first, last + 1) of joint reads of ranges sorted by offset."""
    out: list[list[int]] = []
    for i, (offset, length) in enumerate(ranges):
        end = offset + length
        if out and offset - out[-1][1] <= gap and max(end, out[-1][1]) - out[-1][0] <= most:
            out[-1][1], out[-1][3] = max(end, out[-1][1]), i + 1
        else:
            out.append([offset, end, i, i + 1])
    return [tuple(x) for x in out]


def read_records(index: DataFrame) -> DataFrame:
    """Read the records that ``index`` selects: RECORD columns.

    Responses' digests are computed anew and must equal the recorded ones;
    a revisit has the length and digest of the payload that it refers to.
    There are as many tasks as the records' bytes ask for.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def one(raw: bytes) -> tuple:
        warc, http, payload = parse_record(raw)
        digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
        size = int(http["content-length"])
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {warc['warc-record-id']} differs from its digest")
        page, refers = warc.get("x-page-id"), warc.get("x-refers-to-page")
        return page and int(page), size, digest, kind, refers and int(refers)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = source = None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)]
            begin, n, rows = 0, len(cols[0]), []
            while begin < n:
                stop = begin
                while stop < n and cols[0][stop] == cols[0][begin]:
                    stop += 1
                if cols[0][begin] != path:
                    if source is not None:
                        source.close()
                    path = cols[0][begin]
                    where, name = _opened(path)
                    source = where.open_input_file(name)
                ranges = list(zip(cols[1][begin:stop], cols[2][begin:stop]))
                for offset, end, a, b in coalesce_ranges(ranges):
                    source.seek(offset)
                    data = source.read(end - offset)
                    rows += [one(data[x - offset : x - offset + y]) for x, y in ranges[a:b]]
                begin = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if source is not None:
            source.close()

    # a range of one file's offsets may go to another task: nothing hangs on a file being whole
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return (
        index.select("file", "offset", "length")
        .repartitionByRange(total // TASK_BYTES + 1, "file", "offset")
        .sortWithinPartitions("file", "offset")
        .mapInArrow(read, RECORD)
    )


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Add digest, record_type and refers_to to page_id, url and html.

    Of pages with equal payloads (SHA-1 and MD5) of ``least`` bytes or more,
    that with the largest id is the response and the others revisit it. The
    payloads move once, dealt by page; the grouping sees digests only.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    payload = text_or_empty("html").cast("binary")
    keyed = base.withColumns({"digest": F.sha1(payload), "md5": F.md5(payload)})
    small = keyed.select("page_id", "digest", "md5", F.octet_length("html").alias("n"))
    large = small.filter(F.col("n") >= least)
    firsts = stage(
        large.groupBy("digest", "md5").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and keeper is not null"),
        "warc-firsts",
    )
    revisits = stage(
        large.join(firsts, ["digest", "md5"])
        .filter(~F.col("page_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("md5").alias("m"))
        .agg(F.max("keeper").alias("refers_to")),
        "warc-revisits",
    )
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("md5") == F.col("m"))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return keyed.join(revisits, same, "left").select("page_id", "url", "html", "digest", kind.alias("record_type"), "refers_to")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write a record per page, index the records, read them all back.

    Gives page_id, payload_bytes, payload_digest, record_type, refers_to.
    Null html is an empty payload; null or odd URLs are written in a safe
    form; pages with a null id are responses unless an equal payload has an
    id. Rows that repeat one page are written each, with the same type.
    """
    index = stage(write_archives(plan_records(pages), staged_path(spark, "warc")), "warc-index")
    return read_records(index)
