"""WARC archives: every byte back, copies as revisits."""

import hashlib

from pyspark.sql import functions as F

from seriesmith.llm._shared import stage, staged_path
from seriesmith.llm.warc import archive_round_trip, coalesce_ranges, parse_record, plan_records, read_records, record_bytes, write_archives

SCHEMA = "page_id long, url string, html string, digest string, file string"
PAGES = [(1, "http://a.example/x?y=1", "é" * 600), (2, None, "é" * 600), (9, "http://b/ é\r\nX: y", "é" * 600), (4, "", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "z\r\n\r\n" * 3000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_round_trip(spark):
    rows = {r["page_id"]: r for r in archive_round_trip(spark, pages(spark)).collect()}
    assert len(rows) == len(PAGES)
    for i, _, html in PAGES:
        payload = (html or "").encode()
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        kind = ("revisit", 9) if i in (1, 2) else ("response", None)
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == kind


def test_null_ids_repeats_and_empty(spark):
    big = "b" * 2000
    rows = archive_round_trip(spark, pages(spark, [(None, "u", big), (3, "u", big), (3, "u", big), (None, "v", "c" * 2000)])).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in rows) == [
        ("3", "response", "None"), ("3", "response", "None"), ("None", "response", "None"), ("None", "revisit", "3")]
    assert archive_round_trip(spark, pages(spark).limit(0)).count() == 0


def test_index_selects_records(spark):
    index = stage(write_archives(plan_records(pages(spark)), staged_path(spark, "warc")), "index")
    assert {r["page_id"] for r in read_records(index.filter(F.col("page_id").isin(4, 8))).collect()} == {4, 8}
    for r in index.collect():
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            warc, _, payload = parse_record(f.read(r["length"]))
        assert warc["warc-payload-digest"] == f"sha1:{r['digest']}" and warc["warc-type"] == r["record_type"]


def test_ranges_join_near_reads():
    assert coalesce_ranges([(0, 10), (12, 5), (500, 5), (505, 5)], gap=5, most=100) == [(0, 17, 0, 2), (500, 510, 2, 4)]
    assert coalesce_ranges([(0, 60), (60, 60)], gap=5, most=100) == [(0, 60, 0, 1), (60, 120, 1, 2)]


def test_a_wrong_length_is_refused():
    raw = record_bytes(1, "u", b"abc", "d", "response", None)
    for broken in (raw[:-1], raw[1:]):
        try:
            parse_record(broken)
        except ValueError:
            continue
        raise AssertionError
