import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from pourscale.llm import warc

LONG = "<p>é</p>" * 300
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", "short"), (3, None, None), (4, "http://a/4", LONG), (5, "http://a/5\nx: y", "short"), (6, "http://a/6", "")]
PAGES += [(7, "http://b", LONG + "x"), (8, "u", "y" * 1000), (9, "u", "y" * 1000), (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "big", "0123456789" * 200_000), (4, "http://a/4", LONG)]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("warc"))
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id bigint, url string, html string, digest string, record_type string").repartition(3)
    return folder, warc.write_archives(pages, folder)


def expected(row):
    html = (row[2] or "").encode()
    same = [p[0] for p in PAGES if (p[2] or "").encode() == html]
    revisit = len(html) >= 1000 and row[0] != max(same)
    return (row[0], hashlib.sha1(html).hexdigest(), len(html), "revisit" if revisit else "response", max(same) if revisit else None)


def test_round_trip(archive):
    _, files = archive
    rows = [r for r in warc.read_archives(files).collect() if r["record_type"] != "warcinfo"]
    assert sorted((r["page_id"], r["payload_digest"], r["payload_length"], r["record_type"], r["refers_to"]) for r in rows) == sorted(map(expected, PAGES))
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert all(bytes(r["payload"]) == (html[r["page_id"]] if r["record_type"] == "response" else b"") for r in rows)


def test_filters_are_pushed_and_payloads_skipped(archive, spark):
    _, files = archive
    plain = warc.read_archives(files, payload=False)
    assert all(r["payload"] is None for r in plain.collect())
    found = warc.read_archives(files).where((F.col("record_type") == "revisit") & F.col("page_id").isin(1, 8, 9))
    assert sorted(r["page_id"] for r in found.collect()) == [1, 8]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def test_any_gzip_reader_reads_the_files(archive):
    _, files = archive
    raw = b"".join(gzip.decompress(open(r["file"].removeprefix("file:"), "rb").read()) for r in files.collect())
    assert raw.count(b"WARC-Type: response\r\n") == sum(expected(p)[3] == "response" for p in PAGES)
    assert b"WARC-Target-URI: http://a/5x: y\r\n" in raw


def test_members_without_size_field_and_record_skipping(tmp_path):
    parts = [warc.record("response", i, f"u{i}", "d", len(b), None, b) for i, b in enumerate([b"one", b"2" * 2_000_000, b"", b"four"])]
    for sized in (True, False):
        path = tmp_path / f"{sized}.warc.gz"
        path.write_bytes(b"".join(warc.member(p) if sized else gzip.compress(p) for p in parts))
        with open(path, "rb") as f:
            got = list(warc.records(f, path.stat().st_size, lambda h: h["warc-target-uri"] != "u0", True))
        assert [b for _, b in got] == [b"2" * 2_000_000, b"", b"four"]


def test_partitions_follow_the_sizes():
    reader = warc.WarcReader({"files": "a\t60\nb\t50\nc\t10\nd\t500", "partition_bytes": "100"})
    assert [[f[0] for f in p.value] for p in reader.partitions()] == [["a"], ["b", "c"], ["d"]]


def test_query_and_empty_table(spark, tmp_path):
    from pourscale.llm.queries import QUERIES

    spark.createDataFrame(PAGES[:-1], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/a/pages.parquet")
    rows = [(r["page_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in QUERIES["op2_warc"](spark, f"{tmp_path}/a").collect()]
    assert sorted(rows) == sorted(map(expected, PAGES[:-1]))
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/b/pages.parquet")
    assert QUERIES["op2_warc"](spark, f"{tmp_path}/b").count() == 0
