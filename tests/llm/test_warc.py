import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from flowquarry.llm import warc


def pages(spark):
    big = "".join(f"<p>{i}</p>" for i in range(30_000))
    rows = [(3, "http://a/ x", big), (1, "http://b", "x" * 100), (2, None, "x" * 100), (9, "u", "x" * 99), (8, "u", "x" * 99), (4, "u", None), (5, "u", ""), (7, "u", big), (None, "u", big), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (2, "u", "x" * 100)]
    return spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")


def test_round_trip_with_segments_and_revisits(spark):
    rows = warc.archive_round_trip(pages(spark), segment_bytes=1000).collect()
    assert len(rows) == 11
    html = {r.page_id: (r.html or "").encode() for r in pages(spark).collect() if r.page_id is not None}
    for r in rows:
        if r.page_id is not None:
            assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=str)
    assert kinds == sorted([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 3), (8, "response", None), (9, "response", None), (None, "response", None)], key=str)


def test_files_are_plain_archives(spark, tmp_path):
    warc.write_archives(pages(spark), f"file://{tmp_path}/out", segment_bytes=5000)
    found = [h for f in glob.glob(f"{tmp_path}/out/*.gz") for h, _ in warc.parse(gzip.open(f).read())]
    kinds = [h["warc-type"] for h in found]
    assert kinds.count("revisit") == 3 and kinds.count("continuation") > 30
    totals = [h for h in found if "warc-segment-total-length" in h]
    assert len(totals) == 2 and all(int(h["warc-segment-number"]) > 1 for h in totals)


def test_missing_segments_are_noticed(spark):
    import pyspark.errors

    rows = [("o", "response", 1, None, None, "o", 1, None, b"ab"), ("p", "continuation", 1, None, None, "o", 3, 6, b"ef")]
    with pytest.raises(pyspark.errors.PySparkException):
        warc.reassembled(spark.createDataFrame(rows, warc.RECORD)).collect()


def test_missing_responses_are_noticed(spark, tmp_path):
    import pyspark.errors

    path = f"file://{tmp_path}/out"
    two = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200), (3, "u", "y" * 200)], "page_id long, url string, html string")
    warc.write_archives(two, path)
    kept = spark.read.format("text").load(path).count()
    assert kept > 3
    records = warc.read_records(spark, path).where("page_id <> 1")
    name = f"file://{tmp_path}/part"
    lines = [warc.record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:x>"), ("X-Page-Id", "2"), ("X-Refers-To-Page-Id", "1"), ("WARC-Payload-Digest", "sha256:00")], b"")[:-1]]
    spark.createDataFrame([(x.decode(),) for x in lines], "value string").coalesce(1).write.option("compression", "gzip").text(name)
    assert records.count() == 2
    with pytest.raises(pyspark.errors.PySparkException):
        warc.read_archives(spark, name).collect()


def test_a_very_long_page(spark):
    html = "".join(f"<li>{i}</li>" for i in range(600_000))
    rows = warc.archive_round_trip(spark.createDataFrame([(1, "u", html), (2, "u", html)], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in rows} == {(i, len(html), hashlib.sha256(html.encode()).hexdigest()) for i in (1, 2)}


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 8193, 100_000):
        body = bytes(i % 251 for i in range(n))
        assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nabc\r\n0\r\n\r\n")


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page_id", [4, None])
def test_equal_long_pages_of_two_tasks_are_two_records(spark, page_id):
    html = "".join(f"<td>{i}</td>" for i in range(8_000))
    two = spark.createDataFrame([(page_id, "u", html)], "page_id long, url string, html string")
    pages = two.unionAll(two).unionAll(spark.createDataFrame([(9, "u", html)], two.schema))
    assert pages.rdd.getNumPartitions() >= 2
    found = sorted(tuple(r) for r in warc.archive_round_trip(pages).select(F.coalesce("page_id", F.lit(-1)), "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())
    digest = hashlib.sha256(html.encode()).hexdigest()
    # A null id is never the smallest, so page 9 keeps its own response beside those.
    own = (-1 if page_id is None else page_id, len(html), digest, "response", -1)
    other = (9, len(html), digest, "response", -1) if page_id is None else (9, len(html), digest, "revisit", 4)
    assert found == sorted([own, own, other])


def test_archives_are_read_member_by_member():
    records = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], bytes([i % 256]) * (i * 977)) for i in range(40)]
    whole = [(h["warc-record-id"], b) for h, b in warc.parse(b"".join(records))]
    assert whole == [(f"<{i}>", bytes([i % 256]) * (i * 977)) for i in range(40)]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        for size in (1, 7, 1000, 1 << 20):
            if size > 1 or len(data) < 20_000:
                assert [(h["warc-record-id"], b) for h, b in warc.parse(warc.unzipped(data, size))] == whole
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(warc.unzipped(gzip.compress(b"".join(records))[:-400])))
    with pytest.raises(ValueError, match="does not end"):
        list(warc.parse(records[3][:-6]))
