"""The archive read back, byte for byte."""

import hashlib

from pyspark.sql import functions as F

from lexframe.llm import warc
from lexframe.llm.kit import scratch

BIG, SMALL = "<p>" + "é" * 80, "tiny"
ROWS = [(5, "http://a", BIG), (2, "http://b\r\nX: y", BIG), (9, None, BIG), (1, "http://c", SMALL), (3, "http://d", SMALL), (4, "http://e", None), (6, "http://f", ""), (7, "http://g", "x" * 100), (8, "http://h", "x" * 100), (None, "http://i", BIG)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    path = warc.write_archive(pages, scratch(spark, "warc"))
    got = {r.id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(ROWS)
    for i, url, html in ROWS:
        raw = (html or "").encode()
        assert (bytes(got[i].payload), got[i].digest) == (raw, hashlib.sha256(raw).hexdigest())
    assert {i: r.refers_to for i, r in got.items()} == {5: 2, 2: None, 9: 2, 1: None, 3: None, 4: None, 6: None, 7: None, 8: 7, None: None}
    stored = warc.payloads(spark, path)
    assert stored.count() == stored.select("digest").distinct().count() == 4
    for r in got.values():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:] == b"\r\n\r\n"
        if fields["WARC-Type"] == "response":
            assert "sha256:" + hashlib.sha256(rest[:n]).hexdigest() == fields["WARC-Payload-Digest"]
        else:
            assert n == 0 and fields["WARC-Refers-To"] in ("<urn:record:2>", "<urn:record:7>")


def test_damage_is_found(spark):
    path = scratch(spark, "warc")
    warc.write_archive(spark.createDataFrame(ROWS[:2], "page_id long, url string, html string"), path)
    spark.createDataFrame([("00", bytearray(b"x"))], "digest string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    try:
        warc.payloads(spark, path).select(F.max("digest")).collect()
    except Exception as e:
        assert "digest" in str(e)
    else:
        raise AssertionError("damage was not found")


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(spark, warc.write_archive(pages, scratch(spark, "warc"))).count() == 0


def test_equal_rows_store_once(spark):
    long = "<p>" + "word " * 500_000
    pages = spark.createDataFrame([(4, "http://a", BIG), (4, "http://a", BIG), (-1, "u", "y" * 200), (None, "u", "y" * 200), (8, "u", long), (9, "v", long)], "page_id long, url string, html string").repartition(4)
    path = warc.write_archive(pages, scratch(spark, "warc"))
    assert warc.payloads(spark, path).count() == 3 and warc.read_archive(spark, path).count() == 6
