"""Media columns: exact round trips through real tar shards and images."""

import hashlib
import tarfile
import zlib

from lexframe.llm import media
from lexframe.llm.kit import scratch

ROWS = [(1, "abc"), (2, None), (3, ""), (4, "x" * 64), (5, "é" * 100), (6, "abc"), (6, "abc"), (None, "null id"), (7, "word " * 30_000)]


def test_image():
    for raw in (b"", b"a", b"\0" * 64, bytes(range(256)) * 5):
        data = media.payload(raw)
        assert len(data) % 64 == 0 and len(data) > 0 and data.startswith(raw) and not data[len(raw) :].strip(b"\0")
        image = media.to_png(data)
        assert media.from_png(image) == data and media.png_size(image[: media.HEADER]) == (64, len(data) // 64)


def test_shards_are_tar_files(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, digest string").repartition(3)
    rows = media.write_media(docs, scratch(spark, "media")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        with open(r.shard.removeprefix("file://"), "rb") as f:
            shard = f.read()
        image = shard[r.offset : r.offset + r.length]
        assert hashlib.sha256(image).hexdigest() == r.digest and f"{r.digest}.png" in media.tar_names(shard)
        with tarfile.open(r.shard.removeprefix("file://")) as f:
            assert f.extractfile(f"{r.digest}.png").read() == image
    assert len({(r.shard, r.offset) for r in rows}) == len({r.digest for r in rows})
    want = {i: len((t or "").encode()) for i, t in ROWS}
    assert {r.doc_id: r.n_bytes for r in rows} == want


def test_features(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    got = media.media_features(docs).collect()
    assert len(got) == len(ROWS)
    want = {i: t for i, t in ROWS}
    for r in got:
        data = media.payload((want[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r.media_sha256, r.media_bytes, r.rows) == (hashlib.sha256(media.to_png(data)).hexdigest(), len(media.to_png(data)), len(data) // 64)
        assert r.feature.split(",")[-1] == str(sum(data))
    assert media.media_features(docs.limit(0)).count() == 0


def test_one_copy_over_the_corpus(spark, tmp_path):
    """Each image stands once in all shards, whatever tasks met it."""
    texts = [f"text {i % 7} " * (i % 7 + 1) for i in range(60)] + [f"alone {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = media.write_media(docs, f"file://{tmp_path}/m").collect()
    names = [n for p in (tmp_path / "m").iterdir() for n in media.tar_names(p.read_bytes())]
    assert len(names) == len(set(names)) == len(set(texts)) == len({(r.shard, r.offset) for r in rows}) and len(rows) == 100


def test_full_filter_changes_nothing(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(60)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(media, "FILTER_BITS", 64)
    rows = media.write_media(docs, f"file://{tmp_path}/m").collect()
    names = [n for p in (tmp_path / "m").iterdir() for n in media.tar_names(p.read_bytes())]
    assert len(names) == len(set(names)) == 30 and len(rows) == 60


def test_query(spark):
    from lexframe.llm.queries import op9_media

    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        raw = (r.text or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        want[r.doc_id] = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    got = op9_media(spark, d).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got} == want and len(got) == len(want)
