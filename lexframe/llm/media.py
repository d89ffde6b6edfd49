"""Media columns over content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG image of 64 columns, one sample a byte, under the SHA-256 of the image. Images
are appended to plain tar shards in the shared folder, each once over the whole corpus; rows carry digest, shard,
offset and length. `image_sizes` fills metadata columns from ranged reads of the 33 header bytes alone;
`read_media` reads whole images back.

To store an image once without shuffling all of them, digests are counted first. A Bloom filter of those that occur
again, of at most FILTER_BITS bits, goes to all tasks: a text that it excludes occurs once and is written where it is
read; the others, repeated ones and a few more, are shuffled by digest, one a task, and written there.

Defined cases: a null text is an empty payload of 64 zero bytes; equal texts share one image; an empty table has no
shards; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.kit import drop, keep, raw_texts, scratch, slices, texts, width

COLUMNS, HEADER = 64, 33
#: A shard is closed when it has this many bytes.
SHARD_BYTES = 64 << 20
#: Bits of the filter of repeated digests at most (8 MB), and bits a digest.
FILTER_BITS, DIGEST_BITS = 1 << 26, 16


def payload(raw: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % COLUMNS if raw else COLUMNS)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """An 8-bit grey image with a row for each 64 samples, unfiltered; equal samples give equal bytes."""
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, COLUMNS)
    lines = np.zeros((len(rows), COLUMNS + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", COLUMNS, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """Width and height from the first 33 bytes."""
    if header[:8] != b"\x89PNG\r\n\x1a\n" or header[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">II", header[16:24])


def from_png(image: bytes) -> bytes:
    """The samples of an image that `to_png` made; a chunk with a wrong checksum is an error."""
    columns, rows = png_size(image)
    at, parts = 8, []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(rows, columns + 1)[:, 1:].tobytes()


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; one without a scheme is local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Shards:
    """Appends images to tar shards below a folder. A shard appears under its final name only when complete, so a task
    that runs again leaves an unreferenced shard, never a wrong one."""

    def __init__(self, folder: str):
        self.fs, self.path = _store(folder)
        self.out, self.name, self.at = None, "", 0

    def add(self, image: bytes) -> tuple[bytes, str, int, int]:
        """(digest, shard, offset, length)."""
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.fs.create_dir(self.path, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}.part")
        digest = hashlib.sha256(image).digest()
        entry = tarfile.TarInfo(f"{digest.hex()}.png")
        entry.size = len(image)
        head = entry.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + image + bytes(-len(image) % 512))
        place = (digest, self.name, self.at + len(head), len(image))
        self.at += len(head) + len(image) + -len(image) % 512
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.fs.move(f"{self.path}/{self.name}.part", f"{self.path}/{self.name}")
            self.out = None


def _bits(sources: np.ndarray, size: int) -> np.ndarray:
    """Two bits of a filter for each digest, given as rows of 32 bytes."""
    return (np.ascontiguousarray(sources[:, :16]).view("<u8") % np.uint64(size)).astype(np.int64)


def _repeated(named: DataFrame) -> np.ndarray:
    """The bytes of a Bloom filter of the digests that stand in several rows of (source); counted before the shuffle."""
    again = named.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source")
    size, wanted = 64, min(FILTER_BITS, DIGEST_BITS * again.count())
    while size < wanted:
        size *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(np.frombuffer(b"".join(batch.column("source").to_pylist()), np.uint8).reshape(-1, 32), size).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bits"])

    found = again.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 32 rows
    out = np.zeros(size // 32, "<u4")
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the images of all texts below `folder`; (doc_id, n_bytes, digest, shard, offset, length) of each row."""
    rows = texts(docs, id_col, text_col)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    named = rows.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.unhex(F.sha2(raw, 256)).alias("source"))
    filter_ = _repeated(named.select("source")).tobytes()
    schema = "source binary, digest binary, shard string, offset long, length long, image binary"
    kinds = (pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, seen = _Shards(folder), set()
        bits = np.frombuffer(filter_, np.uint8)
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for raw in raw_texts(part.column("text")):
                    source = hashlib.sha256(raw).digest()
                    if source in seen:
                        continue
                    at = _bits(np.frombuffer(source, np.uint8)[None], 8 * len(bits))[0]
                    if (bits[at >> 3] >> (at & 7) & 1).all():
                        seen.add(source)  # those of a task that may be repeated
                        found.append((source, None, None, None, None, to_png(payload(raw))))
                    else:
                        found.append((source, *shards.add(to_png(payload(raw))), None))
                    if shards.at >= SHARD_BYTES:
                        shards.close()
                        shards.at = 0
                yield table(found)
        shards.close()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder)
        for batch in batches:
            yield table([(source, *shards.add(image), None) for source, image in zip(batch.column("source").to_pylist(), batch.column("image").to_pylist(), strict=True)])
            if shards.at >= SHARD_BYTES:
                shards.close()
                shards.at = 0
        shards.close()

    first = keep(rows.mapInArrow(single, schema), "media-first")
    again = first.where("image is not null").select("source", "image").dropDuplicates(["source"])
    second = keep(again.mapInArrow(shared, schema).drop("image"), "media-second")
    index = first.where("image is null").drop("image").unionByName(second)
    media = named.join(index, "source").select("doc_id", "n_bytes", F.lower(F.hex("digest")).alias("digest"), F.concat(F.lit(f"{folder}/"), "shard").alias("shard"), "offset", "length")
    media = keep(media, "media-rows")
    drop(first, second)
    return media


def _ranges(part: pa.RecordBatch, most: int | None = None) -> Iterator[bytes]:
    """The stored bytes of each row, or the first `most` of them, by ranged reads; a shard is opened once in a row."""
    last, file = None, None
    for shard, at, n in zip(part.column("shard").to_pylist(), part.column("offset").to_pylist(), part.column("length").to_pylist(), strict=True):
        if shard != last:
            fs, path = _store(shard)
            last, file = shard, fs.open_input_file(path)
        yield file.read_at(min(n, most or n), at)


def image_sizes(media: DataFrame) -> DataFrame:
    """The rows with columns `columns` and `rows`, from the first 33 bytes of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [png_size(x) for x in _ranges(part, HEADER)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], [*part.schema.names, "columns", "rows"])

    schema = ", ".join(f"`{n}` {t}" for n, t in media.dtypes) + ", columns long, rows long"
    return media.mapInArrow(run, schema)


def read_media(media: DataFrame) -> DataFrame:
    """The rows of `media` with (payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), computed
    from the bytes read back; an image that doesn't have its digest is an error.

    Rows are dealt by address and then id, so that the rows of an image follow each other and a task reads it once; a
    group of copies of any size is dealt over several tasks. The feature is the number of samples in each of 8 bands of
    32 levels, then the sum of all samples.
    """
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def facts(image: bytes, digest: str) -> tuple:
        if hashlib.sha256(image).hexdigest() != digest:
            raise ValueError("a stored image does not have its digest")
        samples = from_png(image)
        levels = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
        feature = ",".join(map(str, [*levels.reshape(8, 32).sum(1).tolist(), int(levels @ np.arange(256))]))
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-COLUMNS:]), len(image), digest, feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, ()
        for part in batches:
            out = []
            address = list(zip(part.column("shard").to_pylist(), part.column("offset").to_pylist(), strict=True))
            fresh = [i for i, x in enumerate(address) if x != (address[i - 1] if i else last)]
            images = _ranges(part.take(pa.array(fresh, pa.int64())))
            for i, digest in enumerate(part.column("digest").to_pylist()):
                if address[i] != last:
                    last, own = address[i], facts(next(images), digest)
                out.append(own)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], [*part.schema.names, *names])

    by = ("shard", "offset", "doc_id")
    dealt = media.repartitionByRange(width(media.sparkSession, media), *by).sortWithinPartitions(*by)
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return dealt.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in media.dtypes) + ", " + added)


def tar_names(shard: bytes) -> list[str]:
    """The names in a shard, as any tar reader finds them."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as f:
        return f.getnames()


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `write_media` with metadata from headers and the features of the images read back."""
    media = write_media(docs, scratch(docs.sparkSession, "media"), id_col, text_col)
    return image_sizes(read_media(media))
