"""Content-addressed web archive.

`write_archive` stores each distinct payload once, under its SHA-256, and the exact header of every record apart from
it. `read_archive` verifies every stored payload against its digest, joins the two again, and gives the bytes of each
record as a WARC file would hold them.

Defined cases: a null body is an empty payload; a null URL leaves out WARC-Target-URI; line ends inside a URL are
percent-encoded; records without an id are responses; equal rows are equal records; an empty table is an empty archive;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm.kit import write

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """`name: value` and a line end; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(value.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 100, date: str = "2000-01-01T00:00:00Z") -> str:
    """Writes `path`/payloads and `path`/headers; returns `path`.

    Of records with equal payloads of at least `least` bytes, the one with the smallest id is a response and the others
    revisit it. Only (digest, id) pairs are shuffled to find it, combined before the shuffle; payloads are dealt by
    (digest, id), which no group of copies can skew.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long"), "key": F.coalesce("id", F.lit(-1))})
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    owners = first.select(F.col("digest").alias("d"), F.coalesce("first", F.lit(-1)).alias("f"))
    own = rows.select("digest", "key", "payload").join(owners, (F.col("digest") == F.col("d")) & (F.col("key") == F.col("f")), "left_semi")
    # Equal rows are dealt to the same place by the join already, so the second grouping shuffles nothing.
    write(own.groupBy("digest", "key").agg(F.first("payload").alias("payload")).select("digest", "payload"), f"{path}/payloads")

    again = (F.col("bytes") >= least) & (F.col("id") != F.col("first"))
    again = F.coalesce(again, F.lit(False))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("WARC-Refers-To", F.when(again, _urn(F.col("first")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    write(rows.drop("payload").join(first, "digest").select("digest", header.alias("header")), f"{path}/headers")
    return path


def _field(name: str) -> Column:
    """The value of a header line, null where there is none."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _id(name: str) -> Column:
    return F.regexp_extract(F.coalesce(_field(name), F.lit("")), r"^<urn:record:(-?\d+)>$", 1).try_cast("long")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, bytes): the stored payloads; one that doesn't have its digest is an error."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    right = F.sha2("payload", 256)
    return stored.select(F.when(right == F.col("digest"), right).otherwise(F.raise_error(F.lit("a stored payload does not have its digest"))).alias("digest"), "payload", F.octet_length("payload").cast("long").alias("bytes"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, type, refers_to, digest, payload, header, record) of every record: parsed from its header, joined to the
    verified payload by digest, and put together again. `record` is header, block and two line ends, byte for byte; a
    revisit has an empty block. One payload meets all its headers in a join that adaptive execution splits."""
    headers = spark.read.schema("digest string, header string").parquet(f"{path}/headers")
    block = F.when(_field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    record = F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    parsed = headers.select(F.substring(_field("WARC-Payload-Digest"), 8, 64).alias("digest"), "header")
    return parsed.join(payloads(spark, path), "digest").select(_id("WARC-Record-ID").alias("id"), _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("type"), _id("WARC-Refers-To").alias("refers_to"), "digest", "payload", "header", record.alias("record"))
