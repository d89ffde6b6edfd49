"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexframe.llm import bpe, decontam, kit, licenses, line_dedup, media, ngram_join, pii, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a vocabulary file; the package with the files is looked up only where it is needed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_runs(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    rows = bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, pattern())
    rows = rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return kit.keep(rows, "bpe-digests")  # small batches for Python; the digests are small


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    return rows.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(pii.all_spans(F.col("base"), F.col("terms"))).alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_RUNS = [*decontam.MASKS, *("1" * n for n in range(1, min(map(len, decontam.MASKS))))]


def _op6_seeds(source: str, id_: str) -> str:
    """Seeds of every mask and, for items too short for one, of the whole item."""
    return " union all ".join(f"select {id_}, p, '{m}' || array_to_string([{', '.join(f'tok[p+{i}]' for i, x in enumerate(m) if x == '1')}], ' ') as seed from (select {id_}, tok, unnest(range(1, len(tok) - {len(m)} + 2)) as p from {source} where len(tok) {'=' if id_ == 'item_id' and '0' not in m else '>='} {len(m)})" for m in _RUNS)


OP6_SQL = rf"""
with d as (select doc_id, {_WORDS} as tok from documents), b as (select distinct item_id, {_WORDS} as tok from benchmark),
ds as ({_op6_seeds("d", "doc_id")}),
bs as ({_op6_seeds("b", "item_id")}),
hits as (select distinct doc_id, item_id, ds.p - bs.p as diagonal from ds join bs using (seed)),
wide as (select doc_id, item_id, diagonal, d.tok as dt, b.tok as bt, unnest(range(1, len(b.tok) + 1)) as j from hits join d using (doc_id) join b using (item_id)),
same as (select distinct doc_id, item_id, len(bt) as n_tokens, j from wide where diagonal + j >= 1 and diagonal + j <= len(dt) and dt[diagonal + j] = bt[j])
select doc_id, item_id, count(*) as matched, n_tokens, round(count(*) / n_tokens, 6) as coverage
from same group by doc_id, item_id, n_tokens having count(*) >= 0.5 * n_tokens
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(_table(spark, sf_dir, "pages"), kit.scratch(spark, "warc"))
    rows = warc.read_archive(spark, path)
    return rows.select(F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))


OP7_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as body, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select *, min(page_id) over (partition by d) as first from p),
g as (select *, n >= 100 and page_id <> first as again, chr(13) || chr(10) as e from f),
h as (select *, 'WARC/1.1' || e || 'WARC-Type: ' || case when again then 'revisit' else 'response' end || e || 'WARC-Record-ID: <urn:record:' || page_id || '>' || e || 'WARC-Date: 2000-01-01T00:00:00Z' || e
|| coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || e, '') || 'WARC-Payload-Digest: sha256:' || d || e
|| case when again then 'WARC-Profile: {warc.PROFILE}' || e || 'WARC-Refers-To: <urn:record:' || first || '>' || e else '' end
|| 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || case when again then 0 else n end || e || e || case when again then '' else body end || e || e as record from g)
select page_id, n as payload_bytes, d as payload_digest, case when again then 'revisit' else 'response' end as record_type,
case when again then first end as refers_to, octet_length(encode(record)) as record_bytes, sha256(record) as record_sha256 from h
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "columns", "rows")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_line_dedup": op1_line_dedup, "op1_line_runs": op1_line_runs, "op2_byte_bpe": op2_byte_bpe, "op3_ngram_join": op3_ngram_join, "op4_licenses": op4_licenses, "op6_decontamination": op6_decontamination, "op7_warc": op7_warc, "op5_pii": op5_pii, "op8_toxicity": op8_toxicity, "op9_media": op9_media, "op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE_SQL, "op4_licenses": licenses.oracle_sql(), "op6_decontamination": OP6_SQL, "op7_warc": OP7_SQL}
