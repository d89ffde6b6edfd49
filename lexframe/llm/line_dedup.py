"""Removal of repeated runs of lines, cut into content-defined chunks.

Each line is hashed, and a rolling hash over the hashes of `window` lines chooses the lines after which a chunk ends
(one in `divisor`, and after every `longest` lines of a chunk without such an end), so an inserted or removed line moves
only the boundaries next to it. Chunks of two lines and more whose hash occurs again anywhere are candidates. Every
candidate is compared byte by byte with the first one of its hash, by document id and then place, and removed if equal;
that first one stays.

Chunks are what the SQL defines, and they leave most runs of a few lines. `dedup_runs` takes out whole repeated runs
instead: all of two or more consecutive lines that stand together earlier too.

Defined cases: null and empty texts stay as they are; a chunk of one line is never removed; rows with null ids are
neither removed from nor compared with; equal rows keep the same chunks, and rows with equal ids and other texts are told
apart by their chunks; the line end after a removed chunk goes with it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.kit import keep, light, slices, texts

WINDOW, DIVISOR, LONGEST = 2, 3, 64


def cut(lines: list[bytes], window: int = WINDOW, divisor: int = DIVISOR, longest: int = LONGEST) -> list[tuple[int, int]]:
    """The chunks of a text as (first line, line after the last)."""
    n = len(lines)
    hashes = np.array([int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in lines], dtype=np.int64)
    rolling, factor = hashes.copy(), 1
    for k in range(1, min(window, n)):
        factor = factor * 31 % (1 << 32)
        rolling[k:] += hashes[:-k] * factor % (1 << 32)
    ends = np.flatnonzero(rolling % (1 << 32) % divisor == 0) + 1
    edges = np.unique(np.concatenate([[0], ends, [n]])).tolist()
    return [(at, min(at + longest, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) for at in range(a, b, longest)]


def _chunks(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, chunk, name[, body]) of the chunks of two lines and more; `wanted`, where there, holds the chunks to send."""
    for batch in batches:
        for part in slices(batch, "text"):
            out: tuple[list, ...] = ([], [], [], [])
            wanted = part.column("wanted").to_pylist() if with_text else [None] * part.num_rows
            for doc_id, text, want in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), wanted, strict=True):
                lines = (text or "").encode().split(b"\n")
                for k, (a, b) in enumerate(cut(lines)):
                    if b - a < 2 or want is not None and k not in want:
                        continue
                    body = b"\n".join(lines[a:b])
                    row = (doc_id, k, int.from_bytes(hashlib.md5(body).digest()[:8], "big", signed=True), body)
                    for x, y in zip(out, row, strict=True):
                        x.append(y)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns if with_text else columns[:3], ["doc_id", "chunk", "name", "body"] if with_text else ["doc_id", "chunk", "name"])


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, name): the chunks to remove, by number and hash.

    Hashes are grouped with a partial aggregation before the shuffle; only chunks whose hash repeats are fetched and
    compared, each with the one row of the first, in a join that adaptive execution splits where a hash is frequent.
    """
    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    names = keep(rows.mapInArrow(light(lambda b: _chunks(b, False)), "doc_id long, chunk long, name long"), "line-names")
    once = names.groupBy("name", "doc_id").agg(F.min("chunk").alias("chunk"), F.count_distinct("chunk").alias("n"))
    firsts = once.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n")).where("n > 1")
    firsts = firsts.join(once.select("name", "doc_id", "chunk"), ["name", "doc_id"]).select("name", F.col("doc_id").alias("first_doc"), F.col("chunk").alias("first_chunk"))
    wanted = names.join(firsts.select("name"), "name").groupBy("doc_id").agg(F.collect_set("chunk").alias("wanted"))  # at most the chunks of one document
    bodies = keep(rows.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(light(lambda b: _chunks(b, True)), "doc_id long, chunk long, name long, body binary"), "line-bodies")
    marked = bodies.join(firsts, "name").withColumn("first", (F.col("doc_id") == F.col("first_doc")) & (F.col("chunk") == F.col("first_chunk")))
    marked = keep(marked, "line-marked")
    owners = marked.where("first").groupBy("name").agg(F.first("body").alias("first_body"))
    return marked.where("not first").join(owners, "name").where("body = first_body").select("doc_id", "chunk", "name").distinct()


def _name(body: bytes) -> int:
    return int.from_bytes(hashlib.md5(body).digest()[:8], "big", signed=True)


def _without(text: str | None, gone: list[dict] | None) -> tuple[str | None, int, int, int, int]:
    """(text, lines, chunks, removed lines, removed chunks) of a text without some chunks; one with another hash stays."""
    lines = (text or "").encode().split(b"\n")
    chunks, lost = cut(lines), {x["chunk"]: x["name"] for x in gone or ()}
    lost = {k for k, name in lost.items() if k < len(chunks) and _name(b"\n".join(lines[slice(*chunks[k])])) == name}
    kept = [x for k, (a, b) in enumerate(chunks) if k not in lost for x in lines[a:b]]
    return text if not lost else b"\n".join(kept).decode(), len(lines), len(chunks), len(lines) - len(kept), len(lost)


def _listed(gone: DataFrame) -> DataFrame:
    return gone.select(F.col("doc_id").alias("__id"), "chunk", "name").groupBy("__id").agg(F.collect_list(F.struct("chunk", "name")).alias("__gone"))  # at most the chunks of one document


def remove_chunks(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_chunks, n_removed_lines, n_removed_chunks) after the chunks of `gone` are taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [_without(*x) for x in zip(part.column("text").to_pylist(), part.column("__gone").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[i] for x in out], pa.int64() if i else pa.string()) for i in range(5))], ["doc_id", "text", "n_lines", "n_chunks", "n_removed_lines", "n_removed_chunks"])

    rows = texts(docs, id_col, text_col)
    rows = rows.join(_listed(gone), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "__gone")
    return rows.mapInArrow(light(run), "doc_id long, text string, n_lines long, n_chunks long, n_removed_lines long, n_removed_chunks long")


def rewrite(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All columns of each row, with the chunks of `gone` taken out of its text in place and, with `length_col`, that
    column set to the length in characters of a text that changed. A row of which nothing is left goes."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                out = [_without(*x) for x in zip(part.column(text_col).to_pylist(), part.column("__gone").to_pylist(), strict=True)]
                own = {text_col: pa.array([x[0] for x in out], pa.string())}
                if length_col in names:
                    old = part.column(length_col)
                    own[length_col] = pa.array([len(x[0]) if x[4] else n for x, n in zip(out, old.to_pylist(), strict=True)], old.type)
                left = pa.array([not x[4] or x[0] != "" for x in out], pa.bool_())
                yield pa.RecordBatch.from_arrays([own.get(c, part.column(c)) for c in names], names).filter(left)

    rows = docs.join(_listed(gone), F.col(id_col) == F.col("__id"), "left").drop("__id")
    return rows.mapInArrow(light(run), docs.schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, one, two) of each two consecutive lines: the place of the first and two names of both."""
    for batch in batches:
        for part in slices(batch, "text"):
            ids, places, names = [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                names += [hashlib.md5(a + b"\n" + b).digest() for a, b in zip(lines[:-1], lines[1:], strict=True)]
                ids.append(np.full(len(lines) - 1, doc_id, dtype=np.int64))
                places.append(np.arange(len(lines) - 1, dtype=np.int64))
            both = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
            columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, places)] + [np.ascontiguousarray(both[:, k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "at", "one", "two"])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at): the places of consecutive lines that stand together earlier too, by document id and then place.

    Each two consecutive lines are a seed, so a run of any length from two lines on is covered from its first line to its
    last by the pairs that overlap in it. Names have 128 bits and decide by themselves. The first pair of each name stays
    and so do pairs that overlap it. A removed line has an equal one that is left: the pair that it is removed for stands
    strictly earlier.
    """
    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    pairs = keep(rows.mapInArrow(light(_pairs), "doc_id long, at long, one long, two long"), "line-pairs")
    place = F.struct("doc_id", "at")
    firsts = pairs.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("one", "two", "first")
    later = (F.col("doc_id") > F.col("first.doc_id")) | (F.col("doc_id") == F.col("first.doc_id")) & (F.col("at") >= F.col("first.at") + 2)
    return pairs.join(firsts, ["one", "two"]).where(later).select("doc_id", "at").distinct()


def remove_runs(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_removed_lines) after both lines of each pair of `gone` are taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: tuple[list, ...] = ([], [], [])
                for text, places in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    lines = (text or "").encode().split(b"\n")
                    lost = {x for at in places or () for x in (at, at + 1)}
                    kept = [x for k, x in enumerate(lines) if k not in lost]
                    for x, y in zip(out, (text if not lost else b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)), strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out[0], pa.string()), *[pa.array(x, pa.int64()) for x in out[1:]]], ["doc_id", "text", "n_lines", "n_removed_lines"])

    lost = gone.groupBy("doc_id").agg(F.collect_list("at").alias("gone"))  # at most the lines of one document
    rows = texts(docs, id_col, text_col).join(lost, "doc_id", "left").select("doc_id", "text", "gone")
    return rows.mapInArrow(light(run), "doc_id long, text string, n_lines long, n_removed_lines long")


def dedup_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`remove_runs` of the `repeated_runs`."""
    return remove_runs(docs, repeated_runs(docs, id_col, text_col), id_col, text_col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`remove_chunks` of the `repeated_chunks`."""
    return remove_chunks(docs, repeated_chunks(docs, id_col, text_col), id_col, text_col)


ORACLE_SQL = f"""
with l as (select doc_id, text, unnest(range(len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as line from documents),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint as h from l),
r as (select *, (h + coalesce(lag(h) over w, 0) * 31 % 4294967296) % 4294967296 % {DIVISOR} = 0 as stop from h window w as (partition by doc_id order by i)),
c as (select *, coalesce(sum(stop::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as natural_chunk from r),
f as (select *, (row_number() over (partition by doc_id, natural_chunk order by i) - 1) // {LONGEST} as part from c),
k as (select doc_id, natural_chunk, part, min(i) as pos, count(*) as n, string_agg(line, chr(10) order by i) as body from f group by doc_id, natural_chunk, part),
m as (select *, n > 1 and row_number() over (partition by body, n > 1 order by doc_id, pos) > 1 as gone from k)
select doc_id, sum(n)::bigint as n_lines, count(*) as n_chunks, coalesce(sum(n) filter (gone), 0)::bigint as n_removed_lines, count(*) filter (gone) as n_removed_chunks,
sha256(coalesce(string_agg(body, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from m group by doc_id
union all select doc_id, 1, 1, 0, 0, sha256('') from documents where text is null
"""
