"""Personal data and what gives it away.

Four kinds of values are found by fixed patterns: e-mail addresses, IP addresses, card numbers and phone numbers. Each
distinct value is a protected entity. Corpus co-occurrence then estimates how strongly a term reveals an entity: over
documents, PMI(t; e) = log2(n_te * N / (n_t * n_e)) bits of the IC(e) = log2(N / n_e) bits that identify the entity,
where a term belongs to all entities that its documents hold. A term whose PMI is at least `remove` times
IC(e) is removed, at least `generalise` times it is generalised, at each place in the documents that hold the entity.

A term reaches the threshold only if n_t <= n_te * (N / n_e) ** (1 - generalise), and n_te <= n_e: terms too frequent for
every entity of their document are left out before pairs are made. The bound is exact, it leaves out no pair that counts.

Defined cases: a null text is empty; offsets count code points, ends are exclusive; a value in every document has no
information and no term reveals it; a document is a row, so all numbers count repeated rows and rows with equal ids alike;
rows with null ids report their base spans only and are not counted; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.llm.kit import keep, slices, texts

#: The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "term")
REMOVE, GENERALISE = 0.9, 0.75

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Attempts from inside a run of digits can't succeed where the one from its start failed, so they are not made.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap. The sign @ stands outside all classes, so each match has the run of
    characters before one; a run without @ is never tried."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            least = m.end()
        at = text.find("@", max(at + 1, least))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the values of the four kinds, by start and then kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.sub("", m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def _value(text: str, kind: str) -> str:
    """The value of a span, without the ways of writing it."""
    return kind + ":" + (text.lower() if kind in ("email", "ip") else _DIGITS.sub("", text))


def _name(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


_SPAN = "start bigint, end bigint, kind string"


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 500_000) -> DataFrame:
    """(term, n_t): the number of rows with ids in which each term occurs. Each task sends one row for each
    distinct term of up to `most` it holds at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def close() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([_name(t) for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return batch

        get = counts.get
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    for t in set(_WORD.findall(text.lower())):
                        counts[t] = get(t, 0) + 1
                if len(counts) > most:
                    yield close()
        if counts:
            yield close()

    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    return rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, entities, text): the base spans of each row, its distinct entities, and its text if it has both an
    entity and an id."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                spans, entities, left = [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = base_spans(text or "")
                    spans.append([{"start": a, "end": b, "kind": k} for a, b, k in own])
                    entities.append(sorted({_name(_value(text[a:b], k)) for a, b, k in own}))
                    left.append(text if own and doc_id is not None else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, span_type), pa.array(entities, pa.list_(pa.int64())), pa.array(left, pa.string())], ["doc_id", "spans", "entities", "text"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans array<struct<{_SPAN.replace(' ', ': ').replace(',:', ',')}>>, entities array<bigint>, text string")


def _distinct_terms(rows: DataFrame) -> DataFrame:
    """(row, most, term) of the distinct words outside all spans of (row, most, spans, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: tuple[list, ...] = ([], [], [])
                for row, most, spans, text in zip(*(part.column(c).to_pylist() for c in ("row", "most", "spans", "text")), strict=True):
                    own = {text[a:b].lower() for a, b in free_words(text, [(s["start"], s["end"], s["kind"]) for s in spans])}
                    for column, values in zip(out, ([row] * len(own), [most] * len(own), map(_name, own)), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64())], ["row", "most", "term"])

    return rows.select("row", "most", "spans", "text").mapInArrow(run, "row long, most double, term long")


def free_words(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the words that don't overlap a span; spans are in order of their starts."""
    k, covered = 0, 0
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            covered = max(covered, spans[k][1])
            k += 1
        if covered <= m.start():
            yield m.span()


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, base, terms): the base spans of each row, and the spans (start, end, action) of all occurrences of the
    terms that disclose an entity of the document.

    Texts are shuffled only where they hold an entity and a disclosing term; terms and entities travel as 64-bit names.
    """
    found = keep(find(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    n = float(found.where("doc_id is not null").count())
    held = found.where("text is not null").select("row", F.explode("entities").alias("entity"))
    n_e = held.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") < n)
    held = keep(held.join(n_e, "entity"), "pii-held")  # (entity, row, n_e)
    most = held.groupBy("row").agg((F.pow(F.max("n_e").cast("double"), F.lit(generalise)) * F.pow(F.lit(n), F.lit(1 - generalise)) * (1 + 1e-6)).alias("most"))
    rare = _distinct_terms(found.where("text is not null").join(most, "row")).join(document_counts(docs, id_col, text_col), "term").where("n_t <= most")
    rare = keep(rare.select("row", "term", "n_t"), "pii-rare")
    pairs = rare.join(held, "row").groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    pmi = F.log2(F.col("n_te") * F.lit(n) / (F.col("n_t") * F.col("n_e")))
    ratio = F.round(pmi / F.log2(F.lit(n) / F.col("n_e")), 9)
    told = pairs.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= generalise)
    told = told.select("entity", "term", F.when(F.col("ratio") >= remove, "remove").otherwise("generalise").alias("action"))
    acts = rare.join(held, "row").join(told, ["entity", "term"]).groupBy("row", "term").agg(F.max("action").alias("action"))
    acts = acts.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("acts"))  # at most the distinct words of one document
    term_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                terms = []
                for spans, text, own in zip(*(part.column(c).to_pylist() for c in ("spans", "text", "acts")), strict=True):
                    action = dict(own)
                    places = ((a, b, action.get(_name(text[a:b].lower()))) for a, b in free_words(text, [(s["start"], s["end"], s["kind"]) for s in spans]))
                    terms.append([{"start": a, "end": b, "action": x} for a, b, x in places if x])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(terms, term_type)], ["row", "terms"])

    marked = found.where("text is not null").join(acts, "row").select("row", "spans", "text", "acts").mapInArrow(mark, "row long, terms array<struct<start: bigint, end: bigint, action: string>>")
    empty = F.array().cast("array<struct<start: bigint, end: bigint, action: string>>")
    return found.select("row", "doc_id", "spans").join(marked, "row", "left").select("doc_id", F.col("spans").alias("base"), F.coalesce("terms", empty).alias("terms"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(base: Column, terms: Column) -> Column:
    """Base spans and terms (as spans of kind `term`) by start and then kind as listed in KINDS."""
    order = F.create_map(*[F.lit(x) for k, v in enumerate(KINDS) for x in (v, k)])
    as_spans = F.concat(base, F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("term").alias("kind"))))
    keyed = F.array_sort(F.transform(as_spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return keyed


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """(doc_id, text) with each base span replaced by its kind in brackets, terms to generalise by [number] or [word],
    and terms to remove by nothing. Needs distinct ids; rows with null ids are left out."""
    spans = detect(docs, id_col, text_col, **thresholds)
    rows = texts(docs, id_col, text_col).join(spans, "doc_id").select("doc_id", "text", "base", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True):
                cuts = [(s["start"], s["end"], f"[{s['kind']}]") for s in base]
                for s in terms:
                    word = text[s["start"] : s["end"]]
                    cuts.append((s["start"], s["end"], "" if s["action"] == "remove" else "[number]" if any(c.isdigit() for c in word) else "[word]"))
                parts, at = [], 0
                for a, b, new in sorted(cuts):
                    if a >= at:  # of spans that overlap, the first is written and the rest of the others is covered
                        parts += [text[at:a], new]
                    at = max(at, b)
                out.append("".join(parts) + (text or "")[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")
