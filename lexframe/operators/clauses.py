"""Sections of contracts and the clause types they have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.functions import lexicon as lx
from lexframe.functions.textcols import hits, sections, strip


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start_char, end_char, text): one row for each section; null texts have one empty section."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.posexplode(sections(F.col("text"))).alias("section", "s")).select("doc_id", "section", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.text").alias("text"))


def _headed(pattern: lx.ClausePattern, first_line: Column) -> Column:
    return F.rlike(first_line, F.lit("(?iuU)" + "|".join(pattern.headings)))


def section_score(pattern: lx.ClausePattern, lower: Column, first_line: Column) -> Column:
    """0.5 for a heading, 0.3 to 0.6 for enough keywords, 0.1 for two more than enough."""
    heading = _headed(pattern, first_line)
    n = hits(lower, pattern.keywords)
    size = len(pattern.keywords)
    by_hits = F.array(*[F.lit((0.3 + k / size * 0.3 if k >= pattern.hits else 0.0) + (0.1 if k >= pattern.hits + 2 else 0.0)) for k in range(size + 1)])
    return F.when(heading, 0.5).otherwise(0.0) + F.get(by_hits, n)


def scored_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: Sequence[lx.ClausePattern] = lx.CLAUSES) -> DataFrame:
    """Sections of at least 20 characters with a column `score_<type>` for each type."""
    rows = split_sections(docs, id_col, text_col).where(F.length(strip(F.col("text"))) >= 20)
    rows = rows.withColumns({"lower": F.lower("text"), "first_line": F.lower(F.get(F.split(strip(F.col("text")), "\n", 2), F.lit(0)))})
    return rows.select("doc_id", "section", "start_char", "end_char", "text", *[section_score(p, F.col("lower"), F.col("first_line")).alias(f"score_{p.name}") for p in patterns])


def clauses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", types: Sequence[str] | None = None, patterns: Sequence[lx.ClausePattern] = lx.CLAUSES) -> DataFrame:
    """(doc_id, seq, clause_type, text, confidence, start_char, end_char).

    The first type in order whose score is positive names a section. A filter by type follows that choice and can't
    precede it; names that aren't types are ignored, and if none is one nothing is filtered.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(clause_array(F.col(text_col), patterns)).alias("c")).select("doc_id", "c.*")
    known = {t.strip().lower() for t in types or ()} & {p.name for p in patterns}
    return found.where(F.col("clause_type").isin(*sorted(known))) if known else found


def clause_array(text: Column, patterns: Sequence[lx.ClausePattern] = lx.CLAUSES) -> Column:
    """array<struct<seq, clause_type, text, confidence, start_char, end_char>> of the clauses of a text, in their order.
    Types are tried one after another up to the first that a section has; only that one is scored."""

    def first(lower: Column, line: Column) -> Column:
        have = lambda p: _headed(p, line) | (hits(lower, p.keywords) >= p.hits)
        return F.coalesce(*[F.when(have(p), F.struct(F.lit(p.name).alias("type"), section_score(p, lower, line).alias("score"))) for p in patterns])

    own = F.transform(sections(F.coalesce(text, F.lit(""))), lambda s, i: F.struct(i.alias("seq"), s["text"].alias("whole"), strip(s["text"]).alias("text"), s["start"].alias("start_char"), s["end"].alias("end_char")))
    own = F.filter(own, lambda s: F.length(s["text"]) >= 20)
    own = F.transform(own, lambda s: F.struct(s.alias("s"), F.lower(s["whole"]).alias("lower"), F.lower(F.get(F.split(s["text"], "\n", 2), F.lit(0))).alias("line")))
    own = F.filter(F.transform(own, lambda x: F.struct(x["s"].alias("s"), first(x["lower"], x["line"]).alias("c"))), lambda x: x["c"].isNotNull())
    return F.transform(own, lambda x: F.struct(x["s"]["seq"].alias("seq"), x["c"]["type"].alias("clause_type"), x["s"]["text"].alias("text"), F.least(x["c"]["score"], F.lit(1.0)).alias("confidence"), x["s"]["start_char"].alias("start_char"), x["s"]["end_char"].alias("end_char")))


def page_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, full_text, ranges): pages joined by blank lines, and where each begins and ends; a separator belongs to
    the page before it."""
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))  # the pages of one document
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page: int, start: int, end: int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["text"]) + 2
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(x["page_number"].cast("int").alias("page"), acc["at"].alias("start"), end.alias("end"))).alias("out"))

    return rows.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("full_text"), F.aggregate("p", zero, step, lambda a: a["out"]).alias("ranges"))


def page_at(ranges: Column, offset: Column) -> Column:
    """The page that holds an offset, the last one beyond the end, null without pages."""
    inside = F.filter(ranges, lambda r: (r["start"] <= offset) & (offset < r["end"]))
    return F.coalesce(F.get(inside, F.lit(0))["page"], F.get(ranges, F.size(ranges) - 1)["page"])


def clauses_of_pages(pages: DataFrame) -> DataFrame:
    """Clauses page by page, and those of the full text that no page has at the same place; (doc_id, page, clause_type,
    text, confidence, start_char, end_char). Pages: (doc_id, page_number, text)."""
    ranges = page_ranges(pages)
    one = F.size("ranges") <= 1
    whole = clauses(ranges, "doc_id", "full_text").join(ranges.select("doc_id", "ranges"), "doc_id")
    single = whole.where(one).select("doc_id", F.lit(1).alias("page"), "clause_type", "text", "confidence", "start_char", "end_char")
    paged = pages.withColumn("key", F.struct("doc_id", "page_number"))
    own = clauses(paged, "key", "text").select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.page_number").alias("page"), "clause_type", "text", "confidence", "start_char", "end_char")
    moved = own.join(ranges.where(F.size("ranges") > 1).select("doc_id", F.explode("ranges").alias("r")), "doc_id").where(F.col("page") == F.col("r.page"))
    by_page = moved.select("doc_id", "page", "clause_type", "text", "confidence", (F.col("start_char") + F.col("r.start")).alias("start_char"), (F.col("end_char") + F.col("r.start")).alias("end_char"))
    rest = whole.where(~one).join(by_page.select("doc_id", "clause_type", "start_char"), ["doc_id", "clause_type", "start_char"], "left_anti")
    rest = rest.select("doc_id", page_at(F.col("ranges"), F.col("start_char")).alias("page"), "clause_type", "text", "confidence", "start_char", "end_char")
    return single.unionByName(by_page).unionByName(rest)


def type_counts(found: DataFrame) -> DataFrame:
    """(clause_type, n)."""
    return found.groupBy("clause_type").agg(F.count("*").alias("n"))


def best_per_type(found: DataFrame, *keys: str) -> DataFrame:
    """The clause of highest confidence for each document and type, the earlier of equal ones."""
    from pyspark.sql import Window

    w = Window.partitionBy(*(keys or ("doc_id",)), "clause_type").orderBy(F.desc("confidence"), "start_char", "seq")
    return found.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
