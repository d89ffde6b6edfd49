"""Analysis by a language model: routing, prompts, calls with retries, parsing of answers, merging of chunks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.operators.chunking import chunks, estimated_tokens

#: Characters of a text that a prompt holds; estimated tokens above which a text goes in chunks; size and overlap of those.
MOST_CHARS, MOST_TOKENS, CHUNK, OVERLAP = 50_000, 100_000, 20_000, 500

ANSWER = (
    "contract_type string, overall_risk string, parties array<struct<name: string, role: string>>, key_dates map<string, string>, "
    "financial_terms array<struct<type: string, amount: string, details: string>>, jurisdiction string, "
    "key_clauses array<struct<type: string, summary: string, risk_level: string>>, "
    "risk_flags array<struct<severity: string, issue: string, recommendation: string>>, plain_summary string"
)

PROMPTS = {
    "Quick": "Give the type of this contract, its overall risk, its parties and a summary in plain words. Answer in JSON.\n\n{document_text}",
    "Standard": "Analyse this contract: type, overall risk, parties, dates, money, jurisdiction, main clauses, risks and a summary in plain words. Answer in JSON.\n\n{document_text}",
    "Deep": "Analyse this contract clause by clause: type, overall risk, parties, dates, money, jurisdiction, every clause with its risk, all risks with advice and a summary in plain words. Answer in JSON.\n\n{document_text}",
}


def routes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, est_tokens, route, prompt_chars): whether a text goes whole, cut to MOST_CHARS, or in chunks."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = estimated_tokens(text)
    return docs.select(F.col(id_col).alias("doc_id"), tokens.alias("est_tokens"), F.when(tokens > MOST_TOKENS, "chunked").when(F.length(text) > MOST_CHARS, "truncated").otherwise("whole").alias("route"), F.least(F.length(text), F.lit(MOST_CHARS)).cast("long").alias("prompt_chars"))


def prompts(docs: DataFrame, depth: str = "Standard", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, prompt): one prompt for each text, or for each chunk of a very long one. An unknown depth is Standard."""
    before, after = PROMPTS.get(depth, PROMPTS["Standard"]).split("{document_text}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    large = estimated_tokens(F.col("text")) > MOST_TOKENS
    whole = rows.where(~large).select("doc_id", F.lit(0).alias("chunk"), F.concat(F.lit(before), F.substring("text", 1, MOST_CHARS), F.lit(after)).alias("prompt"))
    parts = chunks(rows.where(large), CHUNK, OVERLAP)
    n = parts.groupBy("doc_id").agg(F.count("*").alias("n"))
    said = F.concat(F.format_string("This is part %d of %d of a legal document.\n\n", F.col("chunk") + 1, F.col("n")), F.lit(before), F.col("text"), F.lit(after), F.lit("\n\nNote: this is a part of a document; keep to what it holds."))
    return whole.unionByName(parts.join(n, "doc_id").select("doc_id", "chunk", said.alias("prompt")))


def answers(asked: DataFrame, complete: Callable[[str], str], attempts: int = 3, wait: tuple[float, float] = (4.0, 10.0)) -> DataFrame:
    """(doc_id, chunk, response) by a function from prompt to answer, called again after growing pauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(prompt: str) -> str:
            for k in range(attempts):
                try:
                    return complete(prompt)
                except Exception:
                    if k + 1 == attempts:
                        raise
                    time.sleep(min(wait[1], wait[0] * 2**k))
            raise AssertionError

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk"), pa.array([ask(p) for p in batch.column("prompt").to_pylist()], pa.string())], ["doc_id", "chunk", "response"])

    return asked.select("doc_id", "chunk", "prompt").mapInArrow(run, f"doc_id {dict(asked.dtypes)['doc_id']}, chunk int, response string")


def unfenced(response: Column) -> Column:
    """What stands in the first code block, or all of it; a block that isn't closed lacks its last character."""
    body = F.when(F.contains(response, F.lit("```json")), F.regexp_extract(response, r"(?s)```json(.*?)(?:```|.\z|\z)", 1)).when(F.contains(response, F.lit("```")), F.regexp_extract(response, r"(?s)```(.*?)(?:```|.\z|\z)", 1))
    return F.coalesce(F.regexp_replace(body, r"(?U)^\s+|\s+$", ""), response)


def parsed(response: Column) -> Column:
    """The answer as a struct of type ANSWER; one that isn't JSON becomes the summary of an unknown contract."""
    body = unfenced(response)
    whole = F.struct(
        F.lit("Unknown").alias("contract_type"), F.lit("Unknown").alias("overall_risk"), F.array().cast("array<struct<name: string, role: string>>").alias("parties"), F.create_map().cast("map<string, string>").alias("key_dates"),
        F.array().cast("array<struct<type: string, amount: string, details: string>>").alias("financial_terms"), F.lit("Unable to parse").alias("jurisdiction"), F.array().cast("array<struct<type: string, summary: string, risk_level: string>>").alias("key_clauses"),
        F.array().cast("array<struct<severity: string, issue: string, recommendation: string>>").alias("risk_flags"), F.substring(body, 1, 500).alias("plain_summary"),
    )
    return F.when(F.try_parse_json(body).isNull(), whole).otherwise(F.from_json(body, ANSWER))


def merged(rows: DataFrame) -> DataFrame:
    """One answer for each document from those of its chunks (doc_id, chunk, answer): lists one after another, parties by
    name once, later dates over earlier ones, the first jurisdiction there is; High if any is, Medium if more than half
    are, else Low, and Medium if none says; summaries joined, 1,000 characters at most."""
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.to_json("answer", {"ignoreNullFields": "false"}).alias("j")))).alias("p"))  # the chunks of one document
    a = parts.select("doc_id", F.transform("p", lambda x: F.from_json(x["j"], ANSWER)).alias("a"))
    field = lambda name, empty: F.flatten(F.transform("a", lambda x: F.coalesce(x[name], F.array().cast(empty))))
    party = "array<struct<name: string, role: string>>"
    names = F.aggregate(field("parties", party), F.array().cast(party), lambda acc, x: F.when(F.exists(acc, lambda y: y["name"].eqNullSafe(x["name"])), acc).otherwise(F.array_append(acc, x)))
    dates = F.aggregate("a", F.create_map().cast("map<string, string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: ~F.coalesce(F.map_contains_key(x["key_dates"], k), F.lit(False))), F.coalesce(x["key_dates"], F.create_map().cast("map<string, string>"))))
    risks = F.filter(F.transform("a", lambda x: x["overall_risk"]), lambda r: r.isNotNull() & (r != ""))
    level = F.when(F.size(risks) == 0, "Medium").when(F.array_contains(risks, "High"), "High").when(F.size(F.filter(risks, lambda r: r == "Medium")) > F.floor(F.size(risks) / 2), "Medium").otherwise("Low")
    said = F.filter(F.transform("a", lambda x: x["plain_summary"]), lambda s: s.isNotNull() & (s != ""))
    where = F.get(F.filter(F.transform("a", lambda x: x["jurisdiction"]), lambda s: s.isNotNull() & (s != "")), F.lit(0))
    return a.select(
        "doc_id", F.coalesce(F.get("a", F.lit(0))["contract_type"], F.lit("Unknown")).alias("contract_type"), level.alias("overall_risk"), names.alias("parties"), dates.alias("key_dates"),
        field("financial_terms", "array<struct<type: string, amount: string, details: string>>").alias("financial_terms"), F.coalesce(where, F.lit("")).alias("jurisdiction"),
        field("key_clauses", "array<struct<type: string, summary: string, risk_level: string>>").alias("key_clauses"), field("risk_flags", "array<struct<severity: string, issue: string, recommendation: string>>").alias("risk_flags"),
        F.substring(F.array_join(said, " "), 1, 1000).alias("plain_summary"),
    )
