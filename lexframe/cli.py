"""Command line: analyse, extract and summarise files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexframe.operators import entities, report, risks, summaries
from lexframe.operators.clauses import clauses_of_pages
from lexframe.sources.files import full_texts, read_documents


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexframe")
    verbs = parser.add_subparsers(dest="verb", required=True)
    analyse = verbs.add_parser("analyze", help="clauses, entities and risks")
    analyse.add_argument("path")
    analyse.add_argument("-o", "--output", choices=("text", "json"), default="text")
    analyse.add_argument("-s", "--save", help="folder for the JSON lines")
    extract = verbs.add_parser("extract", help="clauses of some types")
    extract.add_argument("path")
    extract.add_argument("-t", "--types", default="")
    short = verbs.add_parser("summarize", help="an extractive summary")
    short.add_argument("path")
    short.add_argument("-n", "--sentences", type=int, default=5)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("lexframe").getOrCreate()
    pages = read_documents(spark, args.path)
    names = pages.select("doc_id", "filename").distinct()
    docs = full_texts(pages)
    if args.verb == "summarize":
        for r in summaries.summaries(docs, args.sentences).join(names, "doc_id").toLocalIterator():
            print(f"{r.filename}\n{r.summary}\n")
        return 0
    found = clauses_of_pages(pages).withColumn("seq", F.col("start_char"))
    if args.verb == "extract":
        types = {t.strip().lower() for t in args.types.split(",") if t.strip()}
        for r in found.join(names, "doc_id").orderBy("filename", "start_char").toLocalIterator():
            if not types or r.clause_type in types:
                print(json.dumps({"file": r.filename, "type": r.clause_type, "page": r.page, "confidence": round(r.confidence, 3), "text": r.text}, ensure_ascii=False))
        return 0
    rows = report.results(docs.join(names, "doc_id"), found, entities.entities(docs), risks.risks_from(found, docs), pages, "filename")
    out = report.as_json(rows) if args.output == "json" else report.report(rows)
    if args.save:
        report.as_json(rows).select("json").write.mode("overwrite").text(args.save)
    for r in out.toLocalIterator():
        print(r[1])
    return 0
