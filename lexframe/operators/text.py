"""Readability, terms and bag-of-words comparison."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexframe.functions import lexicon as lx
from lexframe.functions.textcols import clean, sentences, syllables, terms, tokens


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def composed(c: Column) -> Column:
    """Canonical composition. Spark has no function for it; an Arrow function is the only one here."""
    return _nfc(c)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text): composed and cleaned; null is empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), composed(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return rows.select("doc_id", clean(F.col("text"), **options).alias("text"))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, n, first_pos)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(terms(F.col(text_col))).alias("pos", "term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def top_terms(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k most frequent terms of each document, the earlier of equal ones first: (doc_id, rank, term, n)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")
    return term_counts(docs, id_col, text_col).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("doc_id", "rank", "term", "n")


def readability(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics of each document, all zero without words. One pass over rows: words are aggregated inside the row, so
    nothing is shuffled."""
    rows = cleaned(docs, id_col, text_col).select("doc_id", tokens(F.col("text")).alias("w"), F.size(sentences(F.col("text"))).alias("sentences"))
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("syllables"), F.lit(0).alias("complex"), F.lit(0).alias("jargon"))
    rows = rows.select("doc_id", "w", "sentences", F.transform("w", _facts).alias("facts"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["chars"] + x["chars"]).alias("chars"), (acc["syllables"] + x["syllables"]).alias("syllables"), (acc["complex"] + (x["syllables"] >= 3).cast("int")).alias("complex"), (acc["jargon"] + x["jargon"]).alias("jargon"))

    rows = rows.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("unique_words"), "sentences", F.aggregate("facts", zero, add).alias("t"))
    has = (F.col("words") > 0) & (F.col("sentences") > 0)
    words, per = F.col("words").cast("double"), lambda c: F.when(has, c).otherwise(F.lit(0.0))
    chars, syl, sent = F.col("t.chars"), F.col("t.syllables"), F.col("sentences")
    return rows.select(
        "doc_id",
        F.when(has, F.col("words")).otherwise(0).cast("long").alias("word_count"),
        F.when(has, sent).otherwise(0).cast("long").alias("sentence_count"),
        per(0.39 * words / sent + 11.8 * syl / words - 15.59).alias("flesch_kincaid_grade"),
        per(0.0588 * (chars / words * 100) - 0.296 * (sent / words * 100) - 15.8).alias("coleman_liau_index"),
        per(4.71 * chars / words + 0.5 * words / sent - 21.43).alias("ari"),
        per(words / sent).alias("avg_sentence_length"),
        per(chars / words).alias("avg_word_length"),
        per(syl / words).alias("avg_syllables_per_word"),
        per(F.col("t.jargon") / words).alias("jargon_density"),
        per(F.col("t.complex") / words).alias("complex_word_ratio"),
        per(F.col("unique_words") / words).alias("vocabulary_richness"),
    )


def _facts(w: Column) -> Column:
    return F.struct(F.length(w).alias("chars"), syllables(w).alias("syllables"), w.isin(*lx.JARGON).cast("int").alias("jargon"))


def grade_label(grade: Column) -> Column:
    """What a grade of 20, 16, 13, 10 or 7 and more, or less than that, is called."""
    # Fixed values.
    out = F.when(grade >= 20, "Extremely complex (post-graduate level)")
    for least, name in ((16, "Very complex (graduate level)"), (13, "Complex (college level)"), (10, "Moderately complex (high school)"), (7, "Moderate (middle school)")):
        out = out.when(grade >= least, name)
    return out.otherwise("Accessible (elementary)")


def compare_bags(pairs: DataFrame, pair_id: str = "pair_id", a: str = "text_a", b: str = "text_b") -> DataFrame:
    """(pair_id, cosine_similarity, jaccard_similarity, n_shared, n_only_a, n_only_b, length_ratio, shared, only_a,
    only_b) of the terms of two texts, all zero or empty if either has none; lists hold at most 50 terms, shared ones by
    their total and then the term. One shuffle by pair and term, one by pair."""
    sides = [pairs.select(F.col(pair_id).alias("pair_id"), F.lit(s).alias("side"), F.explode(terms(F.col(c))).alias("term")) for s, c in (("a", a), ("b", b))]
    both = sides[0].unionByName(sides[1]).groupBy("pair_id", "term").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    weight = lambda n: F.when(n > 0, 1 + F.log(n)).otherwise(0.0)
    wa, wb = weight(F.col("na")), weight(F.col("nb"))
    shared, only_a, only_b = (F.col("na") > 0) & (F.col("nb") > 0), F.col("nb") == 0, F.col("na") == 0
    agg = both.groupBy("pair_id").agg(
        F.sum(wa * wb).alias("dot"), F.sum(wa * wa).alias("aa"), F.sum(wb * wb).alias("bb"), F.sum("na").alias("sa"), F.sum("nb").alias("sb"), F.count("*").alias("n"),
        F.count_if(shared).alias("n_shared"), F.count_if(only_a).alias("n_only_a"), F.count_if(only_b).alias("n_only_b"),
        F.collect_list(F.when(shared, F.struct((-F.col("na") - F.col("nb")).alias("total"), F.col("term").alias("term")))).alias("shared"),
        F.collect_list(F.when(only_a, F.col("term"))).alias("only_a"), F.collect_list(F.when(only_b, F.col("term"))).alias("only_b"),
    )  # fmt: skip  # lists hold the terms of one pair
    has = (F.col("sa") > 0) & (F.col("sb") > 0)
    zero = lambda c: F.when(has, c).otherwise(0.0)
    count = lambda c: F.when(has, F.col(c)).otherwise(0)
    none = F.array().cast("array<string>")
    rows = agg.select(
        "pair_id", zero(F.col("dot") / (F.sqrt("aa") * F.sqrt("bb"))).alias("cosine_similarity"), zero(F.col("n_shared") / F.col("n")).alias("jaccard_similarity"),
        count("n_shared").alias("n_shared"), count("n_only_a").alias("n_only_a"), count("n_only_b").alias("n_only_b"), zero(F.least("sa", "sb") / F.greatest("sa", "sb")).alias("length_ratio"),
        F.when(has, F.transform(F.slice(F.array_sort("shared"), 1, 50), lambda x: x["term"])).otherwise(none).alias("shared"),
        F.when(has, F.slice(F.array_sort("only_a"), 1, 50)).otherwise(none).alias("only_a"), F.when(has, F.slice(F.array_sort("only_b"), 1, 50)).otherwise(none).alias("only_b"),
    )
    left = pairs.select(F.col(pair_id).alias("pair_id")).join(rows, "pair_id", "left")
    return left.select("pair_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("cosine_similarity", "jaccard_similarity", "length_ratio")], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_shared", "n_only_a", "n_only_b")], *[F.coalesce(c, none).alias(c) for c in ("shared", "only_a", "only_b")])
