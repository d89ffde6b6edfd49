"""Risk rules over contracts and their clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexframe.functions import lexicon as lx
from lexframe.functions.textcols import any_of, hits, title
from lexframe.operators.clauses import clause_array

SEVERITY = {"high": 0, "medium": 1, "low": 2, "info": 3}


_RISK = "struct<rule_ord: int, severity: int, level: string, category: string, description: string, suggestion: string, clause_seq: int, part: int>"


def _row(rule: int, level: str, category: str, description: Column | str, suggestion: Column | str, seq: Column | None = None, part: int = 0) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(rule).alias("rule_ord"), F.lit(SEVERITY[level]).alias("severity"), F.lit(level).alias("level"), F.lit(category).alias("category"), text(description).alias("description"), text(suggestion).alias("suggestion"), (F.lit(None) if seq is None else seq).cast("int").alias("clause_seq"), F.lit(part).alias("part")).cast(_RISK)


# Fixed values: (rule, level, clause type, words that limit it, category, description, suggestion).
CLAUSE_RULES = (
    (3, "high", "liability", lx.LIABILITY_CAPS, "unlimited_liability", "Liability clause found but no cap or limit is specified.", "Add a specific liability cap (e.g., 'not to exceed the total fees paid')."),
    (4, "medium", "indemnification", lx.MUTUAL, "one_sided_indemnity", "Indemnification appears to be one-sided rather than mutual.", "Consider negotiating mutual indemnification provisions."),
    (8, "high", "non_compete", lx.NON_COMPETE_LIMITS, "broad_non_compete", "Non-compete clause may lack geographic or temporal boundaries.", "Ensure non-compete has reasonable geographic scope and time limitation."),
)


def risks_from(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rule_ord, severity, level, category, description, suggestion, clause_seq, part) of nine rules over the
    clauses and texts.

    Clauses and texts are read once each: the types of a document and its clauses that break a rule become arrays in one
    aggregation, and all rules are array expressions over the row of the document. No text is shuffled.
    """
    own = found.select("doc_id", "clause_type", "seq", _broken(F.col("clause_type"), F.col("text")).alias("rule")).groupBy("doc_id").agg(F.collect_set("clause_type").alias("types"), F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("rule", "seq"))).alias("broken"))  # the clauses of one document
    flags = docs.select(F.col(id_col).alias("doc_id"), *_flags(F.lower(F.coalesce(F.col(text_col), F.lit("")))))
    rows = flags.join(own, "doc_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    return rows.select("doc_id", F.explode(_every()).alias("r")).select("doc_id", "r.*")


def with_risks(rows: DataFrame) -> DataFrame:
    """Rows with columns doc_id, text and clauses (of `clause_array`), and `risks`: what `risks_from` gives, as an array in
    the order of `ordered`. Nothing is shuffled."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.withColumn("__lower", F.lower(F.coalesce("text", F.lit(""))))
    broken = F.filter(F.transform("clauses", lambda c: F.struct(_broken(c["clause_type"], c["text"]).alias("rule"), c["seq"].alias("seq"))), lambda x: x["rule"].isNotNull())
    rows = rows.select(*kept, *_flags(F.col("__lower")), F.transform("clauses", lambda c: c["clause_type"]).alias("types"), broken.alias("broken"))
    keyed = F.transform(_every(), lambda r: F.struct(r["severity"].alias("severity"), r["rule_ord"].alias("rule_ord"), F.coalesce(r["clause_seq"], F.lit(-1)).alias("at"), r["part"].alias("part"), r.alias("r")))
    return rows.select(*kept, F.transform(F.array_sort(keyed), lambda x: x["r"]).alias("risks"))


def _broken(kind: Column, text: Column) -> Column:
    """The number of the rule that a clause breaks, if any."""
    return F.coalesce(*[F.when((kind == own) & ~any_of(F.lower(text), limits), rule) for rule, _, own, limits, *_ in CLAUSE_RULES])


def _flags(lower: Column) -> list[Column]:
    return [
        F.rlike(lower, F.lit("(?U)" + "|".join(lx.AUTO_RENEWAL))).alias("renews"),
        F.rlike(lower, F.lit("(?U)" + lx.UNILATERAL)).alias("unilateral"),
        (any_of(lower, lx.BROAD_IP) & ~any_of(lower, lx.IP_LIMITS)).alias("broad_ip"),
        hits(lower, lx.AMBIGUOUS).alias("vague"),
    ]


def _every() -> Column:
    """All risks of a row of flags, types of clauses and broken rules, as an array."""
    single = []
    # Levels, categories, descriptions and suggestions.
    for rule, level, names, before, after, advised in ((1, "high", lx.ESSENTIAL, "Missing essential clause: ", ". This clause is typically required in commercial contracts.", "Add a {} clause to the agreement."), (2, "low", lx.RECOMMENDED, "Missing recommended clause: ", ".", "Consider adding a {} clause.")):
        for part, name in enumerate(names):
            described = F.concat(F.lit(before), title(F.lit(name)), F.lit(after))
            single.append(F.when(~F.array_contains("types", name), _row(rule, level, "missing_clause", described, advised.format(name.replace("_", " ")), part=part)))
    single += [
        F.when(F.col("renews"), _row(5, "medium", "auto_renewal", "Contract contains automatic renewal provisions.", "Ensure adequate notice period for non-renewal and clear opt-out mechanism.")),
        F.when(F.col("unilateral"), _row(6, "medium", "unilateral_termination", "One party may terminate without cause or for convenience.", "Ensure termination for convenience is mutual or negotiate adequate notice period.")),
        F.when(F.col("broad_ip"), _row(7, "high", "broad_ip_assignment", "Broad IP assignment without clear scope limitation.", "Limit IP assignment to work product created specifically under this agreement.")),
        F.when(F.col("vague") >= 2, _row(9, "low", "ambiguous_language", F.concat(F.lit("Document contains "), F.col("vague").cast("string"), F.lit(" potentially ambiguous phrases (e.g., 'reasonable efforts', 'best efforts').")), "Consider defining ambiguous terms or replacing with specific criteria.")),
    ]

    def clause_row(x: Column) -> Column:
        out = None
        for rule, level, _, _, category, description, suggestion in CLAUSE_RULES:
            row = _row(rule, level, category, description, suggestion, x["seq"])
            out = F.when(x["rule"] == rule, row) if out is None else out.when(x["rule"] == rule, row)
        return out

    return F.concat(F.array_compact(F.array(*single)), F.coalesce(F.transform("broken", clause_row), F.array().cast(f"array<{_RISK}>")))


def risky(annotated_rows: DataFrame) -> DataFrame:
    """The clauses whose risk is high or medium, of `annotated` ones."""
    return annotated_rows.where(F.col("risk_level").isin("high", "medium"))


def risks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The risks of the documents by their own clauses, each found in its row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), clause_array(F.col(text_col)).alias("clauses"))
    # Not the explode of the column: of that Spark infers a filter, for which clauses and risks would be found a second time.
    return with_risks(rows).select("doc_id", F.explode(F.transform("risks", lambda r: r)).alias("r")).select("doc_id", "r.*")


def ordered(found: DataFrame) -> DataFrame:
    """With column `ord`: 0, 1, ... by severity, then rule, then place in the document or list."""
    w = Window.partitionBy("doc_id").orderBy("severity", "rule_ord", F.coalesce("clause_seq", F.lit(-1)), "part")
    return found.withColumn("ord", F.row_number().over(w) - 1)


def annotated(clause_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Clauses with risk_level and risk_reason of the last risk in order that names them; info and null without one."""
    last = ordered(found).where("clause_seq is not null").groupBy("doc_id", F.col("clause_seq").alias("seq")).agg(F.max_by(F.struct("level", "description"), "ord").alias("r"))
    return clause_rows.join(last, ["doc_id", "seq"], "left").select(*[c for c in clause_rows.columns], F.coalesce("r.level", F.lit("info")).alias("risk_level"), F.col("r.description").alias("risk_reason"))


def scores(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_risks, risk_score): the mean weight of the risks, 0 without any. Weights are added as whole thousandths,
    so that the order of a sum decides nothing: a mean of just 0.7 is not above 0.7."""
    weight = F.create_map(*[F.lit(x) for k, v in lx.RISK_WEIGHTS.items() for x in (k, round(v * 1000))])
    own = found.groupBy("doc_id").agg(F.count("*").alias("n_risks"), (F.sum(weight[F.col("level")]) / (F.count("*") * 1000)).alias("mean"))
    return docs.select(F.col(id_col).alias("doc_id")).join(own, "doc_id", "left").select("doc_id", F.coalesce("n_risks", F.lit(0)).cast("long").alias("n_risks"), F.coalesce("mean", F.lit(0.0)).alias("risk_score"))


def score_of(levels: Column) -> Column:
    """The score of `scores` for an array of levels."""
    weight = F.create_map(*[F.lit(x) for k, v in lx.RISK_WEIGHTS.items() for x in (k, round(v * 1000))])
    total = F.aggregate(levels, F.lit(0), lambda acc, x: acc + weight[x])
    return F.when(F.size(levels) > 0, total / (F.size(levels) * 1000)).otherwise(0.0)


def band(score: Column) -> Column:
    """red above 0.7, yellow above 0.3, else green."""
    return F.when(score > 0.7, "red").when(score > 0.3, "yellow").otherwise("green")
