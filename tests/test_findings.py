"""What a review found: each test failed before its finding was settled."""

import re

import duckdb
import pytest

from lexframe.functions import lexicon as lx
from lexframe.functions import textcols as tc
from lexframe.operators import clauses, entities, report, risks, summaries
from lexframe.plans.registry import ORACLE_SQL, QUERIES, html_text


@pytest.mark.parametrize("levels, mean, band", [(["high"] * 5 + ["low"] * 3, 0.7, "yellow"), (["high"] * 3 + ["medium"] * 2 + ["low"], 0.7, "yellow"), (["high"] * 2, 1.0, "red"), ([], 0.0, "green")])
def test_bands_of_exact_means(spark, levels, mean, band):
    """Bands don't depend on the order in which the weights of a document are added."""
    docs = spark.createDataFrame([(1,)], "doc_id long")
    for some in (levels, levels[::-1]):
        found = spark.createDataFrame([(1, x) for x in some], "doc_id long, level string").coalesce(1)
        row = risks.scores(docs, found).select("n_risks", "risk_score", risks.band(risks.F.col("risk_score")).alias("band")).first()
        assert tuple(row) == (len(levels), mean, band)


def test_html_entities_cut_off(spark, tmp_path):
    """An entity without its semicolon stays, as in the SQL."""
    pages = ["<h1>a &amp</h1><p>b &amp; c &amp;amp; d &amp;lt; e &lt</p>", "x &amp;amp y &copy z &copy;", "&&amp;&amp;copy;", "<p>R&D &amp&quot; &ampx; &notit;</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {tuple(r) for r in html_text(spark, str(tmp_path)).collect()} == set(con.execute(ORACLE_SQL["html_text"]).fetchall())


def test_entities_stay_in_their_rows(spark):
    """Matches are told apart within the row of the document: neither a window nor a shuffle."""
    docs = spark.range(3).selectExpr("id as doc_id", "concat('On May ', id, ', 2020 and May 1, 2020. Section 1.2, Section 1.2') as text")
    plan = entities.entities(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert [r.text for r in entities.entities(docs).where("doc_id = 1").orderBy("type_ord").collect()] == ["May 1, 2020", "Section 1.2"]


@pytest.mark.parametrize("text", ["Due 5 days, ſection 4 and Section 4. He ſhall pay all the costs in full.", "é Article 2; 3 (three) months, thirty (30) days", "a\1b\2 Section 7 \1within 12 weeks", 'Made between Acme\n Ltd ("Buyer") and Übel Corp ("the Seller"). USD 5', "", None])
def test_spans_in_one_pass(spark, text):
    """One pass of a pattern gives what Python's does, control characters and other alphabets included."""
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for kind in ("reference", "party", "money", "duration", "obligation", "date"):
        for p in lx.ENTITY_PATTERNS[kind]:
            groups = {"party": 2, "duration": 2, "obligation": 1}.get(kind, 0)
            slow, fast = (docs.select(tc.spans(tc.F.col("text"), tc.jre(b + p.pattern, p.flags), groups).alias("s")).first().s for b in ("", f"(?={p.begin})" if p.begin else ""))
            found = None if text is None else [(m.start(), m.end(), m[0], *[m[k + 1] or "" for k in range(groups)]) for m in re.finditer(p.pattern, text, sum({"i": re.I, "m": re.M}[f] for f in p.flags))]
            assert slow == fast and (found is None or [tuple(x) for x in fast] == found)


def _plan(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, most", [("summary_json", 10), ("diff_summary", 12), ("doc_stats", 10)])
def test_texts_are_analysed_once(spark, name, most):
    """Each use of the contracts reads two tables: no part of a plan is there twice."""
    assert _plan(spark, name).count("Relation [") <= most


def test_counts_collect_no_texts(spark):
    assert "collect_list(struct" not in _plan(spark, "doc_stats")


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "1. TERMINATION\nEither party may terminate this Agreement at any time without cause upon written notice.\n2. LIABILITY\nThe liability of Übel Ltd is limited.\n"), (5, "On May 5, 2020 and 3/4. See Section 4. A breach. The parties shall pay the fees due, in full.")]


@pytest.mark.parametrize("name", ["result_json", "report_text"])
def test_results_stay_in_their_rows(spark, name):
    """Neither windows nor aggregations: what is found in a document stays in its row."""
    assert not re.search("Window|Aggregate", _plan(spark, name))


def test_results_by_row(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    found = clauses.clauses(docs)
    slow = report.results(docs, found, entities.entities(docs), risks.risks_from(found, docs))
    for shape in (report.as_json, report.report, report.summary_json):
        assert sorted(map(tuple, shape(report.results_by_row(docs)).collect())) == sorted(map(tuple, shape(slow).collect()))


def test_strip_as_the_pattern(spark):
    rows = spark.createDataFrame([(x,) for x in ("", " a b　", "\x1ca\x1f", "\n\n", "\x85\xa0é  ", None)], "text string")
    assert all(r.a == r.b for r in rows.select(tc.strip(tc.F.col("text")).alias("a"), tc.F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("b")).collect())


def test_entity_table_stays_in_its_rows(spark):
    assert not re.search("Window|Aggregate", _plan(spark, "entity_table"))
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    fast, slow = report.entity_table_by_row(docs, most=1), report.entity_table(entities.entities(docs), most=1)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_clause_summary_stays_in_its_rows(spark):
    """Summaries within the row are those by tables of terms."""
    assert not re.search("Window|Aggregate", _plan(spark, "clause_summary"))
    docs = spark.createDataFrame([*ODD, (6, "The fees are due now. Any dispute goes to arbitration in Texas. Fees and fees are paid to the Provider. And so on it is here, of the. Breach ends all of it.")], "doc_id long, text string")
    fast, slow = summaries.summaries_by_row(docs, 2), summaries.summaries(docs, 2)
    assert fast.columns == slow.columns and sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


@pytest.mark.parametrize("name", ["entity_delta", "diff_notes"])
def test_versions_meet_once(spark, name):
    """One join of the versions on the document; beside it only the two that make the contracts."""
    plan = _plan(spark, name)
    assert plan.count("Join ") == 3 and not re.search("Window|Aggregate", plan)


@pytest.mark.parametrize("name", ["entities", "doc_stats", "risk_band", "risks"])
def test_nothing_is_found_in_filters(spark, name):
    """What an explode takes is not evaluated again in a filter below it, nor in the join that makes the contracts."""
    assert not [x[:200] for x in _plan(spark, name).splitlines() if re.match(r"[ :+-]*(Filter|Join) .*(transform|aggregate|regexp)", x)]


def test_doc_stats_stay_in_their_rows(spark):
    """Counts within the row are those by tables; a null text has no length."""
    assert not re.search("Window|Aggregate", _plan(spark, "doc_stats"))
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    found = clauses.clauses(docs)
    fast, slow = report.counts_by_row(docs), report.counts(docs, found, entities.entities(docs), risks.risks_from(found, docs))
    assert fast.columns == slow.columns and sorted(map(repr, fast.collect())) == sorted(map(repr, slow.collect()))
