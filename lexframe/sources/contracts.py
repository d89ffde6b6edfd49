"""A corpus of contracts as a projection of orders and customers, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind (P and B lines end with a line end, S lines have one on both sides), condition on k, text with placeholders.
LINES = (
    ("P", "true", 'This Agreement is entered into as of {DATE}, by and between {PA} Inc. ("Client") and {PB} LLC ("Provider").'),
    ("P", "k%10=0", "Signed by Dr. Jane Doe. See Smith v. Jones [2020] UKSC 45 and the Companies Act 2006."),
    ("S", "true", "1. TERMINATION"),
    ("B", "true", "Either party may terminate this Agreement upon {DAYS} days written notice for material breach."),
    ("B", "k%5=0", "The Client may terminate this Agreement at any time without cause."),
    ("B", "k%4=1", "This Agreement shall automatically renew for successive twelve (12) months terms."),
    ("S", "k%3<>0", "2. CONFIDENTIALITY"),
    ("B", "k%3<>0", "Each party shall protect confidential information. The receiving party shall not disclose any trade secret."),
    ("S", "k%2=0", "3. LIMITATION OF LIABILITY"),
    ("B", "k%2=0", "In no event shall either party be liable for consequential damages or indirect damages."),
    ("B", "k%4=0", "The aggregate liability shall not exceed ${AMT}."),
    ("S", "k%7<>0", "4. GOVERNING LAW"),
    ("B", "k%7<>0", "This Agreement shall be governed by the laws of the State of {STATE}, without regard to conflict of law rules."),
    ("S", "k%3=1", "5. INDEMNIFICATION"),
    ("B", "k%6=1", "The Provider shall indemnify and hold harmless the Client from all claims and losses."),
    ("B", "k%6=4", "Each party shall indemnify and hold harmless the other from all claims and losses."),
    ("S", "true", "6. PAYMENT"),
    ("B", "true", "The Client shall pay ${AMT} within net 30 days of invoice, as described in Section 6.{D1}(a)."),
    ("S", "k%6=0", "7. FORCE MAJEURE"),
    ("B", "k%6=0", "Neither party is responsible for any act of God, flood, earthquake, epidemic or terrorism."),
    ("S", "k%9=0", "8. NON-COMPETE"),
    ("B", "k%9=0", "The Provider shall not compete with any competing business of the Client."),
    ("B", "k%18=0", "This applies for a period of two (2) years within a 50 mile radius."),
    ("S", "k%5=1", "9. INTELLECTUAL PROPERTY"),
    ("B", "k%5=1", "The Provider hereby assigns copyright, patent and trademark ownership to the Client."),
    ("S", "k%4=2", "10. DISPUTE RESOLUTION"),
    ("B", "k%4=2", "Any dispute shall be settled by binding arbitration before one arbitrator in good faith."),
    ("S", "k%8<4", "11. NOTICE"),
    ("B", "k%8<4", "Every notice shall be sent to the address above by certified mail."),
    ("S", "k%2=1", "12. SEVERABILITY"),
    ("B", "k%2=1", "If any provision is invalid or unenforceable, the remaining provisions shall remain in full force."),
    ("S", "k%11=0", "13. EFFORTS"),
    ("B", "k%11=0", "The Provider shall use reasonable efforts and best efforts to respond as soon as practicable."),
)
_PARTIES, _STATES = ("Alpha", "Beta", "Gamma", "Delta", "Omega"), ("Delaware", "California", "Texas")


def _text_sql(values: dict[str, str], newline: str, form_feed: str | None) -> str:
    """One concatenation that either engine can read."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for kind, when, line in LINES:
        pieces, rest = ([form_feed if form_feed and line == "6. PAYMENT" else newline] if kind == "S" else []), line
        while rest:
            at = rest.find("{")
            if at < 0:
                pieces.append(quoted(rest))
                break
            if at:
                pieces.append(quoted(rest[:at]))
            end = rest.index("}")
            pieces.append(values[rest[at + 1 : end]])
            rest = rest[end + 1 :]
        body = f"concat({', '.join([*pieces, newline])})"
        parts.append(body if when == "true" else f"case when {when} then {body} else '' end")
    return f"concat({', '.join(parts)})"


def dealt(rows: DataFrame, key: str, split: int = 32 << 20) -> DataFrame:
    """The rows over all cores where the input is smaller than a split for each core; larger inputs are many splits
    already and are not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores, key) if size < cores * split else rows


def contracts(spark: SparkSession, sf_dir: str, shift: int = 0, paged: bool = False) -> DataFrame:
    """(doc_id, text): a contract for each order; `paged` puts a form feed before the sixth heading."""
    arr = lambda xs, i: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(1 + {i} as int))"
    values = {
        "DATE": "date_format(o_orderdate, 'MMMM d, yyyy')",
        "AMT": "format_number(cast(floor(o_totalprice) as bigint), 0)",
        "PA": arr(_PARTIES, "c_custkey % 5"),
        "PB": arr(_PARTIES, "(c_custkey + 1 + k % 4) % 5"),
        "STATE": arr(_STATES, "k % 3"),
        "DAYS": "cast(30 * (1 + k % 3) as string)",
        "D1": "cast(1 + k % 4 as string)",
    }
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    orders = dealt(orders, "o_orderkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("k", F.col("o_orderkey") + shift)
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.expr(_text_sql(values, "'\\n'", "chr(12)" if paged else None)).alias("text"))


def contracts_sql(shift: int = 0, paged: bool = False) -> str:
    """The same as a query for DuckDB."""
    arr = lambda xs, i: f"([{', '.join(repr(x) for x in xs)}])[1 + {i}]"
    values = {
        "DATE": "strftime(o_orderdate, '%B %-d, %Y')",
        "AMT": "format('{:,}', cast(floor(o_totalprice) as bigint))",
        "PA": arr(_PARTIES, "c_custkey % 5"),
        "PB": arr(_PARTIES, "(c_custkey + 1 + k % 4) % 5"),
        "STATE": arr(_STATES, "k % 3"),
        "DAYS": "cast(30 * (1 + k % 3) as varchar)",
        "D1": "cast(1 + k % 4 as varchar)",
    }
    return f"select o_orderkey as doc_id, {_text_sql(values, 'chr(10)', 'chr(12)' if paged else None)} as text from (select *, o_orderkey + {shift} as k from orders join customer on o_custkey = c_custkey)"
