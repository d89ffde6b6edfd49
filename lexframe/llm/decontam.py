"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Fixed masks over windows of `len(mask)` tokens ignore the positions marked 0, so a replaced token spoils only the seeds
in which it is looked at. Test and training seeds are hashed and joined; each hit fixes a diagonal (training position
minus test position), along which all tokens of the item are then compared. The tokens of an item that are matched on
any of its diagonals, over all its tokens, are its coverage in the document.

The masks are chosen by enumeration: one of them has a hit on every copy of an item of 18 tokens or more in which each
third, fourth or fifth token and so on is replaced, wherever that begins. An item too short for every mask is searched
for as a whole, by the hash of all its tokens.

Defined cases: a null or empty text has no tokens; an item without tokens is not searched for;
repeated rows count once; ids that are null are left out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexframe.llm.kit import keep

#: Masks of seven to nine tokens that look at five to eight.
MASKS = ("111011011", "110110111", "101110111", "111101111", "11011011", "1110111")
#: Rows of hashed test seeds (16 bytes each) up to which they are sent to every executor; beyond, both sides are shuffled.
SEND_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(df: DataFrame, masks: tuple[str, ...], whole: tuple[int, ...], only_whole: bool, *ids: str) -> DataFrame:
    """(ids, pos, seed) for each mask at each position of column `tok`, and for runs of as many tokens as `whole` lists;
    with `only_whole` such a run must be all there is."""
    every = [*masks, *("1" * n for n in whole)]
    span, n = max(map(len, every)), F.size("tok")
    shifted = [F.col("tok")] + [F.slice("tok", i + 1, F.greatest(n - i, F.lit(0))) for i in range(1, span)]
    rows = df.where(n >= min(map(len, every))).select(*ids, n.alias("n"), F.posexplode(F.arrays_zip(*[x.alias(f"t{i}") for i, x in enumerate(shifted)])).alias("pos", "w"))

    def seed(m: str, k: int) -> Column:
        there = F.col("w")[f"t{len(m) - 1}"].isNotNull()
        if k >= len(masks) and only_whole:
            there &= F.col("n") == len(m)
        return F.when(there, F.xxhash64(F.lit(k if k < len(masks) else -len(m)), *[F.col("w")[f"t{i}"] for i, x in enumerate(m) if x == "1"]))

    return rows.select(*ids, "pos", F.explode(F.array(*[seed(m, k) for k, m in enumerate(every)])).alias("seed")).where(F.col("seed").isNotNull())


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, matched, n_tokens, coverage) of each document that holds at least `least` of an item's tokens.

    The seeds of the documents never leave their tasks unless they hit: the test seeds are broadcast while they number
    at most SEND_ROWS (checked by a count), and are joined by a shuffle beyond that.
    """
    test = items.select(F.col(item_id).cast("long").alias("item_id"), tokens(F.col(item_text)).alias("tok")).where("item_id is not null").distinct()
    size = F.size("tok")
    whole = tuple(sorted(r[0] for r in test.where((size > 0) & (size < min(map(len, masks)))).select(size).distinct().collect()))  # fewer than a mask has tokens
    seeds = _seeds(test, masks, whole, True, "item_id").select("item_id", F.col("pos").alias("item_pos"), "seed").distinct()
    if seeds.count() <= SEND_ROWS:
        seeds = F.broadcast(seeds)
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    hits = _seeds(train.select("doc_id", tokens(F.col("text")).alias("tok")), masks, whole, False, "doc_id").join(seeds, "seed").groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.count("*").alias("n_seeds"))
    hits = keep(hits, "decontam-hits")  # a few rows, used twice

    asked = hits.join(test.withColumnRenamed("tok", "item_tok"), "item_id")
    here = train.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("tok"))
    # Item position j meets document position diagonal + j; get() is null outside the document.
    same = F.filter(F.sequence(F.lit(0), F.size("item_tok") - 1), lambda j: F.get("tok", F.col("diagonal") + j) == F.get("item_tok", j))
    found = here.join(asked, "doc_id").select("doc_id", "item_id", F.size("item_tok").alias("n_tokens"), F.explode(same).alias("j"))
    # Rows here are bounded by hits times item length; distinct positions are counted after a partial aggregation.
    out = found.distinct().groupBy("doc_id", "item_id", "n_tokens").agg(F.count("j").alias("matched"))
    return out.select("doc_id", "item_id", "matched", F.col("n_tokens").cast("long").alias("n_tokens"), F.round(F.col("matched") / F.col("n_tokens"), 6).alias("coverage")).where(F.col("matched") >= F.lit(least) * F.col("n_tokens"))
