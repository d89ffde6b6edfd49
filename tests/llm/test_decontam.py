"""Decontamination: exact and changed passages are found, others not."""

import random

from lexframe.llm import decontam


def test_cases(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(30)]
    changed = [w if k % 9 else "other" for k, w in enumerate(item)]
    gap = item[:12] + ["extra", "words"] + item[12:]
    pad = lambda xs: " ".join([word() for _ in range(40)] + xs + [word() for _ in range(40)])
    docs = [(1, pad(item)), (2, pad(changed).upper()), (3, pad(gap)), (4, pad([])), (5, pad(item[:5])), (6, None), (7, ""), (8, ", ".join(item)), (1, None), (None, pad(item))]
    tests = [(100, " ".join(item)), (101, "too short"), (102, None), (103, ""), (None, "x"), (100, " ".join(item))]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(i, t, 1) for i, t in tests], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.item_id, r.coverage) for r in decontam.contaminated(frame, items).collect()}
    assert set(got) == {1, 2, 3, 8}
    assert got[1] == got[3] == got[8] == (100, 1.0) and 0.8 < got[2][1] < 1
    assert decontam.contaminated(frame.limit(0), items).count() == 0
    assert decontam.contaminated(frame, items.limit(0)).count() == 0


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(decontam.contaminated(docs, items).collect())
    monkeypatch.setattr(decontam, "SEND_ROWS", 0)
    assert sorted(decontam.contaminated(docs, items).collect()) == one and one


def test_short_items_are_found_whole(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(k))) for k in range(1, 12)]
    docs = [(100 + k, f"some text before, {t.upper()}! and after") for k, t in items] + [(200 + k, "before " + " ".join(t.split()[:-1]) + " and after") for k, t in items if 1 < k < 7]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100 + k, k) for k, _ in items} and all(r.coverage == 1 for r in got)


def test_masks_meet_regular_changes():
    """By enumeration: each third to ninth token replaced, from any place, leaves a hit of some mask in 18 tokens."""
    for every in range(3, 10):
        for first in range(every):
            same = [k % every != first for k in range(18)]
            assert any(all(same[p + i] for i, x in enumerate(m) if x == "1") for m in decontam.MASKS for p in range(18 - len(m) + 1)), (every, first)


def test_equal_ids_and_a_long_text(spark):
    item = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "nothing here"), (1, item), (2, "pad words " * 100_000 + item)], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.matched) for r in got) == [(1, 20), (2, 20)]
