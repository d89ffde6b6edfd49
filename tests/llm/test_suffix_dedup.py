"""Removal of repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lexframe.llm import suffix_dedup


def brute(rows, t):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)} by looking at every string."""
    first = {}
    for doc, raw in rows:
        for i in range(len(raw) - t + 1):
            s = raw[i : i + t]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - t + 1):
            if first[raw[i : i + t]] < doc:
                gone[i : i + t] = b"\1" * t
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


def made_up(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "and", "ñandú", "ti", "on", "er", "a", "aaaaaaaa", "\n"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(30) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and rows:
            raw = rng.choice(rows)[1]
        elif kind < 0.4 and rows:
            old = rng.choice(rows)[1]
            k = rng.randrange(len(old) + 1)
            raw = old[:k] + rng.choice(["x", "", "yy zz"]) + old[k + rng.randrange(4) :]
        elif kind < 0.7:
            raw = text(rng.randrange(25)) + rng.choice(passages)[rng.randrange(20) :] + text(rng.randrange(25))
        else:
            raw = text(rng.randrange(80))
        rows.append((i * 3 % 101 if n > 101 else i, raw))
    return rows + [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 400), (504, "a" * 120), (505, "x" * 20 + "a" * 90), (506, "ab" * 200), (507, "ba" * 100)]


def found(spark, rows, t=50, parts=3):
    docs = spark.createDataFrame([(i, x, b"1", 1) for i, x in rows], "doc_id long, text string, ids binary, pack long").repartition(parts)
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, threshold=t).collect())


@pytest.mark.parametrize("seed,t", [(1, 50), (2, 50), (3, 24), (5, 100)])
def test_equals_brute_force(spark, seed, t):
    rows = made_up(seed)
    assert found(spark, rows, t) == brute([(i, (x or "").encode()) for i, x in rows], t)


@pytest.mark.parametrize("t", [16, 24, 50, 130])
def test_packs_and_pieces(monkeypatch, t):
    """Small packs, pieces and batches, without Spark: the sorts are done here."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 3000)
    rows, ranges = made_up(4, 90), 3
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([x for _, x in rows])})
    packs = [suffix_dedup.Pack(*(c[0].as_py() for c in batch.columns[:6]), t) for batch in suffix_dedup._pack(iter(table.to_batches()), t)]
    windows = [None] * len(packs)
    assert len(packs) > 3
    for length in suffix_dedup.lengths(t):
        asked = [p.asked(length, w) for p, w in zip(packs, windows, strict=True)]
        verdicts = [{} for _ in packs]
        for k in range(ranges):
            sent = []
            for number, a in enumerate(asked):
                for r, x in a.by_range(ranges):
                    sent += [(*row, number, at) for at, row in enumerate(zip(a.rank[x].view("i8").tolist(), a.other[x].view("i8").tolist(), a.lead[x].tolist(), strict=True))] if r == k else []
            judge, judged = suffix_dedup.Judge(), []
            sent = np.array(sorted(sent), dtype=np.int64).reshape(-1, 5)
            for step in [*np.array_split(sent, 7), None]:
                out, verdict = judge.judge(list(step.T) if step is not None else [np.zeros(0, np.int64)] * 5, step is None)
                judged += zip(out[3].tolist(), out[4].tolist(), verdict.tolist(), strict=True)
            assert len(judged) == len(sent)
            for number, at, v in judged:
                if v:
                    verdicts[number].setdefault(k, []).append((at, suffix_dedup.zlib.compress(bytes([v]))))
        windows = [p.after(a, v, ranges) for p, a, v in zip(packs, asked, verdicts, strict=True)]
    got = []
    for p in packs:
        gone = p.removed()
        for i, at, n in zip(p.ids.tolist(), p.start.tolist(), p.sizes.tolist(), strict=True):
            got.append((i, n, int(gone[at : at + n].sum()), p.bytes[at : at + n][~gone[at : at + n]].tobytes()))
    assert sorted(got) == [(a, b, c, k) for a, b, c, _, k in brute([(i, (x or "").encode()) for i, x in rows], t)]


def test_judge_holds_one_document_only():
    judge = suffix_dedup.Judge()
    rows = [(1, 1, 5), (1, 2, 5), (1, 2, 7), (1, 3, 9), (1, 3, 9), (2, 0, 1), (2, 1, 1), (3, 0, 2), (3, 0, 4)]
    got = []
    for r in rows:
        out, verdict = judge.judge([np.array([x], np.int64) for x in (*r, 0, 0)])
        got += zip(*(c.tolist() for c in out[:3]), verdict.tolist(), strict=True)
        assert len({*judge.held[2].tolist()}) < 2
    out, verdict = judge.judge([np.zeros(0, np.int64)] * 5, True)
    got += zip(*(c.tolist() for c in out[:3]), verdict.tolist(), strict=True)
    want = [2, 2, 1, 2, 2, 0, 0, 2, 1]
    assert got == [(*r, v) for r, v in zip(rows, want, strict=True)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a" * 80), (1, "a" * 80), (1, "a" * 80), (2, "b" + "a" * 60), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()), key=str)
    assert got == [(1, 0, b"a" * 80), (1, 0, b"a" * 80), (2, 60, b"b"), (3, 0, b""), (None, 0, b"a" * 80)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_equal_ids_and_a_long_text(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(300_000))
    rows = [(1, "x" * 20 + long[:200]), (1, "y" * 20 + long[:200]), (2, long), (3, long[1000:2000])]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[1, 220] == (0, 0) and got[3, 1000] == (1000, 1) and got[2, len(long)][0] >= 200 and len(got) == 3


def test_query(spark):
    from lexframe.llm.queries import op10_suffix_dedup

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = [(a, b, c, e, hashlib.sha256(k).hexdigest()) for a, b, c, e, k in brute(rows, 50)]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_dedup(spark, d).collect()) == want
    assert any(c for _, _, c, _, _ in want)


def test_batches_end_by_bytes(spark):
    """Long rows don't reach Python a thousand at a time."""
    from lexframe.llm import kit

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) as text").mapInArrow(sizes, "n long")
    found = [r.n for r in kit.keep(rows, "sizes", suffix_dedup.BATCH_BYTES).collect()]
    assert sum(found) == 60 and max(found) <= 6
