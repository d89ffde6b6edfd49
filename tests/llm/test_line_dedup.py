"""Line chunks against a plain version."""

import random

from lexframe.llm import line_dedup


def brute(rows):
    owner, out = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").encode().split(b"\n")
        kept, lost = [], 0
        for k, (a, b) in enumerate(line_dedup.cut(lines)):
            body = b"\n".join(lines[a:b])
            if b - a > 1 and owner.setdefault(body, (i, k)) != (i, k):
                lost += 1
            else:
                kept += lines[a:b]
        out.append((i, text if not lost else b"\n".join(kept).decode(), lost))
    return out


def test_equals_plain(spark):
    rng = random.Random(1)
    lines = [f"line {k} é" for k in range(12)]
    shared = [rng.choice(lines) for _ in range(40)]
    rows = [(i, "\n".join([rng.choice(lines) + str(rng.randrange(40)) for _ in range(rng.randrange(8))] + (shared[rng.randrange(9) :] if rng.random() < 0.6 else []))) for i in range(60)]
    rows += [(90, None), (91, ""), (92, "same\n" * 300), (93, "same\n" * 300), (94, "\n\n\n")]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, body binary").repartition(3)
    got = sorted((r.doc_id, r.text, r.n_removed_chunks) for r in line_dedup.dedup_lines(docs).collect())
    assert got == brute(rows) and sum(n for *_, n in got) > 20


def test_boundaries_resist_shifts():
    rng = random.Random(2)
    lines = [str(rng.random()).encode() for _ in range(400)]
    bodies = lambda ls: {b"\n".join(ls[a:b]) for a, b in line_dedup.cut(ls)}
    moved = [b"new line", *lines[:200], b"another", *lines[200:]]
    assert len(bodies(lines) - bodies(moved)) <= 6
    assert [b for _, b in line_dedup.cut(lines)][-1] == 400


def test_equal_ids_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf\ng\nh"), (1, "a\nb\nc\nd\ne\nf\ng\nh"), (None, "a\nb\nc\nd\ne\nf\ng\nh")], "doc_id long, text string")
    assert [r.n_removed_chunks for r in line_dedup.dedup_lines(docs).collect()] == [0, 0, 0]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def runs_by_hand(rows):
    """Lines left and, for each document, the places of lines in runs that occur earlier."""
    first, out = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines, lost = (text or "").split("\n"), set()
        for at, pair in enumerate(zip(lines, lines[1:], strict=False)):
            doc, place = first.setdefault(pair, (i, at))
            if doc < i or at >= place + 2:
                lost |= {at, at + 1}
        out.append((i, text if not lost else "\n".join(x for k, x in enumerate(lines) if k not in lost), len(lost)))
    return out


def test_whole_runs_go(spark):
    rng = random.Random(5)
    own = lambda i, n: [f"{i} {k} {rng.random()}" for k in range(n)]
    passages = [own("passage", n) for n in (2, 3, 4, 7, 20)]
    rows = [(i, "\n".join(own(i, 3) + p + own(i, 2) + q + own(i, 4))) for i, (p, q) in enumerate((p, q) for p in passages for q in passages)]
    rows += [(90, None), (91, ""), (92, "same\n" * 300), (93, "same\n" * 300), (94, "\n\n\n"), (95, rows[3][1])]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, body binary").repartition(3)
    got = sorted((r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.dedup_runs(docs).collect())
    assert got == runs_by_hand(rows)
    for p in passages:  # each stands in one document only
        assert sum("\n".join(p[:2]) in (t or "") for _, t, _ in got) == 1
    assert {i: t for i, t, _ in got}[95] == ""
    left = {x for _, t, _ in got for x in (t or "").split("\n")}
    assert left >= {x for _, t in rows for x in (t or "").split("\n")}
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string")
    assert [r.n_removed_lines for r in line_dedup.dedup_runs(twice).collect()] == [0, 0, 0]
    assert line_dedup.dedup_runs(docs.limit(0)).count() == 0
