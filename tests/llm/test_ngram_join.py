"""The n-gram Jaccard join against all pairs, and its R-tree against all points."""

import random
import re

import numpy as np
import pytest

from lexframe.llm import ngram_join
from lexframe.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows, n=4):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        out[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    return out


def brute(rows, n=4, percent=85):
    sets = sets_of(rows, n)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def made_up(seed, n=160):
    rng = random.Random(seed)
    pool = [a + b for a in "the of and ti on er ñ".split() for b in "a b c st ou É".split()]
    passage = [rng.choice(pool) for _ in range(40)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [rng.choice(pool)]
        else:
            words = [rng.choice(pool) for _ in range(rng.choice([1, 2, 3, 4, 6, 20, 60, 150]))]
            if rng.random() < 0.3:
                words += passage
        text = " ".join(words)
        rows.append((i, text.upper() if rng.random() < 0.1 and text.isascii() else text))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two")]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, node long").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(docs, **options).collect())


@pytest.mark.parametrize("seed,tile", [(1, None), (2, 5)])
def test_equals_all_pairs(spark, seed, tile, monkeypatch):
    if tile:
        monkeypatch.setattr(ngram_join, "TILE", tile)
        monkeypatch.setattr(ngram_join, "SMALL", 2)
        monkeypatch.setattr(ngram_join, "LEAF", 3)
    rows = made_up(seed)
    assert found(spark, rows) == brute(rows)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.poisson(6, (40, ngram_join.GROUPS))
    points = np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0) for _ in range(12)]).astype(np.int32)
    sizes = points.sum(1).astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    points, sizes = points[order], sizes[order]
    got = {(min(i, j), max(i, j)) for a, b, _ in ngram_join.RTree(points, sizes).pairs(85) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes)) if np.minimum(points[i], points[j]).sum() >= ngram_join.least_overlap(sizes[i], sizes[j], 85) and 85 * sizes[j] <= 100 * sizes[i]}
    assert got == want and len(want) > 500


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = {}
    for a, b in links:
        if a != b:
            one = group.setdefault(a, {a}) | group.setdefault(b, {b})
            for x in one:
                group[x] = one
    assert got == {x: min(g) for x, g in group.items()}


def test_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (None, 2, None)]
    assert ngram_join.classes(docs.limit(0)).count() == 0


def test_query(spark):
    from lexframe.llm.queries import op3_ngram_join

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in op3_ngram_join(spark, d).collect()) == want
    assert any(i != c for i, _, c in want)


def test_counts_round_trip():
    rng = np.random.default_rng(9)
    sets = [np.zeros(0, np.uint64), rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 55, 90_000, dtype=np.uint64) << np.uint64(3), np.arange(70_000, dtype=np.uint64) << np.uint64(8)]
    want = [np.bincount((s & np.uint64(ngram_join.FINE - 1)).astype(int), minlength=ngram_join.FINE) for s in sets]
    for some in (sets[:2], sets[:3], sets):
        got = ngram_join.unpacked([ngram_join.packed(s) for s in some])
        assert (got == np.array(want[: len(some)])).all()
    assert ngram_join.unpacked([]).shape == (0, ngram_join.FINE)


def test_forest_spans_and_prefers_earlier_edges():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 3), (40, 60), (200, 2_000)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        up, want = list(range(n)), []
        for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            if a != b:
                up[a] = b
                want.append(k)
        assert ngram_join.forest(x, y, n).tolist() == want


def test_equal_ids_and_unlike_texts(spark):
    """Each row of an id keeps its own set: links of both texts are found."""
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(1, one), (1, two), (2, one + " z"), (3, two + " z"), (1, one), (4, "else " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.classes(docs).collect()) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_a_long_text(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(5, long), (7, long + " more"), (6, "short text of some words")]
    assert found(spark, rows) == [(5, 199_997, 5), (6, 2, 6), (7, 199_998, 5)]
