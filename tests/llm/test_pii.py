"""Patterns against plain searches, disclosure against counting by hand."""

import math
import random
import re
from collections import Counter

from lexframe.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_patterns():
    rng = random.Random(3)
    pool = ["a@b.c", "x.y@mail1.example.com", "@", ".", "-", "+1 (017) 555-7713", "10.0.0.256", "1.2.3.4.5.6.7.8", "255.255.255.255", "4952935900253052", "4952 9359-0025 3052", "é", "😀", " ", "+", "12", "0", "(", ")", "\n", "a", "%", "٣", "b@c", "@d.e."]
    for _ in range(20000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_long_runs_are_quick():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_repeated_rows_count_each(spark):
    """Rows with equal ids count alike in all numbers: a term in two rows of one id, with its entity in both, discloses it."""
    rows = [(1, "quimby a@b.cd"), (1, "quimby a@b.cd"), (2, "common words"), (3, "common words")] + [(k, "common") for k in range(4, 40)]
    got = {(r.doc_id, t.start, t.action) for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect() for t in r.terms}
    assert got == {(1, 0, "remove")}


def test_a_long_text(spark):
    long = "filler words " * 100_000 + "zephyr a@b.cd " + "more of them " * 100_000
    docs = spark.createDataFrame([(1, long)] + [(k, "filler words more of them") for k in range(2, 60)], "doc_id long, text string")
    row = pii.detect(docs).where("doc_id = 1").first()
    assert [(long[t.start : t.end], t.action) for t in row.terms] == [("zephyr", "remove")]


def test_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.cd"), (1, "call +1 (017) 555-7713 or a@b.cd"), (1, "call +1 (017) 555-7713 or a@b.cd")], "doc_id long, text string")
    got = [(r.doc_id, len(r.base), len(r.terms)) for r in pii.detect(docs).collect()]
    assert sorted(got, key=str) == [(1, 2, 0), (1, 2, 0), (None, 1, 0)]
    assert pii.detect(docs.limit(0)).count() == 0


def test_copies_disclose(spark):
    rows = [(i, f"filler {i % 7} words, then ask quibble at q@x.example.com today") for i in range(30, 60)]
    rows += [(i, "other words, then ask nobody today") for i in range(60, 300)]
    rows += [(i, "the same passage names quimby at z@x.example.com again") for i in range(300, 340)]
    rows += [(900, "only once zephyrine at once@x.example.com today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(w in t for t in clean.values() for w in ("quimby", "zephyrine", "quibble", "@")) and all("today" in clean[i] for i in range(60, 300))


def test_whole_documents(spark):
    rng = random.Random(9)
    common = ["the", "of", "and", "on", "er", "ti"]
    pad = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [(i, pad(30)) for i in range(80)]
    rows += [(100 + i, f"Quibble{i % 4} {pad(40)} mail m{i % 4}@x.example.com or 10.0.0.{i % 3} {pad(25)} quibble{i % 4}, street{i % 5}") for i in range(24)]
    rows += [(200 + i, f"street{i % 5} {pad(9)}") for i in range(9)] + [(300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    n, n_t, n_e, words, want = len(rows), Counter(), Counter(), {}, {}
    n_te = Counter()
    for i, text in rows:
        spans = plain(text or "")
        words[i] = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text or "") if not any(a < m.end() and m.start() < b for a, b, _ in spans)]
        entities = {pii._value(text[a:b], k) for a, b, k in spans}
        n_t.update(set(re.findall(r"\w+", (text or "").lower())))
        n_e.update(entities)
        n_te.update((e, t) for e in entities for t in {t for *_, t in words[i]})
        want[i] = entities
    ratio = {(e, t): math.log2(c * n / (n_t[t] * n_e[e])) / math.log2(n / n_e[e]) for (e, t), c in n_te.items()}
    act = lambda r: "remove" if r >= pii.REMOVE - 1e-9 else "generalise"
    plainly = {i: sorted((a, b, max(map(act, rs))) for a, b, t in words[i] if (rs := [ratio[e, t] for e in es if ratio[e, t] >= pii.GENERALISE - 1e-9])) for i, es in want.items()}
    got = {r.doc_id: [(t.start, t.end, t.action) for t in r.terms] for r in pii.detect(docs).collect()}
    assert got == plainly
    clean = {r.doc_id: r.text.lower() for r in pii.sanitise(docs).collect()}
    assert not any("quibble" in t for t in clean.values()) and all("street" in clean[200 + i] for i in range(9))


def test_free_words():
    rng = random.Random(3)
    for _ in range(2000):
        text = " ".join(rng.choice(["a@b.c", "xa@b.cd", "1.2.3.4.5.6.7.8", "word", "+1 (017) 555-7713", "é", "4952935900253052", "x_y"]) + rng.choice(["", "!", "z"]) for _ in range(rng.randint(0, 7)))
        spans = pii.base_spans(text)
        assert list(pii.free_words(text, spans)) == [m.span() for m in re.finditer(r"\w+", text) if not any(a < m.end() and m.start() < b for a, b, _ in spans)]


def test_query(spark):
    import hashlib

    from lexframe.llm.queries import op5_pii

    d = "/root/testdata/sf0.001"
    want = {r.doc_id: plain(r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op5_pii(spark, d).collect()
    assert len(got) == len(want)
    for r in got:
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert ",".join(x for x in r.spans.split(",") if not x.startswith("term:")) == listed
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in want[r.doc_id]) for x in pii.KINDS[:4])
