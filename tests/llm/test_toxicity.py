"""Toxicity on held-out labels, and where it is found."""

import re

import numpy as np

from lexframe.llm import toxicity

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    model = toxicity.train(known, labels)
    rows = toxicity.score(known, model).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows]) > 0.96
    assert sum(r.score >= 0.5 for r in rows if r.toxic == 0) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    toxic = known.where("toxic = 1")
    found = toxicity.sentences(toxic, model).select("doc_id").distinct().count()
    assert found > 0.7 * toxic.count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "idiot", "x"), (3, "fine words here. " * 9, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert scores[1] == scores[2] and len(scores) == 4
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.sentences(docs, model).count() >= 0


def test_pieces_have_the_same_names(monkeypatch):
    text = "some words. " * 500
    whole = toxicity.bag(text)
    names = toxicity._names
    monkeypatch.setattr(toxicity, "_names", lambda d, s, e: names(d, s, e, piece=100))
    assert all((a == b).all() for a, b in zip(whole, toxicity.bag(text), strict=True))


def plain_features(text):
    """The set of buckets of each sentence with words, by plain loops."""
    out = []
    for part in re.split(rb"[\n!.?]", (text or "").lower().encode()):
        own = set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", part):
            for kind, piece in enumerate([word, *(word[:n] if len(word) > n else None for n in toxicity.STEMS)]):
                if piece:
                    name = toxicity.WORDS.names(toxicity.WORDS.prefix(np.frombuffer(piece, np.uint8)), np.array([0]), np.array([len(piece)]))
                    own.add(int(toxicity.mix(name + np.uint64(kind))[0] >> np.uint64(46)))
        if own:
            out.append(own)
    return out


def plain_score(weight, bias, text):
    """Noisy-or: one minus the product of the complements of the sentences."""
    left = 1.0
    for own in plain_features(text) or [set()]:
        left *= 1 - 1 / (1 + np.exp(-(bias + sum(float(weight[b]) for b in own))))
    return 1 - left


TEXTS = ["Good day. You utter idiots! are here?\nfine", "", None, "one", "Ünïcödé wörds here. And MORE words, wordsmith", "...", "a b c. d e f"] + [f"sentence number{k}. another{k % 3} thing" for k in range(9)]


def test_score_is_a_noisy_or_by_brute_force():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(0, 2, toxicity.BUCKETS).astype(np.float32), -1.5)
    for text in TEXTS:
        assert abs(model.score(text) - plain_score(model.weight, model.bias, text)) < 1e-6


def test_first_step_follows_the_gradient():
    """One step of Adam goes against the sign of the gradient of the log loss, here by differences."""
    texts = [("bad vile words. plain day", 1), ("bad day out. good words", 1), ("plain words. good day", 0), ("good plain out. day words", 0)] * 3
    bags = [(y, *toxicity.bag(t)[:2]) for t, y in texts]
    model = toxicity.fit(bags, (0.5, 0.5), steps=1, least_df=3, decay=0.0)

    def loss(weight, bias):
        scores = np.array([plain_score(weight, bias, t) for t, _ in texts])
        return -np.mean([np.log(s if y else 1 - s) for s, (_, y) in zip(scores, texts, strict=True)])

    base, checked = np.zeros(toxicity.BUCKETS), 0
    for b in np.flatnonzero(model.weight):
        up, down = base.copy(), base.copy()
        up[b], down[b] = 1e-4, -1e-4
        slope = (loss(up, -5.0) - loss(down, -5.0)) / 2e-4
        if abs(slope) > 1e-6:
            assert np.sign(model.weight[b]) == -np.sign(slope)
            checked += 1
    assert checked > 5 and np.sign(model.bias + 5) == -np.sign(loss(base, -5 + 1e-4) - loss(base, -5 - 1e-4))


def test_ties_and_long_texts(spark):
    """Of several labels the largest counts; a very long text is scored whole, but not trained on."""
    long = "fine words here. " * 20_000 + "vile insult"
    rows = [(k, "vile insult here" if k % 2 else "fine words here") for k in range(200)] + [(500, long), (501, "fine words"), (501, "vile insult")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(500, 0), (1, 0), (501, 0), (501, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got[500] > 0.5 and got[1] > 0.5 > got[0]
