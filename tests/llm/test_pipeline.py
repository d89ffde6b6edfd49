"""The pipeline's stages against plain versions on a small table."""

import hashlib
import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from lexframe.llm import line_dedup

from .test_bpe import library  # noqa: F401

DIR = "/root/testdata/sf0.001"


def jaccard_classes(rows):
    from .test_ngram_join import brute

    return {i: c for i, _, c in brute(rows, 5, 80)}


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.keep(stage(spark, docs, DIR), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
    assert [n for n, *_ in stages] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]


def test_toxicity(spark, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    clean = [i for i, y in toxic.items() if y == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_lines(stages):
    _, before, after = stages[1]
    owner, rows, seen = {}, [], {""}
    for i, t in sorted((r.doc_id, r.text or "") for r in before.collect()):
        if t not in seen or not t:  # copies of a whole document go first
            rows.append((i, t))
        seen.add(t)
    chunks = {i: [b"\n".join(t.encode().split(b"\n")[a:b]) for a, b in line_dedup.cut(t.encode().split(b"\n"))] for i, t in rows}
    size = {i: [b - a for a, b in line_dedup.cut(t.encode().split(b"\n"))] for i, t in rows}
    want = {}
    for i, t in rows:
        kept = [c for k, c in enumerate(chunks[i]) if size[i][k] < 2 or owner.setdefault(c, (i, k)) == (i, k)]
        if kept and (b"\n".join(kept) or not t):
            want[i] = b"\n".join(kept).decode()
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert {i: t or "" for i, (t, _) in got.items()} == want
    assert all(n == len(t or "") for t, n in got.values())


def test_near_duplicates(stages):
    _, before, after = stages[2]
    classes = jaccard_classes([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {i for i, c in classes.items() if i == c}


def test_decontamination(spark, stages):
    _, before, after = stages[3]
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = [words(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        text = " ".join(words(r.text))
        if any(" ".join(i) in text for i in items if len(i) >= 9):
            assert r.doc_id not in kept
        elif not any(" ".join(i[k : k + 7]) in text for i in items for k in range(len(i) - 6)):
            assert r.doc_id in kept


def test_ids(stages, library):  # noqa: F811
    _, before, after = stages[4]
    got = {r.doc_id: (r.n_tokens, r.text_sha256) for r in after.collect()}
    for r in before.collect():
        assert got[r.doc_id] == (len(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a b\nc d\ne f\ng h", "en", "s", 15), (2, "a b\nc d\ne f\ng h", None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0), (4, None, "en", "s", 0), (5, "word " * 50_000, "en", "s", 250_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("documents", "labels", "benchmark"):
        part = docs if name == "documents" else spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int") if name == "labels" else spark.createDataFrame([(1, None)], "item_id long, text string")
        part.write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got >= {1, 3, 4, 5, None}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_planted_copies_go(spark, tmp_path):
    rng = random.Random(4)
    fresh = lambda i: "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(9)) for _ in range(6 + i))
    first = {i: fresh(i) for i in range(20)}
    rows = [(i, t, "en", "s", len(t)) for i, t in first.items()] + [(100 + 20 * k + i, t, "en", "s", len(t)) for k in range(3) for i, t in first.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(first)
    odd = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a"), (3, ""), (4, ""), (5, None), (6, None), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id for r in corpus_pipeline.without_copies(odd).collect()), key=str) == [1, 1, 3, 4, 5, 6, None]


def test_copies_leave_the_rest_alike(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    own = corpus_pipeline.without_copies(docs)
    before, after = ({r.doc_id: r.text for r in line_dedup.rewrite(d, line_dedup.repeated_chunks(d), length_col="n_chars").collect()} for d in (docs, own))
    ids = {r.doc_id for r in own.select("doc_id").collect()}
    assert len(before) > len(after) and after == {i: t for i, t in before.items() if i in ids}


def test_public_pattern():
    assert public_tokenizers.PATTERN


def test_equal_ids_and_unlike_texts(spark, tmp_path):
    """No text is lost or replaced by that of another row with the same id."""
    common = "one two three four\nfive six seven eight\nnine ten eleven twelve\nx y z a b c\n" * 3
    rows = [(1, "X start\n" + common + "X own ending", "en", "s", 1), (1, "Y start\nother lines here\n" + common + "Y other ending", "de", "t", 2), (0, common, "en", "s", 3), (2, "Y other text entirely of its own\nwith lines", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.new_lines(spark, docs, "").collect()
    assert {(r.lang, r.source, (r.text or "").split("\n")[0], (r.text or "").split("\n")[-1]) for r in out if r.doc_id == 1} == {("en", "s", "X start", "X own ending"), ("de", "t", "Y start", "Y other ending")}
    assert all(r.n_chars == len(r.text) for r in out if r.doc_id == 1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 1, 2]
    copies = spark.createDataFrame([(1, "a b"), (2, "a b"), (2, "c d")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.without_copies(copies).collect()) == [(1, "a b"), (2, "c d")]
