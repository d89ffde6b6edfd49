"""Byte-level BPE against the library that the rank file belongs to."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lexframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return bpe.Ranks(f.read())


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def made_up(n):
    rng = random.Random(5)
    pool = "aab  bc\n\t\r\x0b\x1c\x1f\x85\xa0 　é'stllveñ0123½Ⅷ.,!…😀日本語́﻿_-" + "theantion"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a" * 5000, " " * 999, "aaab" * 700, "", "I'm don't WE'LL", "<|endoftext|>"]


def test_equals_library(ranks, library):
    texts = made_up(4000)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], encoder.encode(texts[at : at + 500]), strict=True):
            assert ids.tolist() == library.encode_ordinary(text), repr(text)


def test_long_texts_take_the_other_path(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 10)
    text = "the condition of the thing " * 50
    assert bpe.Encoder(ranks, public_tokenizers.PATTERN).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_forgetting_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    for text in made_up(50):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_frames(spark, library):
    rows = [(1, "the thing, thing", "x"), (2, None, "y"), (3, "", None), (3, "", None), (4, "déjà 😀", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sorted(bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect())
    assert [r.doc_id for r in out] == [1, 2, 3, 3, 4]
    for row, (_, text, _) in zip(out, rows, strict=True):
        ids = library.encode_ordinary(text or "")
        assert (row.n_tokens, bytes(row.ids), bytes(row.decoded)) == (len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode())
    assert sorted(bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()) == out
    for f in (bpe.encode, bpe.round_trip):
        assert f(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_foreign_ids_are_an_error(ranks):
    assert ranks.text_of(b"") == b""
    with pytest.raises(ValueError, match="rank table"):
        ranks.text_of(np.array([ranks.stride], "<u4").tobytes())


def test_query(spark, library):
    from lexframe.llm.queries import op2_byte_bpe

    d = "/root/testdata/sf0.001"
    want = {r.doc_id: (library.encode_ordinary(r.text or ""), r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op2_byte_bpe(spark, d).collect()
    assert len(got) == len(want)
    for r in got:
        ids, text = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
