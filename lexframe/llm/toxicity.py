"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(bias + sum of the weights of its distinct
features), the words and the beginnings of words, and the document that of a noisy-or: one minus the product of its
sentences' complements. The weights are trained from document labels alone, by full-batch Adam on the log loss;
afterwards `sentences` locates the sentences that made the score.

Training reads at most `sample` labelled documents of at most TRAIN_BYTES bytes, half of each class, those with the smallest hashes of their ids;
the classes are weighted back to their shares among all training labels. Counts over labels and scores cover all rows.

Defined cases: a text without words, null ones included, is one sentence without words; features are hashed to BUCKETS
weights; rows without a label are never trained on; of several labels for an id the largest counts; repeated rows get
equal scores; without any training label of one class all weights are zero and the score is the share of toxic labels, 0.5 without
any; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.kit import U64, WORDS, frugal, light, mix, slices, texts

BUCKETS = 1 << 18
#: Upper bound of the number of labelled documents that training reads.
SAMPLE = 5_000
#: Labelled documents with longer texts are not trained on, which bounds the sample in bytes; they are scored like all others.
TRAIN_BYTES = 1 << 16
#: Lengths in bytes of the beginnings that are features beside the whole word; features with a weight at most.
STEMS, FEATURES = (4, 5, 6, 7, 8), 1 << 14
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, dtype=np.int64)
_STOP[[0x0A, 0x21, 0x2E, 0x3F]] = 1


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence number and bucket of each distinct feature of each sentence, and the byte offsets at which sentences end."""
    data = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    ends = np.flatnonzero(_STOP[data]) + 1
    sentence = np.searchsorted(ends, start, side="right")
    size = end - start
    long = [size > n for n in STEMS]
    starts = np.concatenate([start, *[start[x] for x in long]])
    names = _names(data, starts, np.concatenate([end, *[start[x] + n for n, x in zip(STEMS, long, strict=True)]]))
    kind = np.repeat(np.arange(len(STEMS) + 1, dtype=U64), [len(start), *[int(x.sum()) for x in long]])
    bucket = (mix(names + kind) >> U64(64 - 18)).astype(np.int64)
    both = np.unique(np.concatenate([sentence, *[sentence[x] for x in long]]) * BUCKETS + bucket)
    return (both // BUCKETS).astype(np.int32), (both % BUCKETS).astype(np.int32), ends


def _names(data: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Names of words, read in pieces so that a long text needs no long prefix sum."""
    if len(data) <= piece:
        return WORDS.names(WORDS.prefix(data), start, end)
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    out, at = np.empty(len(start), dtype=U64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + piece)))
        base, upto = int(start[at]), int(end[at:to].max())
        out[order[at:to]] = WORDS.names(WORDS.prefix(data[base:upto]), start[at:to] - base, end[at:to] - base)
        at = to
    return out


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float

    def logits(self, sentence: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the sentences with words, and their logits."""
        numbers, at = np.unique(sentence, return_inverse=True)
        return numbers, self.bias + np.bincount(at, weights=self.weight[bucket], minlength=len(numbers))

    def score(self, text: str | None) -> float:
        sentence, bucket, _ = bag(text)
        _, z = self.logits(sentence, bucket)
        if not len(z):
            z = np.array([self.bias])
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], shares: tuple[float, float], steps: int = 200, least_df: int = 3, decay: float = 1e-5, rate: float = 0.1) -> Model:
    """bags: (label, sentence numbers, buckets). shares: of the labels 0 and 1 among all training labels. Only
    the FEATURES features that best tell the classes apart, of those in `least_df` documents, have a weight."""
    labels = np.array([y for y, _, _ in bags], dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        share = shares[1] if sum(shares) else 0.5
        return Model(np.zeros(BUCKETS, np.float32), math.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6))))
    in_class = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for y, _, b in bags:
        in_class[y][np.unique(b)] += 1
    df, n = in_class[0] + in_class[1], np.array([(labels == 0).sum(), (labels == 1).sum()])
    apart = (in_class[1] / n[1] - in_class[0] / n[0]) ** 2 / (np.maximum(df, 1) / len(labels))
    used = np.flatnonzero(df >= least_df)
    used = np.sort(used[np.argsort(-apart[used], kind="stable")[:FEATURES]])
    column = np.full(BUCKETS, -1, np.int64)
    column[used] = np.arange(len(used))
    row, col, doc_of, rows = [], [], [], 0
    for doc, (_, sentence, bucket) in enumerate(bags):
        numbers, at = np.unique(sentence, return_inverse=True)
        n = max(1, len(numbers))
        known = column[bucket] >= 0
        row.append(at[known] + rows), col.append(column[bucket][known]), doc_of.append(np.full(n, doc))
        rows += n
    row, col, doc_of = np.concatenate(row), np.concatenate(col), np.concatenate(doc_of)
    order = np.argsort(col, kind="stable")
    row_by, col_by = row[order], col[order]
    cost = np.where(labels == 1, shares[1] / labels.mean(), shares[0] / (1 - labels.mean())) / len(labels)
    w = np.zeros(len(used) + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(row, weights=w[col], minlength=rows)
        total = np.bincount(doc_of, weights=np.logaddexp(0, z), minlength=len(labels))
        # d loss / d total: the complement of the noisy-or is exp(-total).
        slope = cost * np.where(labels == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)
        push = slope[doc_of] / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.append(np.bincount(col_by, weights=push[row_by], minlength=len(used)) + decay * w[:-1], push.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = w[:-1]
    return Model(weight, float(w[-1]))


def held_out(id_col: str = "doc_id"):
    """Whether an id belongs to the fifth that is never trained on."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits a model to the labels outside the held-out fifth."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = texts(docs, id_col, text_col).where(F.octet_length(F.coalesce("text", F.lit(""))) <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([s.tobytes() for s, _, _ in found], pa.binary()), pa.array([b.tobytes() for _, b, _ in found], pa.binary())], ["doc_id", "y", "sentence", "bucket"])

    with frugal(docs.sparkSession):
        got = rows.select("doc_id", "y", "text").mapInArrow(light(bags), "doc_id long, y int, sentence binary, bucket binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["sentence"], r["bucket"]))  # the order of tasks must not change the weights
    total = max(1, sum(counts.values()))
    return fit([(r["y"], np.frombuffer(r["sentence"], np.int32), np.frombuffer(r["bucket"], np.int32)) for r in got], (counts.get(0, 0) / total, counts.get(1, 0) / total))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the model has a fixed size (1 MB) and travels with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([model.score(x) for x in part.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(light(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, whose score is below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(x) < threshold for x in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(light(run), docs.schema)


def sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, sentence, text, score): the sentences, numbered from 0, whose own probability reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sentence, bucket, ends = bag(text)
                numbers, z = model.logits(sentence, bucket)
                raw = (text or "").lower().encode()
                for k, p in zip(numbers.tolist(), (1 / (1 + np.exp(-z))).tolist(), strict=True):
                    if p >= threshold:
                        a, b = int(ends[k - 1]) if k else 0, int(ends[k]) if k < len(ends) else len(raw)
                        out.append((doc_id, k, raw[a:b].decode().strip(), p))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "sentence", "text", "score"])

    return texts(docs, id_col, text_col).mapInArrow(light(run), "doc_id long, sentence long, text string, score double")
