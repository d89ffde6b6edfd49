"""Byte-level BPE by corpus-level merge replay.

A slice of the corpus is cut into words by the pre-tokenisation pattern. Its distinct words become one linked sequence
of byte tokens, and an inverted index leads from the rank of each mergeable pair to the positions that hold it. The
ranks are then replayed in order, lowest first: all positions of a rank are merged at once, only their two neighbours
get new pairs, and those go back into the index. The ids of a text are the ids of its words in order.

Defined cases: a null text is empty; an empty text has no ids; ids that aren't in the table are an error when decoded;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexframe.llm.kit import light, slices, texts

#: Texts of more characters are cut into words one at a time, so that their words never exist all at once.
LONG = 1 << 20
#: Distinct words that a task remembers between slices; when there are more it starts anew.
REMEMBER = 400_000


class Ranks:
    """The ranks of a file of `base64 rank` lines, ready for look-ups of whole arrays."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], dtype=np.int64)
        self.stride = size
        pairs = [(self.rank[t[:i]] * size + self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        pairs.sort()
        self.pair = np.array([p for p, _ in pairs] + [1 << 62], dtype=np.int64)
        self.merged = np.array([r for _, r in pairs] + [-1], dtype=np.int64)
        self.length = np.array([len(t) for t in self.token], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two tokens make, -1 where they make none."""
        key = left * self.stride + right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.merged[at], -1)

    def text_of(self, ids: bytes) -> bytes:
        """The bytes that little-endian unsigned 32-bit ids stand for."""
        at = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if len(at) and (at.max() >= self.stride or not self.length[at].all()):
            raise ValueError("an id is not in the rank table")
        return _gather(self.bytes, self.start[at], self.length[at]).tobytes()

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and the number of ids of each."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        token = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(token)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            rank = self.merge_of(token[at], token[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, positions in zip(rank[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(heap, r)

        put(np.flatnonzero(after >= 0))
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = np.unique(found[0] if len(found) == 1 else np.concatenate(found))
            at = at[alive[at]]
            at = at[after[at] >= 0]
            at = at[self.merge_of(token[at], token[after[at]]) == rank]
            if not len(at):
                continue
            if (after[at[:-1]] == at[1:]).any():  # runs such as "aaa": the left pair of two that overlap goes first
                chosen, last = [], -1
                for x in at.tolist():
                    if x != last:
                        chosen.append(x)
                        last = int(after[x])
                at = np.array(chosen, dtype=np.int64)
            gone = after[at]
            beyond = after[gone]
            token[at] = rank
            alive[gone] = False
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            put(np.unique(np.concatenate([left[left >= 0], at[beyond >= 0]])))
        owner = np.repeat(np.arange(len(words)), sizes)
        return token[alive], np.bincount(owner[alive], minlength=len(words))


class _Words(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + length] one after another."""
    total = int(length.sum())
    if not total:
        return flat[:0]
    shift = start - np.concatenate([[0], np.cumsum(length)[:-1]])
    return flat[np.repeat(shift, length) + np.arange(total)]


class Encoder:
    """Encodes texts; remembers the words it has seen, within bounds."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self.words = _Words()
        self.done = 0
        self.flat, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, documents: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > REMEMBER:
            self._forget()
        number = self.words.__getitem__
        seen = [np.array(list(map(number, self.pattern.findall(t))), dtype=np.int32) if len(t) <= LONG else np.fromiter((number(m[0]) for m in self.pattern.finditer(t)), dtype=np.int32) for t in documents]
        if len(self.words) > self.done:
            fresh = [w.encode() for w in list(self.words)[self.done :]]
            flat, length = self.ranks.replay(fresh)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, flat.astype("<u4")])
            self.done = len(self.words)
        return [_gather(self.flat, self.start[x], self.length[x]) for x in seen]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) where ids holds unsigned 32-bit little-endian integers.

    Nothing is shuffled: a task replays the merges over the distinct words of its own slices. The rank file has a fixed
    size (about 1 MB) and travels with the function.
    """
    with open(ranks_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Ranks(data), pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encoder.encode([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(light(run), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes that the ids stand for."""
    with open(ranks_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(data)
        for batch in batches:
            for part in slices(batch, "ids"):
                out = [ranks.text_of(x.as_py() or b"") for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(light(run), "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `decode` of `encode` gives, in one Python stage: a task needs one worker and one rank table, not two of each."""
    with open(ranks_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(data)
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [x.tobytes() for x in encoder.encode([x or "" for x in part.column("text").to_pylist()])]
                n_tokens = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_tokens, pa.array(ids, pa.binary()), pa.array(map(ranks.text_of, ids), pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return texts(docs, id_col, text_col).mapInArrow(light(run), "doc_id long, n_tokens long, ids binary, decoded binary")
