"""Exact removal of repeated byte strings by distributed prefix doubling over a sparse suffix array.

Suffixes are ranked by prefixes of growing length: Spark sorts (rank, rank) pairs at offsets 16, 32, ... and last at the
threshold; equal pairs get equal ranks, and a suffix drops out of the rounds once its rank is unique or past the
threshold. A rank is the name of a prefix, computed from its bytes alone, so the rank of the prefix twice as long needs
no look-up of another suffix's rank.

Comparing all suffixes of all texts would sort one row a byte, so the first ranks are taken only at *anchors*: in every
window of `threshold` bytes, the position whose 16-byte prefix has the smallest mixed name. The anchor depends on the
bytes of its window alone, so equal windows have equal anchors and nothing is lost. Windows that follow each other and
share an anchor are a *piece*, which is ranked as one:

* the first rank of a pair is that of the bytes of the round's length around the anchor, which all windows of the piece
  hold; where no other document has it, the piece drops out;
* the second is that of all bytes the piece covers; where a smaller document has an equal pair, all windows of the piece
  are marked as repeats and drop out;
* what is left is cut into the pieces of the next length, and into single windows in the last round.

Each pack of documents sends one row for equal pairs, with its smallest document, so a string that a third of all
documents hold arrives once a pack. Rows travel in blocks, are sorted by Spark within hash ranges of their first rank
(so the sort spills where it must) and are judged as a stream. Verdicts go back as bytes in the order of the rows that
asked. A pair has 128 bits; bytes are not compared beyond that.

Defined cases: a null text is empty; texts shorter than the threshold lose nothing; only documents with a smaller id
count, so neither repeats within a document nor rows with equal ids do; rows with null ids lose nothing and cause no
removal; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.kit import U64, Rolling, keep, mix, planes, raw_texts, texts, unplanes

SEED_BYTES = 16
#: Bytes of text in a pack, and of text that is named at a time.
PACK_BYTES, PIECE = 2 << 20, 1 << 17
FIRST, SECOND = Rolling(30_011), Rolling(30_013)
_LOW32 = U64((1 << 32) - 1)
_MARK, _OPEN = 1, 2
_PACK = ("ids", "known", "sizes", "data", "runs", "anchors")
#: Bytes of text whose pairs a range holds, and ranges at most; Spark's sort spills within a range.
RANGE_BYTES, MOST_RANGES = 12 << 20, 100_000
#: Bytes after which a batch for Python ends: a row may hold a whole pack.
BATCH_BYTES = 4 << 20
#: Verdicts that are put in the order of their packs at a time.
GATHER = 1 << 20


def lengths(threshold: int) -> list[int]:
    """The prefix lengths of the rounds. A doubled length is used while every window has a place for it around its
    anchor: the places lie 16 bytes apart."""
    out, k = [SEED_BYTES], 2 * SEED_BYTES
    while threshold - k >= SEED_BYTES - 1:
        out.append(k)
        k *= 2
    return [*out, threshold]


def _bits(mask: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(mask).tobytes(), 1)


def _pack(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows of (ids, known, sizes, data, runs, anchors, total): the documents of a task in packs of about PACK_BYTES,
    compressed, and bits for the first windows of pieces and for anchors, in the same order."""
    squeeze = zstandard.ZstdCompressor(level=1)
    ids, parts, total = [], [], 0

    def close() -> pa.RecordBatch:
        sizes, raw = np.array([len(x) for x in parts], "<i8"), b"".join(parts)
        runs, anchors = _anchored(np.frombuffer(raw, np.uint8), sizes, threshold)
        known = np.array([x is not None for x in ids], np.uint8).tobytes()
        row = [np.array([x or 0 for x in ids], "<i8").tobytes(), known, sizes.tobytes(), squeeze.compress(raw), _bits(runs), _bits(anchors)]
        ids.clear(), parts.clear()
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row), pa.array([len(raw)], pa.int64())], [*_PACK, "total"])

    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
            if ids and total + len(raw) > PACK_BYTES:
                yield close()
                total = 0
            ids.append(doc_id), parts.append(raw)
            total += len(raw)
    if ids:
        yield close()


def _last_windows(sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents one after another, the places of their first bytes and after their last windows."""
    start = np.cumsum(sizes) - sizes
    return start, start + np.maximum(sizes - threshold + 1, 0)


def _anchored(data: np.ndarray, sizes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the first windows of pieces and of the anchors of these pieces."""
    runs, anchors = np.zeros(len(data), bool), np.zeros(len(data), bool)
    start, stop = _last_windows(sizes, threshold)
    edge = np.zeros(len(data) + 1, np.int8)
    some = stop > start
    edge[start[some]] += 1
    edge[stop[some]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    first = np.zeros(len(data), bool)
    first[start[some]] = True
    before = -1  # the anchor of the window before
    for at in range(0, len(data) - threshold + 1, PIECE):
        upto = min(len(data) - threshold + 1, at + PIECE)
        part = data[at : upto + threshold - 1]
        one = FIRST.prefix(part)
        name = mix((one[SEED_BYTES:] - one[:-SEED_BYTES]) * FIRST.down[: len(part) - SEED_BYTES + 1])
        least = (name & ~_LOW32) | np.arange(len(name), dtype=U64)
        have, need = 1, threshold - SEED_BYTES + 1
        while have < need:
            step = min(have, need - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        anchor = (least & _LOW32).astype(np.int64) + at
        turn = np.append(anchor[0] != before, anchor[1:] != anchor[:-1])
        turn = (turn | first[at:upto]) & inside[at:upto]
        runs[at:upto] = turn
        anchors[anchor[turn]] = True
        before = int(anchor[-1])
    return runs, anchors


class Pack:
    """The documents of a pack, and in each round its open windows."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, data: bytes, runs: bytes, anchors: bytes, threshold: int):
        self.ids, self.sizes, self.threshold = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8"), threshold
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(self.sizes.sum())))
        self.bytes = np.frombuffer(raw, np.uint8)
        n = len(self.bytes)
        self.start, stop = _last_windows(self.sizes, threshold)
        self.low = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(runs), np.uint8), count=n))
        self.doc = np.searchsorted(self.start, self.low, side="right") - 1
        self.anchor = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(anchors), np.uint8), count=n))  # they never go back, so both are in order
        self.high = np.minimum(np.append(self.low[1:], n), stop[self.doc]) - 1
        named = np.frombuffer(known, np.uint8)[self.doc].astype(bool)
        self.low, self.high, self.anchor, self.doc = self.low[named], self.high[named], self.anchor[named], self.doc[named]
        self.gone = np.zeros(n, bool)

    def _named(self, rolling: Rolling, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of the byte strings from start to end."""
        if len(start) and (start[1:] < start[:-1]).any():
            order = np.argsort(start, kind="stable")
            out = np.empty(len(start), U64)
            out[order] = self._named(rolling, start[order], end[order])
            return out
        out, at = np.empty(len(start), U64), 0
        while at < len(start):
            base = int(start[at])
            to = max(at + 1, int(np.searchsorted(start, base + PIECE)))
            prefix = rolling.prefix(self.bytes[base : int(end[at:to].max())])
            out[at:to] = rolling.names(prefix, start[at:to] - base, end[at:to] - base)
            at = to
        return out

    def pieces(self, length: int, windows: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """First and last windows of the pieces of a round, the place of the bytes that are ranked, and their documents;
        `windows` are those still open, in order."""
        if windows is None:
            return self.low, self.high, self.anchor, self.doc
        of = np.searchsorted(self.low, windows, side="right") - 1
        if length == self.threshold or not len(windows):
            return windows, windows, windows, self.doc[of]
        shift = np.maximum(-(-(self.anchor[of] - windows - (self.threshold - length)) // SEED_BYTES), 0)
        new = np.ones(len(windows), bool)
        new[1:] = (windows[1:] != windows[:-1] + 1) | (of[1:] != of[:-1]) | (shift[1:] != shift[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(windows)) - 1
        return windows[at], windows[end], self.anchor[of[at]] - SEED_BYTES * shift[at], self.doc[of[at]]

    def asked(self, length: int, windows: np.ndarray | None) -> "Asked":
        """The pairs of a round."""
        low, high, place, doc = self.pieces(length, windows)
        if length == self.threshold:
            rank, other = self._named(FIRST, low, low + length), self._named(SECOND, low, low + length)
        else:
            rank = self._named(FIRST, place, place + length)
            other = mix(self._named(SECOND, low, high + self.threshold) + (place - low).astype(U64) * U64(0x9E3779B97F4A7C15) + (high - low).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        return Asked(low, high, rank, other, self.ids[doc])

    def after(self, asked: "Asked", verdicts: dict[int, list[tuple[int, bytes]]], ranges: int) -> np.ndarray:
        """Marks windows by the verdicts of a round; the windows that are still open."""
        verdict = asked.returned(verdicts, ranges)
        marked, opened = verdict == _MARK, verdict == _OPEN
        self.gone[_spread(asked.low[marked], asked.high[marked])] = True
        return np.sort(_spread(asked.low[opened], asked.high[opened]))

    def removed(self) -> np.ndarray:
        """Whether each byte lies in a marked window."""
        edge = np.zeros(len(self.bytes) + 1, np.int32)
        edge[:-1] += self.gone
        at = np.flatnonzero(self.gone)
        np.subtract.at(edge, at + self.threshold, 1)
        return np.cumsum(edge[:-1]) > 0


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from low to high, run after run."""
    count = high - low + 1
    return np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Asked:
    """The pairs of a pack in one round: one row for equal pairs, led by the smallest document."""

    def __init__(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray, other: np.ndarray, doc: np.ndarray):
        self.low, self.high, self.doc = low, high, doc
        order = np.argsort(rank)
        ranked = rank[order]
        twin = np.zeros(len(order) + 1, bool)
        twin[1:-1] = ranked[1:] == ranked[:-1]
        twin = np.flatnonzero(twin[1:] | twin[:-1])  # only rows whose rank repeats need the other keys
        some = order[twin]
        order[twin] = some[np.lexsort((doc[some], other[some], rank[some]))]
        a, b = rank[order], other[order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.row = np.empty(len(order), np.int64)
        self.row[order] = np.cumsum(first) - 1
        self.rank, self.other, self.lead = a[first], b[first], doc[order[first]]

    def by_range(self, ranges: int) -> Iterator[tuple[int, np.ndarray]]:
        """(range, rows of it in their order) for each range with rows; ranges divide the low 32 bits of the rank evenly."""
        to = (((self.rank & _LOW32) * U64(ranges)) >> U64(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.diff(to[order])) + 1
        for rows in np.split(order, cut) if len(order) else []:
            yield int(to[rows[0]]), rows

    def returned(self, verdicts: dict[int, list[tuple[int, bytes]]], ranges: int) -> np.ndarray:
        """The verdict on each piece. A piece of a larger document than its row's is a repeat within the pack."""
        out = np.zeros(len(self.rank), np.uint8)
        for k, rows in self.by_range(ranges):
            for at, bits in verdicts.get(k, ()):
                own = np.frombuffer(zlib.decompress(bits), np.uint8)
                out[rows[at : at + len(own)]] = own
        return np.where(self.doc > self.lead[self.row], _MARK, out[self.row])


class Judge:
    """Verdicts on a stream of rows in order of (rank, other, doc): marked where a smaller document has the pair; open
    where the rank stands in several documents. Rows are held back only while all of their rank are of one document."""

    def __init__(self) -> None:
        self.held = [np.zeros(0, np.int64) for _ in range(5)]
        self.rank = self.other = self.least = 0
        self.varied = False  # whether the last rank that was judged goes on and stands in several documents

    def judge(self, columns: list[np.ndarray], last: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
        """The rows that can be judged and their verdicts."""
        rows = [np.concatenate(x) for x in zip(self.held, columns, strict=True)]
        rank, other, doc = rows[:3]
        n = len(rank)
        if not n:
            return rows, np.zeros(0, np.uint8)
        new_rank = np.ones(n, bool)
        new_rank[1:] = rank[1:] != rank[:-1]
        new = new_rank.copy()
        new[1:] |= other[1:] != other[:-1]
        least = doc[new][np.cumsum(new) - 1]
        at = np.flatnonzero(new_rank)
        varied = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
        if self.varied and rank[0] == self.rank:
            varied[0] = True
            if other[0] == self.other:
                head = (rank == rank[0]) & (other == other[0])
                least[head] = np.minimum(least[head], self.least)
        done = n if last or varied[-1] else int(at[-1])
        verdict = np.where(doc > least, _MARK, np.where(varied[np.cumsum(new_rank) - 1], _OPEN, 0)).astype(np.uint8)
        self.held = [x[done:] for x in rows]
        self.varied = done == n and bool(varied[-1])
        if done:
            self.rank, self.other, self.least = rank[done - 1], other[done - 1], least[done - 1]
        return [x[:done] for x in rows], verdict[:done]


_ROW = "rank long, other long, doc long, pack long, at int, range int"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (range, pack, n, data)."""
    for batch in batches:
        for k, pack, n, raw in zip(*(batch.column(c).to_pylist() for c in ("range", "pack", "n", "data")), strict=True):
            for at in range(0, n, 1 << 18):
                m = min(n, at + (1 << 18)) - at
                columns = [unplanes(raw[8 * n * j :][: 8 * n], 8)[at : at + m].view(np.int64) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(m, pack)), pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array(np.full(m, k, np.int32))], [x.split()[0] for x in _ROW.split(", ")])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, range, at, bits): the verdicts of a pack from row `at` on, gathered from up to GATHER rows at a time."""
    judge, found, waiting, k = Judge(), [], 0, 0

    def gathered() -> pa.RecordBatch:
        pack, at, verdict = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.lexsort((at, pack))
        pack, at, verdict = pack[order], at[order], verdict[order]
        cut = np.flatnonzero(np.append(True, pack[1:] != pack[:-1]))
        rows = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(pack)], strict=True):
            own = np.zeros(int(at[b - 1] - at[a]) + 1, np.uint8)
            own[at[a:b] - at[a]] = verdict[a:b]
            rows.append((int(pack[a]), k, int(at[a]), zlib.compress(own.tobytes(), 1)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["pack", "range", "at", "bits"])

    def add(columns: list[np.ndarray], last: bool = False) -> int:
        rows, verdict = judge.judge(columns, last)
        some = np.flatnonzero(verdict)
        if len(some):
            found.append((rows[3][some], rows[4][some], verdict[some]))
        return len(some)

    for batch in batches:
        if batch.num_rows:
            k = batch.column("range")[0].as_py()
            waiting += add([batch.column(c).to_numpy() for c in ("rank", "other", "doc", "pack", "at")])
            if waiting > GATHER:
                yield gathered()
                waiting = 0
    add([np.zeros(0, np.int64)] * 5, True)
    if found:
        yield gathered()


def _round(rows: DataFrame, ranges: int) -> DataFrame:
    """(pack, verdicts array<struct<range, at, bits>>) from rows (range, pack, n, data): one range a partition, in which
    Spark sorts the pairs."""
    pairs = rows.repartitionById(ranges, F.col("range")).mapInArrow(_unpacked, _ROW).sortWithinPartitions("rank", "other", "doc")
    gathered = pairs.mapInArrow(_judged, "pack long, range int, at int, bits binary")
    return gathered.groupBy("pack").agg(F.collect_list(F.struct("range", "at", "bits")).alias("verdicts"))  # a few entries a range


def _verdicts(column: pa.Array) -> list[dict[int, list[tuple[int, bytes]]]]:
    out = []
    for x in column.to_pylist():
        own: dict[int, list[tuple[int, bytes]]] = {}
        for v in x or ():
            own.setdefault(v["range"], []).append((v["at"], v["bits"]))
        out.append(own)
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _packs(batch: pa.RecordBatch, threshold: int, rounds: list[int], ranges: int) -> Iterator[tuple[int, Pack, np.ndarray | None]]:
    """Each pack of a batch after the verdicts of some rounds, with its open windows."""
    verdicts = [_verdicts(batch.column(f"v{k}")) for k in range(len(rounds))]
    for i in range(batch.num_rows):
        pack, windows = Pack(*(batch.column(c)[i].as_py() for c in _PACK), threshold), None
        for k, length in enumerate(rounds):
            windows = pack.after(pack.asked(length, windows), verdicts[k][i], ranges)
        yield batch.column("pack")[i].as_py(), pack, windows


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of each document; spans is an array of (start, end) byte
    offsets, kept the remaining bytes.

    Shuffled are 24 bytes, before compression, for each distinct pair of a pack in each round (in the first, about one
    for 18 bytes of text), and the compressed packs with the verdicts so far. Verdicts are written to the shared folder
    after each round.
    """
    if threshold < SEED_BYTES:
        raise ValueError(f"the threshold must be at least {SEED_BYTES} bytes")
    packs = texts(docs, id_col, text_col).mapInArrow(lambda b: _pack(b, threshold), ", ".join(f"{c} binary" for c in _PACK) + ", total long")
    packs = keep(packs.withColumn("pack", F.monotonically_increasing_id()), "suffix-packs", BATCH_BYTES)
    total = packs.agg(F.sum("total")).first()[0] or 0
    packs = packs.drop("total")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, total // RANGE_BYTES))
    rounds, tables = lengths(threshold), []

    def known(upto: int) -> DataFrame:
        out = packs
        for k, table in enumerate(tables[:upto]):
            out = out.join(table.withColumnRenamed("verdicts", f"v{k}"), "pack", "left")
        return out

    def asker(k: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, pack, windows in _packs(batch, threshold, rounds[:k], ranges):
                    asked = pack.asked(rounds[k], windows)
                    own = [(r, len(x), b"".join(planes(c[x].view(U64), 8) for c in (asked.rank, asked.other, asked.lead))) for r, x in asked.by_range(ranges)]
                    yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in own], pa.int32()), pa.array([number] * len(own), pa.int64()), pa.array([n for _, n, _ in own], pa.int64()), pa.array([x for _, _, x in own], pa.binary())], ["range", "pack", "n", "data"])

        return ask

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (_, pack, _) in enumerate(_packs(batch, threshold, rounds, ranges)):
                gone = pack.removed()
                spans, kept, removed = [], [], []
                for at, n in zip(pack.start.tolist(), pack.sizes.tolist(), strict=True):
                    lost = gone[at : at + n]
                    turn = np.flatnonzero(np.diff(lost, prepend=False, append=False)) if n else np.zeros(0, int)
                    spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
                    kept.append(pack.bytes[at : at + n][~lost].tobytes())
                    removed.append(int(lost.sum()))
                ids = pa.array(pack.ids, mask=np.frombuffer(batch.column("known")[i].as_py(), np.uint8) == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(pack.sizes), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    for k in range(len(rounds)):
        tables.append(keep(_round(known(k).mapInArrow(asker(k), "range int, pack long, n long, data binary"), ranges), f"suffix-round-{k}", BATCH_BYTES))
    return known(len(rounds)).mapInArrow(last, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: bigint, end: bigint>>, kept binary")
