"""Shared pieces: the scratch folder, Arrow batches, and rolling names of byte strings and words.

A *name* is a 64-bit number computed from the content of a string alone, so equal strings have equal names in every
task. It is a polynomial over random byte values modulo 2**64 followed by a bijective mix; where a name decides a
result rather than a candidate, two independent ones are used or the bytes are compared.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows of a batch for Python while a table is written.
BATCH_ROWS = 1_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_alone: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares (`spark.checkpoint.dir`).

    Where the setting is missing, one temporary folder stands in on a single machine; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _alone.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lexframe-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for what runs inside; the session has its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def frugal(spark: SparkSession):
    """What runs inside has batches of few rows for Python (texts are long, and a batch exists several times over on both
    sides), and Spark deletes the shuffle files of a plan when it has ended, since nothing needs them any more."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows if 0 < rows < BATCH_ROWS else BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def write(df: DataFrame, path: str, batch_bytes: int = 0) -> None:
    """Writes a table in a `frugal` way; `batch_bytes` ends a batch for Python once it has so many, as rows may be long."""
    spark = df.sparkSession
    with frugal(spark), _settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(batch_bytes)} if batch_bytes else {}):
        df.write.parquet(path)


def keep(df: DataFrame, name: str, batch_bytes: int = 0) -> DataFrame:
    """The DataFrame written to the shared folder and read back: it survives lost executors and ends the lineage."""
    path, schema = scratch(df.sparkSession, name), df.schema
    write(df, path, batch_bytes)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `keep` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def width(spark: SparkSession, df: DataFrame, per_mb: float = 8.0) -> int:
    """Number of hash ranges for work that gathers something from all rows: follows the input, at least one per core."""
    size = min(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), 1 << 60) / 1e6
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, round(size / per_mb)), 2)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) alone, so that other columns can't clash; ids are longs."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    for x in column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column:
        yield x.as_py() or b""


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes together, to bound memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def give_back() -> None:
    """Returns memory that is free to the system. Spark uses a Python worker again and again; without this it keeps the
    most that any task in it had, for all stages that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def light(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back when the task has ended."""

    @wraps(run)
    def lightly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lightly


def light_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function for applyInArrow that gives its memory back after each group."""

    def lightly(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return lightly


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Names of all substrings of a byte string from one prefix sum."""

    def __init__(self, seed: int, size: int = 1 << 16):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
        self.factor = int(rng.integers(1 << 40, 1 << 60)) * 8 + 5
        self.inverse = pow(self.factor, -1, 1 << 64)
        self._grow(size)

    def _grow(self, size: int) -> None:
        with np.errstate(over="ignore"):
            up = np.full(size, self.factor, dtype=U64)
            down = np.full(size, self.inverse, dtype=U64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._grow(max(2 * len(self.up), len(data) + 1))
        out = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def names(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


WORDS = Rolling(20_011)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and \\t \\n \\v \\f \\r."""
    data = np.frombuffer(raw, dtype=np.uint8)
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_names(raw: bytes, piece: int = 1 << 20) -> np.ndarray:
    """Names of the words of a text in order; a long text is read in pieces cut at white space."""
    if len(raw) <= piece:
        start, end = word_spans(raw)
        return WORDS.names(WORDS.prefix(np.frombuffer(raw, dtype=np.uint8)), start, end)
    start, end = word_spans(raw)
    out, at = [], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + piece, side="right")))
        base = int(start[at])
        prefix = WORDS.prefix(np.frombuffer(raw[base : int(end[to - 1])], dtype=np.uint8))
        out.append(WORDS.names(prefix, start[at:to] - base, end[at:to] - base))
        at = to
    return np.concatenate(out) if out else np.zeros(0, dtype=U64)


_TURN = np.random.Generator(np.random.PCG64(20_023)).integers(1, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)


def shingle_names(words: np.ndarray, k: int) -> np.ndarray:
    """Names of the runs of k words; a shorter sequence is one run, none has none."""
    n = len(words)
    if n == 0:
        return words
    m = min(k, n)
    out = np.full(n - m + 1, m, dtype=U64)
    for i in range(m):
        out += words[i : n - m + 1 + i] * _TURN[i % 64]
    return mix(out)


def planes(values: np.ndarray, width_bytes: int) -> bytes:
    """Little-endian byte planes of unsigned numbers: equal high bytes lie together and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width_bytes].T).tobytes()


def unplanes(data: bytes, width_bytes: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(width_bytes, -1)
    out = np.zeros((raw.shape[1], 8), dtype=np.uint8)
    out[:, :width_bytes] = raw.T
    return out.view("<u8").reshape(-1)
