"""Memory of a Python worker: what it keeps when a task has ended, and what the search of an R-tree takes."""

import random
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from lexframe.llm import bpe, ngram_join
from lexframe.llm.queries import pattern, tokenizer

KEPT = """
import pickle, sys
import pyarrow as pa

def now():
    return int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1]) / 1024

run, batch = pickle.load(sys.stdin.buffer)
rows = sum(x.num_rows for x in run(iter([batch.slice(0, 1)])))
before = now()
rows = sum(x.num_rows for x in run(iter([batch])))
print(rows, now() - before)
"""


def kept(monkeypatch, docs, make, batch):
    """Rows out, and the MB that a new process has more after the function that `make` hands to Spark has run."""
    found = []
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, run, *a: found.append(run) or self)
        make()
    out = subprocess.run([sys.executable, "-c", KEPT], input=cloudpickle.dumps((found[0], batch)), stdout=subprocess.PIPE, check=True).stdout.split()
    return int(out[-2]), float(out[-1])


def test_a_worker_gives_back_what_a_task_had(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(150_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([" ".join(words[i::100] * 4) for i in range(100)])], ["doc_id", "text"])
    docs = spark.createDataFrame([], "doc_id long, text string")
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    rows, mb = kept(monkeypatch, docs, lambda: bpe.round_trip(docs, ranks, pattern()), batch)
    assert rows == 100
    assert mb < 50


def test_a_search_of_many_near_copies_takes_little_memory():
    rng = np.random.Generator(np.random.PCG64(5))
    points = (100 + rng.integers(0, 2, (3_000, ngram_join.GROUPS))).astype(np.int32)
    sizes = points.sum(1).astype(np.int64)
    tracemalloc.start()
    pairs = sum(len(i) for i, _, _ in ngram_join.RTree(points, sizes).pairs(80))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert pairs == 3_000 * 2_999 // 2
    assert peak < 40
