"""Exact Jaccard self-join of documents as sets of word n-grams, by count-vector R-trees.

The shingles of a document are hashed into GROUPS groups; the numbers of its shingles in each group are a point. The
sum of coordinate minima of two points bounds the overlap of their sets from above, and the sum of the minima of a
point and a box's upper corner bounds it for all points in the box, so an R-tree over points (packed by set size, then
by coordinates) gives all pairs that can reach the threshold. Of these, pairs that the same bound over FINE groups
allows are verified on the sets; without it, sets of over about a thousand shingles would nearly all be verified.

One tree over all documents would be searched by all documents; points are dealt first. Under any fixed order of
shingles, sets that reach the threshold t share one of their (1 - t)|x| + 1 first shingles, so each of those names a
block; blocks with the same members count once, blocks are cut by set size, and large ones into tiles. The order is that
of the hashes, except that shingles which are frequent in a sample of at most SAMPLE documents come last: that decides
how large blocks are, never which pairs are found. Documents with equal sets are one node throughout.

Classes are the components of the links. The pairs that the trees of a task find are verified all where they are
hardly more than its members. Where they are many, a spanning forest over the components so far is verified, by bound
first, so that a group of near copies grows together in a linear number of pairs and few turns; when a turn finds
few new links, every remaining pair of different components that the bound allows is verified. Pairs inside a component are
not needed, and no others are left out.

Defined cases: words are runs of bytes other than space and \\t \\n \\v \\f \\r after A-Z became lower case; fewer words than
n make one shingle, none no shingle, and a document without shingles is linked with nothing; null texts are empty; rows
with null ids have their own sizes, no component and no links; rows with equal ids keep their own sets and classes; other
columns are ignored. Shingles, sets and blocks are told apart by 64-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.components import components
from lexframe.llm.kit import U64, drop, frugal, keep, light, light_group, mix, planes, raw_texts, shingle_names, slices, texts, unplanes, width, word_names

GROUPS, FINE, LEAF, TILE, SMALL = 32, 256, 32, 16_384, 64  # FINE is a multiple of GROUPS
#: Pairs of points or boxes that are compared at once: their coordinates exist three times over (12 MB), and a box has LEAF children.
STEP = 1 << 15
#: Documents of the sample by which shingles are ordered, how many of them make a shingle frequent, and how many of those are told apart.
SAMPLE, FREQUENT, MOST_FREQUENT = 8_000, 3, 1 << 17
#: With a smaller share of links in a turn, all pairs that are left are verified.
FEW = 0.05
_LOW48, _LOW32 = U64((1 << 48) - 1), U64((1 << 32) - 1)


def shingles(raw: bytes, n: int) -> np.ndarray:
    """The sorted names of the distinct shingles of a text."""
    return np.unique(shingle_names(word_names(raw.lower()), n))


def set_name(own: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        total = np.sum(mix(own ^ U64(0xA0761D6478BD642F)), dtype=U64) + U64(len(own)) * U64(0xE7037ED1A0B428DB)
    return int(mix(np.array([total], dtype=U64)).view(np.int64)[0])


def least_overlap(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap with which sets of these sizes reach the threshold: 100 i >= percent (x + y - i)."""
    return -(-(x + y) * percent // (100 + percent))


class RTree:
    """Points packed into leaves and boxes bottom up, in the order given."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []  # from the leaves up: (upper corners, least sizes, greatest sizes)
        top, low, high = points, sizes, sizes
        while len(top) > 1 or not self.levels:
            cut = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def pairs(self, percent: int, most: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, bound) with i < j for all pairs of points whose bound reaches the least overlap."""
        n = len(self.points)
        for first in range(0, n, 256):
            query = np.arange(first, min(n, first + 256))
            work = [(len(self.levels) - 1, query, np.zeros(len(query), np.int64))]
            while work:
                level, q, box = work.pop()
                if len(q) > most:
                    work += [(level, q[most:], box[most:]), (level, q[:most], box[:most])]
                    continue
                top, low, high = self.levels[level]
                x = self.sizes[q]
                ok = (high[box] * 100 >= x * percent) & (low[box] * percent <= x * 100)
                q, box = q[ok], box[ok]
                ok = np.minimum(self.points[q], top[box]).sum(1) >= least_overlap(self.sizes[q], np.maximum(low[box], -(-self.sizes[q] * percent // 100)), percent)
                q, box = q[ok], box[ok]
                child = (box[:, None] * LEAF + np.arange(LEAF)).ravel()
                q = np.repeat(q, LEAF)
                if level:
                    ok = child < len(self.levels[level - 1][0])
                    work.append((level - 1, q[ok], child[ok]))
                    continue
                ok = (child < n) & (child > q)
                q, child = q[ok], child[ok]
                for at in range(0, len(q), most):
                    i, j = q[at : at + most], child[at : at + most]
                    keep_i = self.sizes[j] * percent <= self.sizes[i] * 100
                    keep_i &= self.sizes[i] * percent <= self.sizes[j] * 100
                    i, j = i[keep_i], j[keep_i]
                    bound = np.minimum(self.points[i], self.points[j]).sum(1)
                    good = bound >= least_overlap(self.sizes[i], self.sizes[j], percent)
                    yield i[good], j[good], bound[good]


def packed(own: np.ndarray) -> bytes:
    """The counts of a set's shingles in FINE groups, as the byte planes that are not empty."""
    count = np.bincount((own & U64(FINE - 1)).astype(np.int64), minlength=FINE)
    return planes(count, max(1, (int(count.max()).bit_length() + 7) // 8))


def unpacked(points: list[bytes]) -> np.ndarray:
    most = max([len(x) for x in points], default=FINE) // FINE
    out = np.zeros((len(points), FINE), np.uint8 if most == 1 else np.uint16 if most == 2 else np.int64)
    size = np.array([len(x) // FINE for x in points])
    for k in range(1, most + 1):
        rows = np.flatnonzero(size == k)
        raw = np.frombuffer(b"".join(points[r] for r in rows.tolist()), np.uint8).reshape(-1, k, FINE)
        for p in range(k):
            out[rows] |= raw[:, p].astype(out.dtype) << (8 * p)
    return out


def shared(fine: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sums of minima of the rows i and j, a bound of their overlap."""
    step = 1 << 14
    return np.concatenate([np.zeros(0, np.int64), *(np.minimum(fine[i[k : k + step]], fine[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step))])


def feasible(block: np.ndarray, tile: np.ndarray, sizes: np.ndarray, fine: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bound) of rows of the same block whose bound reaches the threshold; rows are sorted by block, then size.
    The bound over GROUPS groups chooses the pairs for that over FINE groups."""
    points = fine.reshape(len(fine), FINE // GROUPS, GROUPS).sum(1, dtype=np.int32)
    for i, j, _ in _coarse(block, tile, sizes, points, percent):
        bound = shared(fine, i, j)
        good = bound >= least_overlap(sizes[i], sizes[j], percent)
        yield i[good], j[good], bound[good]


def _coarse(block: np.ndarray, tile: np.ndarray, sizes: np.ndarray, points: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of rows that the bound over GROUPS groups allows.
    Of a block with two tiles, pairs within a tile are left to the block that has that tile alone."""
    count = np.diff(np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)))
    of = np.repeat(count, count)
    little = np.flatnonzero(of <= SMALL)
    for d in range(1, SMALL):
        i = little[: len(little) - d] if len(little) > d else little[:0]
        j = little[d:]
        ok = block[i] == block[j]
        if not ok.any():
            break
        i, j = i[ok], j[ok]
        for at in range(0, len(i), STEP):
            a, b = i[at : at + STEP], j[at : at + STEP]
            bound = np.minimum(points[a], points[b]).sum(1)
            good = (bound >= least_overlap(sizes[a], sizes[b], percent)) & ((tile[a] != tile[b]) | (tile[a] == -1))
            yield a[good], b[good], bound[good]
    edge = np.concatenate([[0], np.cumsum(count)])
    for k in np.flatnonzero(count > SMALL).tolist():
        a, b = int(edge[k]), int(edge[k + 1])
        order = np.lexsort((*points[a:b].T[:3], sizes[a:b])) + a
        for i, j, bound in RTree(points[order], sizes[order]).pairs(percent):
            i, j = order[i], order[j]
            good = (tile[i] != tile[j]) | (tile[i] == -1)
            yield i[good], j[good], bound[good]


def _documents(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, node, size, point) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(x, n) for x in raw_texts(part.column("text"))]
                points = [packed(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(points, pa.binary())], ["doc_id", "node", "size", "point"])

    return rows.mapInArrow(light(run), "doc_id long, node long, size long, point binary")


def _frequent(rows: DataFrame, found: DataFrame, n: int) -> np.ndarray:
    """The sorted names of the shingles that are frequent in a sample; at most MOST_FREQUENT (1 MB)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = [shingles(x, n) for x in set(raw_texts(part.column("text")))]
                name, times = np.unique(np.concatenate([np.zeros(0, U64), *own]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(times.astype(np.int64))], ["name", "n"])

    total = found.count()
    sample = rows.sample(min(1.0, SAMPLE / max(1, total)), seed=5)
    names = sample.mapInArrow(light(counted), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    with frugal(rows.sparkSession):
        out = names.orderBy(F.desc("n"), "name").limit(MOST_FREQUENT).select("name").toArrow().column("name").to_numpy()
    return np.sort(out.view(U64))


def _blocks(rows: DataFrame, n: int, percent: int, ranges: int, frequent: np.ndarray) -> DataFrame:
    """(block, node) of the blocks with several nodes; blocks with the same members are one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, node = [np.zeros(0, U64)], [np.zeros(0, U64)]
                for raw in set(raw_texts(part.column("text"))):
                    own = shingles(raw, n)
                    if len(own):
                        late = np.isin(own, frequent, assume_unique=True)
                        first = np.concatenate([own[~late], own[late]])[: len(own) - -(-len(own) * percent // 100) + 1]
                        key.append(first)
                        node.append(np.full(len(first), np.int64(set_name(own)).view(U64)))
                k, v = np.concatenate(key), np.concatenate(node)
                to = (((k & _LOW32) * U64(ranges)) >> U64(32)).astype(np.int64)
                order = np.lexsort((v, to))
                cut = np.flatnonzero(np.diff(to[order])) + 1
                parts = np.split(order, cut) if len(order) else []
                yield pa.RecordBatch.from_arrays([pa.array([int(to[p[0]]) for p in parts], pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array([planes(k[p] & _LOW48, 6) + planes(v[p], 8) for p in parts], pa.binary())], ["range", "n", "data"])

    def group(table: pa.Table) -> pa.Table:
        key, node = [], []
        for m, x in zip(table.column("n").to_pylist(), table.column("data"), strict=True):
            raw = x.as_py()
            key.append(unplanes(raw[: 6 * m], 6))
            node.append(unplanes(raw[6 * m :], 8))
        k, v = np.concatenate(key), np.concatenate(node)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))
        k, v = k[new], v[new]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        count = np.diff(np.append(at, len(k)))
        name = mix(np.add.reduceat(mix(v), at) + count.astype(U64))
        several = np.flatnonzero(count > 1)
        _, once = np.unique(name[several], return_index=True)
        chosen = np.zeros(len(at), bool)
        chosen[several[once]] = True
        rows_ = np.repeat(chosen, count)
        block = np.repeat(name, count)[rows_]
        return pa.table({"block": pa.array(block.view(np.int64)), "range": pa.array(np.full(len(block), table.column("range")[0].as_py(), np.int32)), "node": pa.array(v[rows_].view(np.int64))})

    found = keep(rows.mapInArrow(light(keys), "range int, n long, data binary").groupBy("range").applyInArrow(light_group(group), "block long, range int, node long"), "join-blocks")
    one = found.groupBy("block").agg(F.min("range").alias("range"))
    return found.join(one, ["block", "range"]).select("block", "node")


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The indices of the edges of a spanning forest of the nodes 0..n-1 in which earlier edges are preferred."""
    top, at, chosen = np.arange(n), np.arange(len(x)), [np.zeros(0, np.int64)]
    while True:
        a, b = top[x[at]], top[y[at]]
        live = a != b
        at, a, b = at[live], a[live], b[live]
        if not len(at):
            return np.unique(np.concatenate(chosen))
        first = np.full(n, -1, np.int64)
        first[np.stack([a, b], 1).ravel()[::-1]] = np.repeat(np.arange(len(at)), 2)[::-1]  # the first edge of each tree
        tree = np.flatnonzero(first >= 0)
        e = first[tree]
        chosen.append(at[e])
        up = np.arange(n)
        up[tree] = np.where(a[e] == tree, b[e], a[e])
        both = (up[up] == np.arange(n)) & (np.arange(n) < up)
        up[both] = np.flatnonzero(both)
        while (up[up] != up).any():
            up = up[up]
        top = up[top]


def _proposals(members: DataFrame, percent: int, ranges: int, turn: int | None) -> DataFrame:
    """(a, b, part_a, part_b) of nodes of different components in a block that can reach the threshold, with a < b.

    With a turn, a task that has many more such pairs than members proposes a spanning forest of their components (by
    bound in turn 0, then in another arbitrary order each turn, with as many other pairs as a small multiple of its
    members) and says so in a row of nulls.
    Members: (block, tile, node, component, size, point)."""
    most = 1 if turn == 0 else 4

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("size", "ascending"), ("node", "ascending")])
        block, tile, node, part, sizes = (table.column(c).to_numpy() for c in ("block", "tile", "node", "component", "size"))
        points = unpacked(table.column("point").to_pylist())
        names, of = np.unique(part, return_inverse=True)
        have, waiting, pruned = [np.zeros((0, 2), np.int64)], 0, False

        def ranked(e: np.ndarray) -> np.ndarray:
            i, j = e.T
            arbitrary = mix(mix(node[i].view(U64)) + mix(node[j].view(U64)) + U64(turn))
            if turn:
                return e[np.argsort(arbitrary)]
            bound = shared(points, i, j)
            return e[np.lexsort((arbitrary, -(256 * bound // (sizes[i] + sizes[j] - bound))))]

        def thinned(e: np.ndarray) -> np.ndarray:
            e = ranked(e)
            chosen = forest(of[e[:, 0]], of[e[:, 1]], len(names))
            if turn:
                chosen = np.concatenate([chosen, np.setdiff1d(np.arange(len(e)), chosen)[: max(0, most * len(node) - len(chosen))]])
            return e[chosen]

        for i, j, _ in feasible(block, tile, sizes, points, percent):
            ok = of[i] != of[j]
            i, j = i[ok], j[ok]
            less = node[i] < node[j]
            have.append(np.stack([np.where(less, i, j), np.where(less, j, i)], 1))
            waiting += len(i)
            if turn is not None and waiting > max(1 << 18, 8 * len(node)):
                have, pruned = [thinned(np.concatenate(have))], True
                waiting = len(have[0])
        e = np.concatenate(have)
        _, once = np.unique(np.stack([node[e[:, 0]], node[e[:, 1]]], 1), axis=0, return_index=True)
        e = e[once]
        if turn is not None and len(e) > most * len(node):
            e, pruned = thinned(e), True
        i, j = e.T
        out = pa.table({"a": pa.array(node[i]), "b": pa.array(node[j]), "part_a": pa.array(part[i]), "part_b": pa.array(part[j])})
        return pa.concat_tables([out, pa.table({c: pa.array([None], pa.int64()) for c in out.column_names})]) if pruned else out

    found = members.groupBy(F.pmod(F.xxhash64("block"), F.lit(ranges)).alias("range")).applyInArrow(light_group(run), "a long, b long, part_a long, part_b long")
    return found.distinct()


def _verified(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, part_a, part_b, linked) of each pair, on the sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdDecompressor()
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, U64))
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist(), strict=True):
                if x != last[0]:
                    last = (x, shingles(small.decompress(x), n))
                one, two = last[1], shingles(small.decompress(y), n)
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "part_a", "part_b")), pa.array(linked, pa.bool_())], ["a", "b", "part_a", "part_b", "linked"])

    left = bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "part_a", "part_b", "body_a", "body_b").mapInArrow(light(run), "a long, b long, part_a long, part_b long, linked boolean")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document, where the component is the smallest id that links lead to."""
    spark = docs.sparkSession
    everything = texts(docs, id_col, text_col)
    rows = everything.where("doc_id is not null")
    ranges = width(spark, rows)
    found = keep(_documents(everything, n), "join-documents")
    nodes = found.where("size > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("point").alias("point"))
    nodes = keep(nodes, "join-nodes")

    # A block is cut by set size: sets that reach the threshold lie in the same step of factor 100 / percent or the next.
    step = F.floor(F.ln(F.col("size").cast("double")) / F.ln(F.lit(100 / percent)) + F.lit(1e-9)).cast("int")
    members = _blocks(rows, n, percent, ranges, _frequent(rows, found, n)).join(nodes.select("node", "size", "point"), "node").withColumn("step", step)
    members = members.select("block", "node", "size", "point", F.explode(F.array(F.col("step") - 1, F.col("step"))).alias("step"))
    counts = members.groupBy("block", "step").agg(F.count("*").alias("m")).where("m > 1")
    members = members.join(counts, ["block", "step"])
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    own = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), tiles).cast("int")
    members = members.withColumns({"tiles": tiles, "own": own}).select("block", "step", "node", "size", "point", "tiles", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    alone = F.col("own") == F.col("other")
    members = members.select(F.xxhash64("block", "step", F.least("own", "other"), F.greatest("own", "other")).alias("block"), F.when(alone, -1).otherwise(F.col("own")).alias("tile"), "node", "size", "point")
    everyone = keep(members, "join-members")

    def partnered(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("size", "ascending"), ("node", "ascending")])
        block, tile, sizes = (table.column(c).to_numpy() for c in ("block", "tile", "size"))
        points = unpacked(table.column("point").to_pylist())
        good = np.zeros(len(block), bool)
        for i, j, _ in feasible(block, tile, sizes, points, percent):
            good[i] = good[j] = True
        return table.select(["block", "tile", "node", "size", "point"]).filter(pa.array(good))

    schema = "block long, tile int, node long, size long, point binary"
    members = keep(everyone.groupBy(F.pmod(F.xxhash64("block"), F.lit(ranges)).alias("range")).applyInArrow(light_group(partnered), schema), "join-partnered")
    drop(everyone)

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                own = [(node, x) for node, x in zip(part.column("node").to_pylist(), raw_texts(part.column("text")), strict=True) if set_name(shingles(x, n)) == node]
                yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in own], pa.int64()), pa.array([squeeze.compress(x) for _, x in own], pa.binary())], ["node", "body"])

    asked = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    # Rows with equal ids and other texts are told apart by their sets; equal rows are one. All of it is dealt by doc_id.
    bodies = keep(rows.join(asked, "doc_id").dropDuplicates(["doc_id", "node", "text"]).select("node", "text").mapInArrow(light(squeezed), "node long, body binary"), "join-bodies")

    parts = members.select("node").distinct().select("node", F.col("node").alias("component"))
    done = spark.createDataFrame([], "a long, b long")
    turn: int | None = 0
    while True:
        now = members.join(parts, "node").select("block", "tile", "node", "component", "size", "point")
        pairs = keep(_proposals(now, percent, ranges, turn).join(done, ["a", "b"], "left_anti"), "join-proposed")
        pruned = not pairs.where("a is null").isEmpty()
        fresh = keep(_verified(pairs.where("a is not null"), bodies, n, percent), "join-verified")
        done = done.unionByName(fresh.select("a", "b"))
        links = fresh.where("linked")
        tried, met = fresh.agg(F.count("*"), F.count_if("linked")).first()
        if met:
            labels = components(links.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))).withColumnRenamed("node", "part")
            merged = parts.join(labels.withColumnRenamed("component", "whole"), F.col("component") == F.col("part"), "left")
            parts = keep(merged.select("node", F.coalesce("whole", "component").alias("component")), "join-parts")
        if not pruned:
            break
        turn = turn + 1 if met > tried * FEW else None
    whole = nodes.select("node", "doc_id").join(parts, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answer = whole.select("node", "component").join(smallest, "component").select("node", "component_id")
    own = found.select("doc_id", "node", F.col("size").alias("n_shingles"))
    linked = own.where("n_shingles > 0 and doc_id is not null").join(answer, "node").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(own.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
