"""Nearest neighbours by largest inner product, with a forest of random-projection trees.

The forest is fitted on a sample of at most ``SAMPLE`` vectors: a node cuts its vectors at the median of their projections on
a random direction. Every vector is then given a leaf in each tree. A query goes down all trees through one
priority queue, ordered by the smallest distance to a cut on the way there, and takes the ``probes`` leaves that come out first.
``probes`` is the smallest number that reaches ``RECALL`` against brute force, for queries of the sample among the
sample. Candidates are then ranked exactly, in double precision, on the original vectors.

Leaves meet their queries in blocks: a leaf's vectors in chunks of about ``CHUNK``, its queries likewise, so no group grows
with the data. A task merges the lists of a query from all its leaves before they are shuffled. Equal vectors are one candidate, which keeps the k + 1 smallest ids: no query can return more of them.

Defined results: rows without vec_id, and vectors that are NULL or zero, or hold a NULL, NaN or infinite component, take no
part; nor do vectors of another length than the commonest (of equally common ones the smaller). Of rows with equal
vec_id the smallest vector counts. Fewer candidates than k are all returned if the probes reach them; a sample that holds
all vectors of a small table is searched whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercantile.llm.tables import scratch

TREES, LEAF_ROWS, MOST_DEPTH = 12, 512, 10
SAMPLE, TRIALS, RECALL = 20_000, 200, 0.95
CHUNK, HELD = 2_048, 2_000_000


@dataclass
class Forest:
    """Complete trees of one depth. Node i of a tree has the children 2i + 1 and 2i + 2; leaves are numbered through all trees."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return len(self.cuts) << self.depth

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """Each vector's leaf in each tree."""
        out = np.zeros((len(vectors), len(self.cuts)), dtype=np.int32)
        for tree, (direction, cut) in enumerate(zip(self.directions, self.cuts, strict=True)):
            node = np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, direction[node]) > cut[node]
                node = 2 * node + 1 + side
            out[:, tree] = node - ((1 << self.depth) - 1) + (tree << self.depth)
        return out

    def search(self, query: np.ndarray, probes: int) -> list[int]:
        """The leaves that come first out of the queue of all trees."""
        inner, found = (1 << self.depth) - 1, []
        margins = self.directions @ query - self.cuts if inner else None
        queue = [(0.0, tree, 0) for tree in range(len(self.cuts))]
        while queue and len(found) < probes:
            cost, tree, node = heapq.heappop(queue)
            if node >= inner:
                found.append(node - inner + (tree << self.depth))
                continue
            margin = margins[tree, node]
            near = 2 * node + 1 + (margin > 0)
            heapq.heappush(queue, (cost, tree, near))
            heapq.heappush(queue, (max(cost, abs(margin)), tree, 4 * node + 3 - near))
        return found


def fit_forest(sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Forest:
    """A forest for ``rows`` vectors, of which ``sample`` are some."""
    depth = int(np.clip(np.ceil(np.log2(max(rows, 1) / leaf_rows)), 0, MOST_DEPTH))
    while depth and (len(sample) >> depth) < 8:
        depth -= 1
    rng, inner = np.random.Generator(np.random.PCG64(seed)), (1 << depth) - 1
    directions = rng.normal(size=(trees, inner, sample.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-12)
    cuts = np.zeros((trees, inner))
    for tree in range(trees):
        node = np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            for own in range((1 << level) - 1, (1 << (level + 1)) - 1):
                held = np.flatnonzero(node == own)
                side = sample[held] @ directions[tree, own]
                cuts[tree, own] = np.median(side) if len(held) else 0.0
                node[held] = 2 * own + 1 + (side > cuts[tree, own])
    return Forest(directions, cuts, depth)


def choose_probes(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """The smallest number of leaves, in steps of a sixteenth of a tree, that reaches ``recall`` within the sample."""
    codes, step = forest.leaf(sample), max(1, (1 << forest.depth) // 16)
    queries = np.unique(np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int))
    first = np.full((len(queries), k), np.inf)
    for row, q in enumerate(queries):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        rank = np.full(forest.leaves, forest.leaves, dtype=np.int64)
        order = forest.search(sample[q], forest.leaves)
        rank[order] = np.arange(len(order))
        first[row, : len(best)] = rank[codes[best]].min(axis=1)
        first[row, len(best) :] = -1
    for probes in range(step, forest.leaves + step, step):
        if (first < probes).mean() >= recall:
            return probes
    return forest.leaves


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(forest, sizes, probing, probes: int):
    """Rows (leaf, chunk, block, gid, vector): vectors once per tree and block of queries, queries per leaf and chunk of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = (probing, sizes) if probes else (sizes, probing)
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                vectors = _matrix(part.column(1)).astype(np.float64)
                if probes:
                    found = [forest.value.search(v, probes) for v in vectors]
                    row, leaf = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.array([x for f in found for x in f], dtype=np.int64)
                else:
                    found = forest.value.leaf(vectors)
                    row, leaf = np.repeat(np.arange(len(found)), found.shape[1]), found.ravel().astype(np.int64)
                gid = part.column(0).to_numpy()
                n_own, n_other = (np.maximum(1, -(-x[leaf] // CHUNK)) for x in (own, other))
                mine = (gid[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_own
                again = np.repeat(np.arange(len(row)), n_other)
                theirs = np.arange(len(again)) - np.repeat(np.cumsum(n_other) - n_other, n_other)
                row, leaf, mine = row[again], leaf[again], mine[again]
                chunk, block = (theirs, mine) if probes else (mine, theirs)
                for b in range(0, len(row), 10_000):
                    cut = slice(b, b + 10_000)
                    columns = [pa.array(leaf[cut], pa.int32()), pa.array(chunk[cut], pa.int32()), pa.array(block[cut], pa.int32()), pa.array(gid[row[cut]])]
                    yield pa.RecordBatch.from_arrays([*columns, part.column(1).take(pa.array(row[cut]))], ["leaf", "chunk", "block", "gid", "v"])

    return run


def _leaf_counts(forest, probes: int):
    """How many vectors (or, with ``probes``, queries) each leaf gets from a task: at most one row per leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest.value.leaves, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(0)).astype(np.float64)
                found = np.array([x for v in vectors for x in forest.value.search(v, probes)]) if probes else forest.value.leaf(vectors).ravel()
                total += np.bincount(found, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["leaf", "n"])

    return run


def _scored(rows: list, queries: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, gid, score): the k best vectors of one leaf for each of its queries. Both are lists of (gids, matrix)."""
    (gid, x), (query, q) = ([np.concatenate(c) for c in zip(*side, strict=True)] for side in (rows, queries))
    order = np.argsort(gid)
    gid, x = gid[order], x[order]
    margin = 4 * x.shape[1] * np.finfo(np.float64).eps * np.sqrt((x**2).sum(axis=1).max())
    out = []
    for a in range(0, len(q), 512):
        scores = q[a : a + 512] @ x.T
        # Sums of another order differ in the last places, so all within a rounding of the k-th are summed alike everywhere.
        # A comparison with NaN keeps, for sums that overflow.
        near = np.ones(scores.shape, dtype=bool)
        if len(x) > k:
            least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
            near = ~(scores < (least - margin * np.sqrt((q[a : a + 512] ** 2).sum(axis=1)))[:, None])
        row, place = np.nonzero(near)
        exact = np.concatenate([(x[place[b : b + 50_000]] * q[a + row[b : b + 50_000]]).sum(axis=1) for b in range(0, len(row), 50_000)])
        best = np.lexsort((place, -exact, row))
        row, place, exact = row[best], place[best], exact[best]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((query[a + row[best]], gid[place[best]], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _merged(lists: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One list of the k best for each query; a vector that several leaves gave counts once."""
    query, gid, score = (np.concatenate(c) for c in zip(*lists, strict=True))
    order = np.lexsort((gid, -score, query))
    query, gid, score = query[order], gid[order], score[order]
    new = np.r_[True, (query[1:] != query[:-1]) | (gid[1:] != gid[:-1])]
    query, gid, score = query[new], gid[new], score[new]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    best = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < k
    return query[best], gid[best], score[best]


def _best(k: int):
    """Rows (gid, leaf, chunk, block, side, v), sorted by the four in the middle: the k best of a task for each of its queries.

    A worker holds one chunk of a leaf's vectors and one of its queries, and lists of at most ``HELD`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, lists, held = None, ([], []), [], 0

        def batch_of(columns) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "gid", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(1, 5)], axis=1)
            gid, v = batch.column(0).to_numpy(), _matrix(batch.column(5)).astype(np.float64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
                if key != (place := tuple(keys[a, :3])):
                    if sides[0] and sides[1]:
                        lists.append(_scored(*sides, k))
                        held += len(lists[-1][0])
                    key, sides = place, ([], [])
                    if held > HELD:
                        lists = [_merged(lists, k)]
                        held = len(lists[0][0])
                        if held > HELD // 2:
                            yield batch_of(lists[0])
                            lists, held = [], 0
                sides[keys[a, 3]].append((gid[a:b], v[a:b]))
        if sides[0] and sides[1]:
            lists.append(_scored(*sides, k))
        if lists:
            yield batch_of(_merged(lists, k))

    return run


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = F.col(column).cast("array<double>").alias("v")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v).where("vec_id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common["n"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    store = scratch(spark)
    rows = store.store(usable(vectors), "vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.select("vec_id", "v", nth.alias("nth")).where(F.col("nth") <= k + 1)
    distinct = first.groupBy("v").agg(F.min("vec_id").alias("gid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = store.store(distinct.select("gid", "ids", "v"), "distinct")
    asking = rows.where(F.col("vec_id") % every == 0)
    of_query = store.store(asking.join(distinct.select(F.col("v").alias("w"), "gid"), F.col("v") == F.col("w")).select("vec_id", "gid"), "queries")

    n = distinct.count()
    sample = distinct.where(F.pmod(F.xxhash64("gid"), F.lit(1 << 20)) < min(1 << 20, int(SAMPLE * 1.1 / max(n, 1) * (1 << 20)) + 1))
    held = [r["v"] for r in sample.orderBy(F.xxhash64("gid")).limit(SAMPLE).select("v").collect()]
    points = np.array(held, dtype=np.float64).reshape(len(held), -1 if held else 0)
    forest = fit_forest(points, n, trees)
    probes = choose_probes(forest, points, k, recall) if len(points) > 1 else forest.leaves
    shared = spark.sparkContext.broadcast(forest)

    data = distinct.select("gid", "v")
    queries = store.store(data.join(of_query.select("gid").distinct(), "gid"), "asking")

    def counted(frame: DataFrame, probes: int) -> np.ndarray:
        out = np.zeros(forest.leaves, dtype=np.int64)
        for r in frame.select("v").mapInArrow(_leaf_counts(shared, probes), "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
            out[r["leaf"]] = r["n"]
        return out

    sizes, probing = counted(data, 0), counted(queries, probes)
    schema = "leaf int, chunk int, block int, gid long, v array<double>"
    place = ["leaf", "chunk", "block", "side"]
    left = data.mapInArrow(_placed(shared, sizes, probing, 0), schema).withColumn("side", F.lit(0))
    right = queries.mapInArrow(_placed(shared, sizes, probing, probes), schema).withColumn("side", F.lit(1))
    met = left.unionByName(right).select("gid", *place, "v").repartition(*place[:3]).sortWithinPartitions(*place)
    found = met.mapInArrow(_best(k + 1), "query long, gid long, score double").distinct()

    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "gid")
    found = found.select("*", F.row_number().over(by_score).alias("nth")).where(F.col("nth") <= k + 1)
    listed = found.join(distinct.select("gid", "ids"), "gid").select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.select("*", F.row_number().over(by_score).alias("nth")).where(F.col("nth") <= k + 1)
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    met = of_query.withColumnRenamed("vec_id", "query_id").join(lists, F.col("gid") == F.col("query"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = met.select("query_id", F.posexplode(others).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")
