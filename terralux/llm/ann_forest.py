"""Nearest neighbours by cosine: a forest of random-projection trees and exact reranking.

Each tree splits at the median of a random projection (the difference of two random vectors of the
node) until a leaf stands for about ``LEAF_ROWS`` rows. The forest is fitted on a sample of at most about
``SAMPLE_ROWS`` vectors; every vector is indexed, one leaf a tree. A query walks all trees through
one priority queue ordered by the margin to the splits on the way, until the leaves it
opened, over all trees, stand for ``SEARCH_ROWS`` rows (a leaf's rows count once a tree). The budget does not depend on
the table, so that the work grows with the number of queries. Vectors without structure inside their clusters need more as
the table grows; ``search_rows`` is the parameter for it. Within each opened leaf, all members are scored exactly,
in double precision, and each leaf hands on the query's nearest; the best over all leaves are the
result. With more rows than the sample can tell apart, leaves grow; ``sample_rows`` is the parameter for it. The forest,
which every executor holds, stays under about ``FOREST_BYTES``: with many dimensions the sample is smaller.

Equal vectors are one entry with its smallest ids, as many as any query can return. Leaves of more
than ``CHUNK_ROWS`` entries are dealt to several tasks; the queries of the leaf go to each.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another
dimension than most of the searched table. Null ids take no part. Repeated rows are different candidates of the same id only if
their vectors differ; equal rows count once. Ties go to the smaller id. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terralux.llm.common import cut, small_batches

NEAREST = 5
TREES = 20
LEAF_ROWS = 150
#: Rows that a search's leaves stand for.
SEARCH_ROWS = 24_000
SAMPLE_ROWS = 60_000
FOREST_BYTES = 128_000_000
LEAST_SAMPLE = 8
CHUNK_ROWS = 20_000


class Tree:
    """Arrays of nodes: direction, threshold and children; a child below 0 is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.directions, self.thresholds, self.children, self.sizes = [], [], [], []
        self._grow(sample, leaf, rng)
        self.directions = np.array(self.directions, dtype=np.float32).reshape(-1, sample.shape[1])
        self.thresholds = np.array(self.thresholds, dtype=np.float32)
        self.children = np.array(self.children, dtype=np.int64).reshape(-1, 2)
        self.sizes = np.array(self.sizes)

    def _leaf(self, n: int) -> int:
        self.sizes.append(n)
        return -len(self.sizes)

    def _grow(self, sample: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        self.root = 0
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = None
            if len(rows) > leaf:
                for _ in range(4):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    direction = a - b
                    value = sample[rows] @ direction
                    threshold = np.float32(np.median(value))
                    right = value > threshold
                    if 0.1 < right.mean() < 0.9:
                        node = len(self.thresholds)
                        self.directions.append(direction)
                        self.thresholds.append(threshold)
                        self.children.append([0, 0])
                        todo += [(rows[~right], node, 0), (rows[right], node, 1)]
                        break
            child = self._leaf(len(rows)) if node is None else node
            if parent < 0:
                self.root = child
            else:
                self.children[parent][side] = child

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        at = np.full(len(vectors), self.root, dtype=np.int64)
        live = np.flatnonzero(at >= 0)
        while len(live):
            node = at[live]
            side = np.einsum("ij,ij->i", vectors[live], self.directions[node]) > self.thresholds[node]
            at[live] = self.children[node, side.astype(np.int64)]
            live = live[at[live] >= 0]
        return -1 - at


class Forest:
    def __init__(self, sample: np.ndarray, n_rows: int, trees: int, leaf_rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.scale = max(1.0, n_rows / max(1, len(sample)))
        leaf = max(LEAST_SAMPLE, int(leaf_rows / self.scale))
        self.trees = [Tree(sample, leaf, rng) for _ in range(trees)]
        self.base = np.cumsum([0] + [len(t.sizes) for t in self.trees])

    def index(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf numbers, vectors x trees."""
        return np.stack([t.leaves(vectors) + b for t, b in zip(self.trees, self.base[:-1], strict=True)], axis=1)

    def search(self, query: np.ndarray, rows: float) -> list[int]:
        """Leaves in order of their margin over all trees, until they stand for ``rows`` rows."""
        queue = [(-np.inf, t, tree.root) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        margins = [tree.directions @ query - tree.thresholds for tree in self.trees]
        found, seen = [], 0.0
        while queue and seen < rows:
            worst, t, node = heapq.heappop(queue)
            tree = self.trees[t]
            while node >= 0:
                margin = float(margins[t][node])
                near = int(margin > 0)
                heapq.heappush(queue, (max(worst, abs(margin)), t, int(tree.children[node, 1 - near])))
                node = int(tree.children[node, near])
            found.append(int(self.base[t]) - 1 - node)
            seen += tree.sizes[-1 - node] * self.scale
        return found


def dimension(rows: DataFrame) -> int:
    """The commonest number of components, the smaller of equally common ones; 0 for an empty table."""
    size = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return size["d"] if size else 0


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows of any dimension that take part; components stay single if they are."""
    kind = "float" if embeddings.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows of others, in double precision."""
    query, vectors = query / np.abs(query).max(), vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _nearest_in_leaf(k: int):
    """Each query's nearest among the entries of a leaf."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            queries, vectors = _matrix(left.column("vector")), _matrix(right.column("vector"))
            ids = right.column("ids").to_pylist()
            close = _unit(queries) @ _unit(vectors).T
            # One more than k entries, as one can be the query itself; and whatever ties with the last.
            take = min(k + 1, len(ids))
            limit = np.partition(close, len(ids) - take, axis=1)[:, len(ids) - take] - 1e-9
            for row, query_id in enumerate(left.column("query_id").to_pylist()):
                index = np.flatnonzero(close[row] >= limit[row])
                score = cosines(queries[row], vectors[index])
                listed = [(-s, i) for s, e in zip(score.tolist(), index.tolist(), strict=True) for i in ids[e] if i != query_id]
                out += [(query_id, i, -s) for s, i in heapq.nsmallest(k, listed)]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    return run


def nearest(
    embeddings: DataFrame,
    queries: DataFrame,
    k: int = NEAREST,
    trees: int = TREES,
    search_rows: float = SEARCH_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``queries``."""
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = usable(embeddings)
    d = dimension(rows)
    rows = rows.where(F.size("vector") == d)
    # Equal vectors: the k + 1 smallest ids, cut off in each task before the shuffle.
    numbered = rows.distinct().withColumn("place", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    entries = cut(numbered.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    asked = usable(queries).where(F.size("vector") == d).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    n = entries.count()
    # A tree has at most about a node for every LEAST_SAMPLE / 2 rows of the sample.
    fitted = min(sample_rows, FOREST_BYTES * LEAST_SAMPLE // (2 * 4 * max(1, d * trees)))
    part = F.pmod(F.xxhash64("ids"), F.lit(1_000_000)) < min(1.0, fitted / max(1, n)) * 1_000_000
    sample = entries.where(part).select("vector").orderBy("vector").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = spark.sparkContext.broadcast(Forest(_unit(_matrix(sample.column(0))).astype(np.float32), n, trees, LEAF_ROWS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = forest.value.index(_unit(_matrix(batch.column(0))).astype(np.float32))
                at = pa.array(np.repeat(np.arange(len(leaf)), leaf.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), batch.column(0).take(at), batch.column(1).take(at)], ["leaf", "vector", "ids"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [forest.value.search(v, search_rows) for v in _unit(_matrix(batch.column(1))).astype(np.float32)]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                leaves = pa.array(np.concatenate([np.array(x, dtype=np.int64) for x in found]))
                yield pa.RecordBatch.from_arrays([leaves, batch.column(0).take(at), batch.column(1).take(at)], ["leaf", "query_id", "vector"])

    kind = entries.schema["vector"].dataType.simpleString()
    indexed = cut(entries.select("vector", "ids").mapInArrow(index, f"leaf long, vector {kind}, ids array<long>"), "leaves")
    # Chunks of leaves that are larger than a task should hold; their number is bounded by the forest's.
    large = {r["leaf"]: -(-r["n"] // CHUNK_ROWS) for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK_ROWS).collect()}
    chunks = F.coalesce(F.create_map(*(F.lit(x) for pair in large.items() for x in pair))[F.col("leaf")], F.lit(1)) if large else F.lit(1)
    members = indexed.withColumn("chunk", F.pmod(F.xxhash64("ids"), chunks).cast("int"))
    wanted = asked.repartition(F.col("query_id")).mapInArrow(search, f"leaf long, query_id long, vector {kind}")
    wanted = wanted.withColumn("chunk", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    found = wanted.groupBy("leaf", "chunk").cogroup(members.groupBy("leaf", "chunk")).applyInArrow(_nearest_in_leaf(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
