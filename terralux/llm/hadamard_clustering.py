"""Centroid clustering with an exact progressive search over Walsh-Hadamard coefficients.

Components become integers, floor(256 * x). The transform of 64 integers is an exact integer
transform, and the squared differences of the coefficients of two vectors add up to 64 times their squared
distance. Coefficients are ordered coarse to fine (by their number of sign changes) and summed in
``STEPS``. After each step the centroid with the least sum so far is finished, which bounds the
vector's distance; centroids whose sum is strictly above the bound are out. What is left after the last step has
all 64 coefficients, and equal distances go to the smaller number.

A round is one pass: tasks assign their vectors and hand on one row of exact sums per centroid; the
driver holds the ``k`` centroids only, so a cluster with a third of all vectors costs ``k`` rows a task.
Vectors are written once, as integers.

Vectors that are null, of another length, or hold null or non-finite components take no part; neither do those
with a component of magnitude ``LARGEST`` or more, whose distances do not fit a long. Rows with equal ids are vectors
of their own; among equal starting hashes the smaller vector comes first. A row without id is
assigned but starts no centroid. With fewer than ``k`` vectors every one is a centroid; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux.llm.common import cut

DIMENSION = 64
K = 40
ROUNDS = 5
SEED = 2
SCALE = 256
#: 2**19 * 256 = 2**27: 64 squared differences of such integers still fit 63 bits.
LARGEST = float(2**19)
#: Below this magnitude the squared coefficient differences fit 63 bits; above it Python's integers are used.
PLAIN = 2**21
#: Coefficients that are summed before each elimination.
STEPS = (8, 16, 32, 64)
#: Vectors that are searched together.
BLOCK = 4_096


def _sequency_order(n: int) -> np.ndarray:
    rows = hadamard(np.eye(n, dtype=np.int64))
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(axis=1), kind="stable")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in natural order, by sums and differences."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        h *= 2
    return x


ORDER = _sequency_order(DIMENSION)


class Search:
    """Nearest centroid of any vectors, exactly."""

    def __init__(self, centroids: np.ndarray):
        self.largest = int(np.abs(centroids).max(initial=0))
        self.centroids = centroids

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it."""
        plain = max(self.largest, int(np.abs(vectors).max(initial=0))) < PLAIN
        kind = np.int64 if plain else object
        c = hadamard(self.centroids.astype(kind))[:, ORDER]
        x = hadamard(vectors.astype(kind))[:, ORDER]
        rows, cents = (a.ravel() for a in np.indices((len(x), len(c))))
        total = np.zeros(len(rows), dtype=kind)
        done = 0
        for step in STEPS:
            delta = x[rows, done:step] - c[cents, done:step]
            total = total + (delta * delta).sum(axis=1)
            done = step
            if done == DIMENSION:
                break
            first = np.searchsorted(rows, np.arange(len(x)))
            least = np.minimum.reduceat(total, first)
            # The leader's remaining coefficients turn its sum into a bound.
            leads = np.flatnonzero(total == least[rows])
            leads = leads[np.unique(rows[leads], return_index=True)[1]]
            rest = x[:, done:] - c[cents[leads], done:]
            bound = least + (rest * rest).sum(axis=1)
            live = total <= bound[rows]
            rows, cents, total = rows[live], cents[live], total[live]
        first = np.searchsorted(rows, np.arange(len(x)))
        least = np.minimum.reduceat(total, first)
        ends = np.flatnonzero(total == least[rows])
        ends = ends[np.unique(rows[ends], return_index=True)[1]]
        return cents[ends].astype(np.int32), (total[ends] // DIMENSION).astype(np.int64)


def integer_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the integer components of the vectors that take part, as little-endian 32-bit integers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            full = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == DIMENSION)
            column, ids = column.take(pa.array(full)), batch.column(0).take(pa.array(full))
            # Null components become not-a-number here, so one test finds both.
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMENSION)
            good = np.flatnonzero((np.abs(x) < LARGEST).all(axis=1))
            whole = np.floor(SCALE * x[good]).astype("<i4")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good)), pa.array([r.tobytes() for r in whole], pa.binary())], ["vec_id", "v"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>")).mapInArrow(convert, "vec_id long, v binary")


def _rows(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype="<i4").reshape(-1, DIMENSION).astype(np.int64)


def starting_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in the order of the hashes."""
    hashed = vectors.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    found = hashed.orderBy("h", "v").limit(k).collect()
    return _rows(pa.array([bytes(r["v"]) for r in found], pa.binary()))


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of all vectors."""
    search = Search(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                some = batch.slice(k, BLOCK)
                cluster, distance = search.nearest(_rows(some.column(1)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def updated(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means; a centroid without vectors stays."""
    search = Search(centroids)
    names = [f"s{i}" for i in range(DIMENSION)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), DIMENSION), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                block = _rows(batch.slice(k, BLOCK).column(1))
                cluster, _ = search.nearest(block)
                np.add.at(total, cluster, block)
                count += np.bincount(cluster, minlength=len(count))
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(DIMENSION))], ["cluster", "n", *names])

    partial = vectors.select("vec_id", "v").mapInArrow(sums, f"cluster long, n long, {', '.join(f'{c} long' for c in names)}")
    moved = centroids.copy()
    # k rows.
    for row in partial.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():
        moved[row["cluster"]] = [row[c] // row["n"] for c in names]
    return moved


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, vector: str = "embedding") -> DataFrame:
    """Every vector's cluster and squared distance, the sums of these, and the hash of its centroid."""
    spark = embeddings.sparkSession
    vectors = cut(integer_vectors(embeddings, vector), "vectors")
    centroids = starting_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = updated(vectors, centroids)
    assigned = cut(assign(vectors, centroids), "assigned")
    # k rows.
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(inertia.values())
    fits = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame(
        [(c, fits(inertia.get(c, 0)), fits(whole), digest[c]) for c in range(len(centroids))],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
