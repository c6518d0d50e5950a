"""Weights from expert comparison matrices (P45-P48), many matrices at once.

A matrix has at most ten criteria, so it is folded into one row; checks are higher-order
functions inside it and the powers of the matrices are taken over Arrow batches of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralux.functions.bind import bind

# Random index for n = 1..10, acceptance limit, tolerances.
RANDOM_INDEX = (0.0, 0.0, 0.58, 0.90, 1.12, 1.24, 1.32, 1.41, 1.45, 1.49)
MAX_CR = 0.10
MAX_SIZE = 10
MIN_SIZE = 2
#: Squarings of a matrix before its weights count as unsettled.
SQUARINGS = 24
STEP_TOLERANCE = 1e-10
DIAGONAL_TOLERANCE = 1e-9
RECIPROCAL_TOLERANCE = 1e-6


def fold(entries: DataFrame) -> DataFrame:
    """Entries (matrix_id, i, j, a) to (matrix_id, n, cells, m) with ``m`` row-major.

    Entries beyond the largest supported size are counted, not gathered.
    """
    kept = F.when((F.col("i") < MAX_SIZE) & (F.col("j") < MAX_SIZE), F.struct("i", "j", "a"))
    return entries.groupBy("matrix_id").agg(
        (F.greatest(F.max("i"), F.max("j")) + 1).alias("n"),
        F.count("*").alias("cells"),
        F.transform(F.array_sort(F.collect_set(kept)), lambda e: e["a"]).alias("m"),
    )


def _at(i: Column, j: Column) -> Column:
    return F.element_at("m", (i * F.col("n") + j + 1).cast("int"))


def _index(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def _any_pair(test) -> Column:
    index = _index(F.col("n"))
    return F.exists(index, lambda i: F.exists(index, lambda j: test(i, j)))


def with_faults(folded: DataFrame) -> DataFrame:
    """Adds ``fault``, the first structural rule a matrix breaks, or NULL."""
    n = F.col("n")
    whole = (F.col("cells") == n * n) & (F.size("m") == n * n)
    diagonal = F.exists(_index(n), lambda i: F.abs(_at(i, i) - 1.0) > DIAGONAL_TOLERANCE)
    reciprocal = _any_pair(lambda i, j: F.abs(_at(i, j) * _at(j, i) - 1.0) > RECIPROCAL_TOLERANCE)
    fault = (
        F.when(n < MIN_SIZE, F.lit("too_small"))
        .when(n > MAX_SIZE, F.lit("too_large"))
        .when(~whole, F.lit("not_square"))
        .when(F.exists("m", lambda a: a <= 0.0), F.lit("not_positive"))
        .when(diagonal, F.lit("diagonal"))
        .when(reciprocal, F.lit("not_reciprocal"))
    )
    return bind(folded, {"fault": fault})


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _times(w: Column) -> Column:
    """The matrix times a vector."""
    index = _index(F.col("n"))
    return F.transform(
        index, lambda i: _sum(F.zip_with(F.slice("m", (i * F.col("n") + 1).cast("int"), F.col("n").cast("int")), w, lambda a, b: a * b))
    )


@F.pandas_udf(T.StructType([T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("settled", T.BooleanType())]))
def _power_weights(m: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Powers of the matrices of an Arrow batch by repeated squaring, all of one size at a time.

    The columns of a power turn into multiples of the weights as the exponent doubles; a matrix stops when they agree.
    Entries are positive, so squaring cancels nothing and 2^SQUARINGS steps cost SQUARINGS products.
    """
    weights = pd.Series([None] * len(m), dtype=object)
    settled = np.zeros(len(m), dtype=bool)
    sizes = n.to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        power = np.stack(m.iloc[rows].to_numpy()).reshape(len(rows), size, size)
        moving = np.arange(len(rows))
        columns = np.empty_like(power)
        for _ in range(SQUARINGS + 1):
            now = power[moving]
            columns[moving] = now / now.sum(axis=1, keepdims=True)
            done = np.ptp(columns[moving], axis=2).max(axis=1) < STEP_TOLERANCE
            settled[rows[moving[done]]] = True
            moving = moving[~done]
            if not moving.size:
                break
            now = power[moving] / power[moving].max(axis=(1, 2), keepdims=True)
            power[moving] = now @ now
        for row, w in zip(rows, columns.mean(axis=2), strict=True):
            weights.iloc[row] = w / w.sum()
    return pd.DataFrame({"weights": weights, "settled": settled})


# Dozens of dependent products: batched, because Spark interprets higher-order functions.
# Non-deterministic, so that a filter on a result never repeats the call.
_power_weights = _power_weights.asNondeterministic()


def with_weights(valid: DataFrame) -> DataFrame:
    """Weights of the largest eigenvalue, that value, consistency index and ratio, and ``settled``.

    Rounding moves the weights by about 1e-16 over the relative gap to the next eigenvalue. ``settled`` is false where that gap is
    below about 2^-SQUARINGS, so that the weights of settled matrices are right to about 9 digits and others are marked.
    """
    found = _power_weights(F.col("m"), F.col("n"))
    ri = F.element_at(F.array(*(F.lit(v) for v in RANDOM_INDEX)), F.col("n").cast("int"))
    ratio = _sum(F.zip_with(_times(F.col("weights")), F.col("weights"), lambda a, w: F.when(w > 1e-15, a / w).otherwise(F.lit(0.0))))
    weighted = valid.withColumn("_w", found).withColumns({"weights": F.col("_w.weights"), "settled": F.col("_w.settled")}).drop("_w")
    return (
        bind(weighted, {"lambda_max": ratio / F.col("n")})
        .withColumn("ci", (F.col("lambda_max") - F.col("n")) / (F.col("n") - 1))
        .withColumn("cr", F.when(ri > 0.0, F.col("ci") / ri).otherwise(F.lit(0.0)))
        .withColumn("consistent", F.col("cr") <= MAX_CR)
    )


def with_worst_triple(valid: DataFrame) -> DataFrame:
    """The first triple (i, j, k) with the largest |a_ik - a_ij a_jk|, to 9 decimals; NULL below three criteria."""
    index = _index(F.col("n"))

    def triples(i: Column) -> Column:
        return F.flatten(
            F.transform(
                index,
                lambda j: F.transform(
                    index,
                    lambda k: F.when(
                        (i != j) & (k != i) & (k != j),
                        F.struct(
                            (-F.round(F.abs(_at(i, k) - _at(i, j) * _at(j, k)), 9)).alias("d"), i.alias("i"), j.alias("j"), k.alias("k")
                        ),
                    ),
                ),
            )
        )

    worst = F.array_min(F.array_compact(F.flatten(F.transform(index, triples))))
    return bind(valid, {"_t": worst}).withColumns(
        {"worst_i": F.col("_t.i"), "worst_j": F.col("_t.j"), "worst_k": F.col("_t.k")}
    ).drop("_t")


def analyze(entries: DataFrame) -> DataFrame:
    """P45-P48 for structurally valid matrices; the others are in :func:`rejected`."""
    return with_worst_triple(with_weights(with_faults(fold(entries)).filter("fault IS NULL")))


def strict(entries: DataFrame) -> DataFrame:
    """Only matrices with a consistency ratio of at most 0.10 and settled weights."""
    return analyze(entries).filter("consistent AND settled")


def rejected(entries: DataFrame) -> DataFrame:
    """(matrix_id, rule, cr, worst_i, worst_j, worst_k) of refused matrices."""
    broken = with_faults(fold(entries)).filter("fault IS NOT NULL").select("matrix_id", F.col("fault").alias("rule"))
    rule = F.when(F.col("settled"), "inconsistent").otherwise("unsettled")
    uneven = analyze(entries).filter("NOT (consistent AND settled)").select(
        "matrix_id", rule.alias("rule"), "cr", "worst_i", "worst_j", "worst_k"
    )
    return uneven.unionByName(broken, allowMissingColumns=True)
