"""Exact quantiles per scene without gathering a scene in one task.

A first aggregate counts the values in sparse bins, 2**BIN_BITS for every power of two of their magnitude, so it needs no
range and is combined on the map side. Summed up in order, the counts name the bins that hold a wanted rank.
A second aggregate counts the different values of these bins only. A bin holds values that agree in their sign, exponent and
first BIN_BITS binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terralux.functions.bind import bind
from terralux.session import cut

BIN_BITS = 14
#: Magnitudes below 2**-LEAST share the bin of zero.
LEAST = 1000


def with_bin(values: DataFrame) -> DataFrame:
    """Adds ``_bin``, a whole number that never decreases with ``v``: its exponent and first binary digits."""
    guessed = values.withColumn("_m", F.abs("v")).withColumn("_e", F.floor(F.log2("_m")))
    # The logarithm may round across a power of two.
    over = F.when(F.col("_m") < F.pow(F.lit(2.0), F.col("_e")), -1).when(F.col("_m") >= F.pow(F.lit(2.0), F.col("_e") + 1), 1).otherwise(0)
    placed = guessed.withColumn("_e", F.col("_e") + over)
    digits = (F.col("_e") + (LEAST + 1)) * (1 << BIN_BITS) + (F.col("_m") * F.pow(F.lit(2.0), -F.col("_e")) - 1.0) * (1 << BIN_BITS)
    tiny = F.col("_m") < 2.0**-LEAST
    # Bound, so that no plan above repeats the steps.
    return bind(placed, {"_bin": F.when(tiny, F.lit(0).cast("bigint")).otherwise(digits.cast("bigint") * F.signum("v").cast("bigint"))}).drop("_m", "_e")


def quantiles(df: DataFrame, keys: list[str], value: str, fractions: list[float], stored: bool = False) -> DataFrame:
    """(*keys, q INT, threshold DOUBLE): linear interpolation between order statistics.

    ``stored`` writes keys and values first, for a value that is costly to compute. Missing values do not count.
    """
    # Bound, as the bin looks at a value several times.
    values = bind(df.select(*keys, value), {"v": F.col(value).cast("double")}).select(*keys, "v")
    if stored:
        values = cut(values, "values")
    binned = with_bin(values)
    bins = cut(binned.groupBy(*keys, "_bin").agg(F.count("v").alias("n")).filter("n > 0"), "bins")
    # Zero-based ranks needed by each fraction: floor and the one after it.
    total = bins.groupBy(*keys).agg(F.sum("n").alias("_total"))
    wanted = (
        total.select(*keys, "_total", F.posexplode(F.array(*((F.col("_total") - 1) * F.lit(float(f)) for f in fractions))).alias("q", "h"))
        .withColumn("below", F.floor("h"))
        .select(*keys, "q", (F.col("h") - F.col("below")).alias("t"), F.explode(F.array(F.col("below"), F.least(F.col("below") + 1, F.col("_total") - 1))).alias("rank"))
    )
    first = _locate(wanted, bins, keys, "_bin")
    hot = first.select(*keys, "_bin").distinct()
    inner = binned.join(hot, [*keys, "_bin"], "left_semi")
    final = _locate(first, inner.groupBy(*keys, "_bin", "v").agg(F.count("*").alias("n")), [*keys, "_bin"], "v")
    return (
        final.groupBy(*keys, "q", "t")
        .agg(F.min("v").alias("a"), F.max("v").alias("b"))
        .select(*keys, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("threshold"))
    )


def _locate(wanted: DataFrame, counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The bucket holding each wanted rank, and the rank left inside it."""
    order = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    cumulated = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return (
        wanted.join(cumulated, keys)
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        .withColumn("rank", F.col("rank") - F.col("before"))
        .drop("before", "n")
    )
