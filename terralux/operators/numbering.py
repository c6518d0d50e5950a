"""Row numbers over a scene without sorting a scene in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hierarchical_row_number(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based number by ``order`` within ``keys``; (*keys, *order) is unique.

    Counts per prefix of ``order`` are cumulated inside the next shorter prefix, so every
    window holds the distinct values of one ordering column under one prefix, never all rows
    of a key.
    """
    levels = []
    counts = df.select(*keys, *order).withColumn("_n", F.lit(1).cast("bigint"))
    for depth in range(len(order), 0, -1):
        prefix = order[: depth - 1]
        line = W.partitionBy(*keys, *prefix).orderBy(order[depth - 1]).rowsBetween(W.unboundedPreceding, -1)
        offset = F.coalesce(F.sum("_n").over(line), F.lit(0))
        levels.append(
            (keys + order[:depth], counts.withColumn(f"_o{depth}", offset).drop("_n"), f"_o{depth}")
        )
        counts = counts.groupBy(*keys, *prefix).agg(F.sum("_n").alias("_n"))
    numbered = df
    for join_keys, offsets, _ in reversed(levels):
        numbered = numbered.join(offsets, join_keys)
    total = reduce(lambda a, b: a + b, (F.col(name) for *_, name in levels))
    return numbered.withColumn(out, total + 1).drop(*(name for *_, name in levels))
