"""Ranges and sensitivities of a formula over uncertain inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Fixed value: more inputs than this are refused (2^k corners).
MAX_PARAMS = 12

Formula = Callable[[dict[str, Column]], Column]


def widen(params: DataFrame, names: list[str], key: str = "case_id") -> DataFrame:
    """Long inputs (case_id, name, low, base, high) to one row per case (<name>_low, …)."""
    ends = [
        F.max(F.when(F.col("name") == n, F.col(end))).alias(f"{n}_{end}") for n in names for end in ("low", "base", "high")
    ]
    return params.groupBy(key).agg(*ends)


def propagate(cases: DataFrame, formula: Formula, names: list[str]) -> DataFrame:
    """Base, least and greatest output over all low/high corners, per case.

    The corners are bits of a counter inside the row: nothing is crossed or shuffled.
    """
    if len(names) > MAX_PARAMS:
        raise ValueError(f"too many uncertain inputs ({len(names)} > {MAX_PARAMS})")

    def corner(i: Column) -> Column:
        picked = {
            n: F.when(F.shiftright(i, pos).bitwiseAND(1) == 1, F.col(f"{n}_high")).otherwise(F.col(f"{n}_low"))
            for pos, n in enumerate(names)
        }
        return formula(picked)

    outputs = F.transform(F.sequence(F.lit(0), F.lit(2 ** len(names) - 1)), corner)
    base = formula({n: F.col(f"{n}_base") for n in names})
    return cases.withColumns({"base": base, "_out": outputs}).withColumns(
        {
            "low": F.least(F.array_min("_out"), F.col("base")),
            "high": F.greatest(F.array_max("_out"), F.col("base")),
        }
    ).drop("_out")


def tornado(cases: DataFrame, formula: Formula, names: list[str], key: str = "case_id") -> DataFrame:
    """One input at a time, largest swing first, input order on ties (at most 12 rows per case)."""
    base = {n: F.col(f"{n}_base") for n in names}
    rows = F.array(
        *(
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(n).alias("parameter"),
                formula({**base, n: F.col(f"{n}_low")}).alias("low_output"),
                formula({**base, n: F.col(f"{n}_high")}).alias("high_output"),
            )
            for pos, n in enumerate(names)
        )
    )
    spread = cases.select(key, F.inline(rows)).withColumn("swing", F.abs(F.col("high_output") - F.col("low_output")))
    order = W.partitionBy(key).orderBy(F.desc("swing"), "pos")
    return spread.withColumn("position", F.row_number().over(order)).drop("pos")
