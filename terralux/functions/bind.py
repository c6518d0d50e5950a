"""Evaluate an expensive expression once.

Catalyst may copy a projected expression into every place that uses it, above all into
filters pushed below the projection. A generator's output is a plain attribute for
everything after it, and a lambda variable is one inside a higher-order function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose new columns are computed once per row."""
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select(*kept, F.inline(F.array(row)))
