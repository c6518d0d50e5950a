"""Distance to the nearest feature cell (J10): an exact separable transform.

Pass 1 (windows along columns) finds the vertical gap to the closest feature cell, pass 2
takes the lower envelope of the resulting parabolas along rows (Felzenszwalb and
Huttenlocher 2012). A grid in one UTM zone at 50 m or coarser is at most 20,000 columns
wide, so a strip of rows is a bounded group whatever the size of its scene. Cells never
meet features in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STRIP_ROWS = 32

# Larger than any squared distance in cells within one zone, exact in a double.
_NONE = 1e13


def feature_flags(cells: DataFrame, features: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Cells with one boolean per feature kind, from (scene_id, row, col, kind)."""
    hits = features.groupBy("scene_id", "row", "col").agg(
        *(F.bool_or(F.col("kind") == k).alias(f"is_{k}") for k in kinds)
    )
    joined = cells.join(hits, ["scene_id", "row", "col"], "left")
    return joined.withColumns({f"is_{k}": F.coalesce(F.col(f"is_{k}"), F.lit(False)) for k in kinds})


def _vertical_gap(flag: str) -> Column:
    lines = W.partitionBy("scene_id", "col")
    here = F.when(F.col(flag), F.col("row"))
    # Two sorts of one partitioning: a frame that only looks back is linear, one that
    # looks ahead to the end is quadratic.
    above = F.last(here, ignorenulls=True).over(lines.orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    below = F.last(here, ignorenulls=True).over(
        lines.orderBy(F.desc("row")).rowsBetween(W.unboundedPreceding, 0)
    )
    return F.least(F.col("row") - above, below - F.col("row"))


def _envelope(gap2: np.ndarray) -> np.ndarray:
    """Row-wise min over c' of (c - c')^2 + gap2[c'], for all rows at once.

    One pass builds each row's stack of parabolas, one pass reads it; the rows of the strip
    move in lockstep, so the Python loop runs per column, not per cell.
    """
    rows, width = gap2.shape
    every = np.arange(rows)
    top = np.zeros(rows, dtype=np.int64)
    site = np.zeros((rows, width), dtype=np.int64)
    start = np.full((rows, width + 1), np.inf)
    start[:, 0] = -np.inf
    for q in range(1, width):
        new = gap2[:, q] + q * q
        active = every
        cross = np.empty(rows)
        while active.size:
            v = site[active, top[active]]
            cross[active] = (new[active] - (gap2[active, v] + v * v)) / (2.0 * (q - v))
            active = active[cross[active] <= start[active, top[active]]]
            top[active] -= 1
        top += 1
        site[every, top] = q
        start[every, top] = cross
        start[every, top + 1] = np.inf
    out = np.empty((rows, width))
    top[:] = 0
    for c in range(width):
        ahead = start[every, top + 1] < c
        while ahead.any():
            top[ahead] += 1
            ahead = start[every, top + 1] < c
        v = site[every, top]
        out[:, c] = (c - v) ** 2 + gap2[every, v]
    return out


def distances(cells: DataFrame, flags: Sequence[str], resolution: Column) -> DataFrame:
    """Cells with ``dist_<kind>`` in metres for each ``is_<kind>`` flag; NULL in a scene without any.

    Cells of a scene form full rows (a grid); any number of kinds shares the two passes.
    """
    names = [f.removeprefix("is_") for f in flags]
    gaps = cells.select(
        "scene_id",
        "row",
        "col",
        resolution.cast("double").alias("resolution_m"),
        *(_vertical_gap(f).cast("double").alias(f"gap_{n}") for f, n in zip(flags, names, strict=True)),
    )
    schema = "scene_id STRING, row INT, col INT, " + ", ".join(f"dist_{n} DOUBLE" for n in names)

    def strip(block: pd.DataFrame) -> pd.DataFrame:
        r = block["row"].to_numpy()
        c = block["col"].to_numpy()
        rows, at_row = np.unique(r, return_inverse=True)
        first = c.min()
        width = int(c.max() - first) + 1
        result = {"scene_id": block["scene_id"], "row": block["row"], "col": block["col"]}
        for n in names:
            gap2 = np.full((rows.size, width), _NONE)
            gap2[at_row, c - first] = np.nan_to_num(block[f"gap_{n}"].to_numpy() ** 2, nan=_NONE)
            squared = _envelope(gap2)[at_row, c - first]
            metres = np.sqrt(squared) * block["resolution_m"].to_numpy()
            result[f"dist_{n}"] = pd.Series(np.where(squared >= _NONE, np.nan, metres), index=block.index)
        return pd.DataFrame(result)

    strips = gaps.withColumn("_strip", F.expr(f"row div {STRIP_ROWS}")).groupBy("scene_id", "_strip")
    measured = strips.applyInPandas(lambda pdf: strip(pdf), schema)
    return measured.withColumns(
        {f"dist_{n}": F.nanvl(f"dist_{n}", F.lit(None).cast("double")) for n in names}
    )
