"""Neighbour access on a cell table with one shuffle.

Cells are sent to square blocks, rim cells also to the blocks next door, so every cell
meets its neighbours inside one block. Both window passes (along rows, along columns) are
partitioned by a superset of the block key and need no further exchange, and no window
spans more than a block, however large or hot a scene is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 128


def _reach(position: str, before: int, after: int) -> Column:
    """Blocks along one axis whose cells look at this position."""
    p = F.col(position)
    return F.array_distinct(
        F.array(*(F.floor((p + d) / BLOCK).cast("int") for d in sorted({-after, 0, before})))
    )


def to_blocks(cells: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Replicate rim cells: adds _br, _bc and _own (whether the block owns the cell)."""
    return (
        cells.withColumn("_br", F.explode(_reach("row", before, after)))
        .withColumn("_bc", F.explode(_reach("col", before, after)))
        .withColumn(
            "_own",
            (F.col("_br") == F.floor(F.col("row") / BLOCK)) & (F.col("_bc") == F.floor(F.col("col") / BLOCK)),
        )
        .repartition(*keys, "_br", "_bc")
    )


def _shift(blocked_keys: list[str], fixed: str, moving: str, value: str, offset: int) -> Column:
    """Value at ``moving + offset`` on the same line; NULL when there is no such cell."""
    line = W.partitionBy(*blocked_keys, fixed).orderBy(moving)
    at = F.lead if offset > 0 else F.lag
    near = at(F.col(value), abs(offset)).over(line)
    place = at(F.col(moving), abs(offset)).over(line)
    return F.when(place == F.col(moving) + offset, near)


def with_cross(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds the four edge neighbours of ``value`` as v_w, v_e, v_n and v_s; NULL outside the grid."""
    blocked = [*keys, "_br", "_bc"]
    return (
        to_blocks(cells, keys, 1, 1)
        .withColumns(
            {
                "v_w": _shift(blocked, "row", "col", value, -1),
                "v_e": _shift(blocked, "row", "col", value, 1),
            }
        )
        .withColumns(
            {
                "v_n": _shift(blocked, "col", "row", value, -1),
                "v_s": _shift(blocked, "col", "row", value, 1),
            }
        )
        .filter("_own")
        .drop("_br", "_bc", "_own")
    )


def with_patch(cells: DataFrame, keys: list[str], value: str, before: int, after: int, out: str = "patch") -> DataFrame:
    """Adds the (before+1+after) x (before+1+after) patch of ``value`` around each cell, row-major.

    Positions without a cell are NULL. The grid must hold one row per cell of its extent.
    """
    blocked = [*keys, "_br", "_bc"]
    offsets = range(-before, after + 1)

    def along(fixed: str, moving: str, source: str, d: int) -> Column:
        return F.col(source) if d == 0 else _shift(blocked, fixed, moving, source, d)

    marked = to_blocks(cells, keys, before, after)
    lines = marked.withColumn("_line", F.array(*(along("row", "col", value, d) for d in offsets)))
    empty = F.array(*(F.lit(None).cast("double") for _ in offsets))
    return (
        lines.withColumn(
            out,
            F.flatten(F.array(*(F.coalesce(along("col", "row", "_line", d), empty) for d in offsets))),
        )
        .filter("_own")
        .drop("_br", "_bc", "_own", "_line")
    )
