"""8-connected regions (R2): block-local labels, then star contraction across blocks.

A cell's label is the position of a cell, ``row << 24 | col``; the least label of a region
is its first cell in raster order, which is also what R3 numbers by.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.session import cut, discard, spread

BLOCK = 128
COL_BITS = 24
MAX_ROUNDS = 100


def position(row: Column, col: Column) -> Column:
    return F.shiftleft(row.cast("bigint"), COL_BITS) + col.cast("bigint")


def position_row(label: Column) -> Column:
    return F.shiftright(label, COL_BITS).cast("int")


def position_col(label: Column) -> Column:
    return (label.bitwiseAND((1 << COL_BITS) - 1)).cast("int")


def _label_block(block: pd.DataFrame) -> pd.DataFrame:
    """Least member position of each 8-connected region inside one block of at most BLOCK^2 cells."""
    r = block["row"].to_numpy(dtype=np.int64)
    c = block["col"].to_numpy(dtype=np.int64)
    if r.min() < 0 or c.min() < 0 or c.max() >= 1 << COL_BITS:
        raise ValueError(f"rows and columns start at 0, and columns end below 2**{COL_BITS}")
    grid = np.full((r.max() - r.min() + 3, c.max() - c.min() + 3), -1, dtype=np.int64)
    at_r, at_c = r - r.min() + 1, c - c.min() + 1
    order = np.lexsort((c, r))
    at_r, at_c = at_r[order], at_c[order]
    grid[at_r, at_c] = np.arange(order.size)
    parent = np.arange(order.size)
    # Links to the four later neighbours of each cell, as index pairs.
    links = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other = grid[at_r + dr, at_c + dc]
        has = other >= 0
        links.append(np.stack([np.flatnonzero(has), other[has]]))
    a, b = np.concatenate(links, axis=1)
    while True:
        pa, pb = parent[a], parent[b]
        low, high = np.minimum(pa, pb), np.maximum(pa, pb)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped
    first = order[parent]
    label = np.empty(order.size, dtype=np.int64)
    label[order] = (r[first] << COL_BITS) + c[first]
    return pd.DataFrame({"scene_id": block["scene_id"], "row": block["row"], "col": block["col"], "label": label})


def block_labels(mask: DataFrame) -> DataFrame:
    """Mask cells (scene_id, row, col) with the label of their region inside their block."""
    blocked = mask.select(
        "scene_id",
        "row",
        "col",
        F.expr(f"row div {BLOCK}").alias("_br"),
        F.expr(f"col div {BLOCK}").alias("_bc"),
    )
    return spread(blocked, "scene_id", "_br", "_bc").groupBy("scene_id", "_br", "_bc").applyInPandas(
        _label_block, "scene_id STRING, row INT, col INT, label BIGINT"
    )


def seam_edges(labelled: DataFrame) -> DataFrame:
    """Label pairs that touch across a block border, each once. Only rim cells travel."""
    last = BLOCK - 1
    rim = labelled.filter(
        (F.col("row") % BLOCK).isin(0, last) | (F.col("col") % BLOCK).isin(0, last)
    )
    steps = F.array(
        *(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)))
    )

    def block(p: Column) -> Column:
        return F.floor(p / BLOCK)

    outward = (
        rim.withColumn("d", F.explode(steps))
        .withColumns({"row2": F.col("row") + F.col("d.dr"), "col2": F.col("col") + F.col("d.dc")})
        .filter((block(F.col("row")) != block(F.col("row2"))) | (block(F.col("col")) != block(F.col("col2"))))
        .select("scene_id", F.col("row2").alias("row"), F.col("col2").alias("col"), F.col("label").alias("u"))
    )
    met = outward.join(rim.select("scene_id", "row", "col", F.col("label").alias("v")), ["scene_id", "row", "col"])
    return met.select("scene_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u's neighbourhood."""
    both = edges.unionByName(edges.select("scene_id", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("scene_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u")
        .join(least, ["scene_id", "u"])
        .select("scene_id", F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is linked to the least of them."""
    least = edges.groupBy("scene_id", "u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(least, ["scene_id", "u"])
        .filter("v != m")
        .select("scene_id", F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """(scene_id, u, v) with u > v to (scene_id, label, region): the least label of each component.

    Alternating large-star and small-star (Kiveris et al. 2014). Minima are combined before
    the shuffle and joined back, so no neighbourhood is gathered in one task. Each round is
    written out; the driver sees a count and a hash.
    """
    current = cut(edges, "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("scene_id", "u", "v").cast("decimal(38,0)"))).first()

    seen = mark(current)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        following = cut(_small_star(_large_star(current)), "edges")
        discard(current)
        current, now = following, mark(following)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("regions did not settle")
    return current.select("scene_id", F.col("u").alias("label"), F.col("v").alias("region"))


def label_regions(mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R2: (cells with block labels, region of every block label).

    The second table has one row per block-local region and is what per-region work should
    start from: it is orders of magnitude smaller than the cells, and joining cells to it by
    block label meets no hot key however large a region is.
    """
    labelled = cut(block_labels(mask), "labels")
    merged = contract(seam_edges(labelled))
    pieces = labelled.groupBy("scene_id", "label").agg(
        F.count("*").alias("cells"),
        F.min("row").alias("rmin"),
        F.max("row").alias("rmax"),
        F.min("col").alias("cmin"),
        F.max("col").alias("cmax"),
    )
    regions = pieces.join(merged, ["scene_id", "label"], "left").withColumn(
        "region", F.coalesce("region", "label")
    )
    return labelled, regions


def region_cells(mask: DataFrame) -> DataFrame:
    """R2: mask cells with ``region``, the position of the region's first cell."""
    labelled, regions = label_regions(mask)
    return labelled.join(regions.select("scene_id", "label", "region"), ["scene_id", "label"]).drop("label")
