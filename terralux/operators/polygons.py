"""Outlines of sites from their cells, for sites of any size.

Cells meet in blocks with a rim from next door, where the four cells around a corner say how the outline goes
on, so every side knows its follower. A block walks its sides into closed rings and into chains that leave it;
chains of a ring are joined by pointer jumping over their ends: first the least chain of each cycle, then the
distance to its end. A block never holds more than its cells, and the driver sees counts only. A ring is
one value of the result; everything before that is spread over its chains.

A hole belongs to the part whose cell lies above its first corner: the outline met going west from there is
the part's outer ring or a hole that starts further up, which is followed in turn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terralux.functions.geodesy import with_lonlat
from terralux.operators import stencil
from terralux.operators.components import COL_BITS
from terralux.operators.numbering import hierarchical_row_number
from terralux.session import cut, spread

RINGS = "scene_id STRING, site_id BIGINT, part INT, ring INT, is_hole BOOLEAN, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>"
_WALKED = "scene_id STRING, site_id BIGINT, head BIGINT, next BIGINT, cells BIGINT, top_r INT, top_c INT, rs ARRAY<INT>, cs ARRAY<INT>, west_r ARRAY<INT>, west_c ARRAY<INT>"
_WALKED_NAMES = [field.split(" ")[0] for field in _WALKED.split(", ")]

# Sides n, e, s, w are walked with the site on the right: the cells ahead on the right and on the left, and
# the corner where the side ends, seen from the side's cell.
_RIGHT = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
_LEFT = np.array([(-1, 1), (1, 1), (1, -1), (-1, -1)])
_OUTSIDE = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])
_END = np.array([(0, 1), (1, 1), (1, 0), (0, 0)])


def _simplify(points: np.ndarray, tolerance: float, closed: bool) -> np.ndarray:
    """Douglas-Peucker between fixed corners: the ends of a chain, or a ring's first corner and the farthest from it.

    ``points`` of a ring do not repeat the first corner; returns the indices that stay.
    """
    n = len(points)
    if tolerance <= 0.0 or n < (5 if closed else 3):
        return np.arange(n)
    walk = np.concatenate([points, points[:1]]) if closed else points
    last = len(walk) - 1
    keep = np.zeros(len(walk), dtype=bool)
    keep[[0, last]] = True
    todo = [(0, last)]
    if closed:
        far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
        keep[far] = True
        todo = [(0, far), (far, last)]
    while todo:
        a, b = todo.pop()
        if b <= a + 1:
            continue
        base, inner = walk[b] - walk[a], walk[a + 1 : b] - walk[a]
        length = np.hypot(*base)
        off = np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length if length else np.hypot(*inner.T)
        worst = int(np.argmax(off))
        if off[worst] > tolerance:
            keep[a + 1 + worst] = True
            todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
    kept = np.flatnonzero(keep[:n])
    return kept if len(kept) >= 3 or not closed else np.arange(n)


def _walk_block(block: pd.DataFrame, size: int, tolerance_cells: float) -> pd.DataFrame:
    """Closed rings (``next`` is missing) and leaving chains of one block of ``size`` cells a side."""
    r0, c0 = int(block["_br"].iloc[0]) * size, int(block["_bc"].iloc[0]) * size
    site = np.full((size + 4, size + 4), -1, dtype=np.int64)
    rr, cc = block["row"].to_numpy() - r0 + 2, block["col"].to_numpy() - c0 + 2
    site[rr, cc] = block["site_id"].to_numpy()
    own = block["_own"].to_numpy()
    rows, cols = rr[own], cc[own]
    sides = []
    for d in range(4):
        open_ = site[rows + _OUTSIDE[d, 0], cols + _OUTSIDE[d, 1]] != site[rows, cols]
        sides.append(np.stack([rows[open_], cols[open_], np.full(int(open_.sum()), d)], axis=1))
    r, c, d = np.concatenate(sides).T
    mine = site[r, c]
    right_r, right_c = r + _RIGHT[d, 0], c + _RIGHT[d, 1]
    left_r, left_c = r + _LEFT[d, 0], c + _LEFT[d, 1]
    right, left = site[right_r, right_c] == mine, site[left_r, left_c] == mine
    # At a corner where only the diagonal cell belongs to the site the walk turns right, which keeps the parts apart.
    turn_left = right & left
    nr = np.where(~right, r, np.where(left, left_r, right_r))
    nc = np.where(~right, c, np.where(left, left_c, right_c))
    nd = np.where(~right, (d + 1) % 4, np.where(turn_left, (d + 3) % 4, d))

    def name(row, col, side):
        return ((((row - 2 + r0) << COL_BITS) + (col - 2 + c0)) << 2) + side

    ids, following = name(r, c, d), name(nr, nc, nd)
    order = np.argsort(ids)
    ids, following = ids[order], following[order]
    r, c, d, mine = r[order] - 2 + r0, c[order] - 2 + c0, d[order], mine[order]
    turns = nd[order] != d
    at = np.searchsorted(ids, following)
    inside = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == following)
    step = np.where(inside, at, -1).tolist()
    entered = np.ones(len(ids), dtype=bool)
    entered[at[inside]] = False
    seen = np.zeros(len(ids), dtype=bool)
    out = []

    def walk(first: int) -> None:
        path, k = [], first
        while k >= 0 and not seen[k]:
            seen[k] = True
            path.append(k)
            k = step[k]
        path = np.array(path)
        corner = path[turns[path]]
        points = np.stack([r[corner] + _END[d[corner], 0], c[corner] + _END[d[corner], 1]], axis=1)
        closed = k >= 0
        kept = points[_simplify(points.astype(float), tolerance_cells, closed)]
        west = path[d[path] == 3]
        # Rows of the lower sides minus rows of the upper sides: the cells inside, negative for a hole.
        cells = int((r[path[d[path] == 2]] + 1).sum() - r[path[d[path] == 0]].sum())
        # The first corner in raster order may go with the simplification, but it still names the place of the ring.
        top = points[np.lexsort(points.T[::-1])[0]].tolist() if len(points) else (None, None)
        out.append(
            (block["scene_id"].iloc[0], int(mine[first]), int(ids[first]), None if closed else int(following[path[-1]]), cells, *top, kept[:, 0], kept[:, 1], r[west], c[west])
        )

    for first in np.flatnonzero(entered):
        walk(int(first))
    for first in range(len(ids)):
        if not seen[first]:
            walk(first)
    return pd.DataFrame(out, columns=_WALKED_NAMES).astype({"next": "Int64", "top_r": "Int32", "top_c": "Int32"})


def block_chains(site_cells: DataFrame, tolerance_cells: float = 0.0) -> DataFrame:
    """Rings and chains of all blocks, with their corners (after simplification) and western sides."""
    blocked = stencil.to_blocks(site_cells.select("scene_id", "site_id", "row", "col"), ["scene_id"], 1, 1)

    size = stencil.BLOCK

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        return _walk_block(block, size, tolerance_cells) if block["_own"].any() else pd.DataFrame(columns=_WALKED_NAMES)

    def places(r: str, c: str) -> Column:
        return F.zip_with(r, c, lambda a, b: F.struct(a.alias("r"), b.alias("c")))

    walked = spread(blocked, "scene_id", "_br", "_bc").groupBy("scene_id", "_br", "_bc").applyInPandas(walk, _WALKED)
    top = F.when(F.col("top_r").isNotNull(), F.struct(F.col("top_r").alias("r"), F.col("top_c").alias("c")))
    return walked.select("scene_id", "site_id", "head", "next", "cells", top.alias("top"), places("rs", "cs").alias("corners"), places("west_r", "west_c").alias("west"))


def _settled(df: DataFrame, label: str, mark: Column):
    """A written round and what tells whether it changed anything."""
    stored = cut(df, label)
    return stored, stored.agg(mark).first()[0]


def joined_chains(chains: DataFrame) -> DataFrame:
    """(scene_id, head, ring, behind): the ring of every chain and how many chains follow it to the ring's end."""
    links = chains.filter("next IS NOT NULL").select("scene_id", "head", "next")
    if links.isEmpty():
        return links.select("scene_id", "head", F.col("head").alias("ring"), F.lit(0).cast("bigint").alias("behind"))
    mark = F.sum(F.col("best").cast("decimal(38,0)"))
    current, seen = _settled(links.select("scene_id", "head", F.col("next").alias("jump"), F.least("head", "next").alias("best")), "chains", mark)
    while True:
        ahead = current.select("scene_id", F.col("head").alias("jump"), F.col("jump").alias("jump2"), F.col("best").alias("best2"))
        moved = current.join(ahead, ["scene_id", "jump"]).select("scene_id", "head", F.col("jump2").alias("jump"), F.least("best", "best2").alias("best"))
        current, now = _settled(moved, "chains", mark)
        # A round without change anywhere means that every window holds its cycle's least chain.
        if now == seen:
            break
        seen = now
    rings = current.select("scene_id", "head", F.col("best").alias("ring"))
    opened = links.join(rings, ["scene_id", "head"]).select(
        "scene_id", "head", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("jump"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("bigint").alias("behind")
    )
    left = F.count("jump")
    current, open_ends = _settled(opened, "ranks", left)
    while open_ends:
        ahead = current.select("scene_id", F.col("head").alias("jump"), F.col("jump").alias("jump2"), F.col("behind").alias("behind2"))
        moved = current.join(ahead, ["scene_id", "jump"], "left").select("scene_id", "head", "ring", F.col("jump2").alias("jump"), (F.col("behind") + F.coalesce("behind2", F.lit(0))).alias("behind"))
        current, open_ends = _settled(moved, "ranks", left)
    return current.select("scene_id", "head", "ring", "behind")


def _holders(chains: DataFrame, rings: DataFrame) -> DataFrame:
    """(scene_id, ring, outer): the outer ring around every hole."""
    holes = rings.filter("cells < 0").select("scene_id", "site_id", "ring", (F.col("top.r") - 1).alias("row"), F.col("top.c").alias("col"))
    if holes.isEmpty():
        return holes.select("scene_id", "ring", F.col("ring").alias("outer"))
    line = ["scene_id", "site_id", "row"]
    west = chains.select("scene_id", "site_id", F.col("ring").alias("met"), F.inline("west")).withColumnsRenamed({"r": "row", "c": "col"})
    asked = west.join(holes.select(*line).distinct(), line, "left_semi").select(*line, "col", "met", F.lit(None).cast("bigint").alias("ring"))
    both = asked.unionByName(holes.select(*line, "col", F.lit(None).cast("bigint").alias("met"), "ring"))
    # One window is a row of cells of one site; the western side of the probed cell itself counts.
    going = W.partitionBy(*line).orderBy("col", F.col("ring").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("outer", F.last("met", ignorenulls=True).over(going)).filter("ring IS NOT NULL").select("scene_id", "ring", "outer")
    current = cut(found, "holders")
    while True:
        ahead = current.select("scene_id", F.col("ring").alias("outer"), F.col("outer").alias("outer2"))
        moved = current.join(ahead, ["scene_id", "outer"], "left").select("scene_id", "ring", F.coalesce("outer2", "outer").alias("outer"), F.col("outer2").isNotNull().cast("int").alias("moved"))
        current, still = _settled(moved, "holders", F.sum("moved"))
        current = current.drop("moved")
        if not still:
            return current


def site_rings(site_cells: DataFrame, grids: DataFrame, tolerance_m: float = 0.0) -> DataFrame:
    """One row per ring with its corner coordinates; ring 0 of a part is its outer ring.

    Corners closer than ``tolerance_m`` to the simplified outline go; a chain keeps its ends, so the result
    does not depend on what other blocks do. All grids of one call share their resolution if a tolerance is given.
    """
    cells_per_metre = 0.0
    if tolerance_m > 0.0:
        spread = grids.agg(F.min("resolution_m"), F.max("resolution_m")).first()
        if spread[0] != spread[1]:
            raise ValueError("outlines of grids of different resolution are simplified in separate calls")
        cells_per_metre = 1.0 / float(spread[0]) if spread[0] else 0.0
    raw = cut(block_chains(site_cells, tolerance_m * cells_per_metre), "outlines")
    places = joined_chains(raw)
    chains = raw.join(places, ["scene_id", "head"], "left").withColumns({"ring": F.coalesce("ring", "head"), "behind": F.coalesce("behind", F.lit(0))})
    rings = cut(
        chains.groupBy("scene_id", "site_id", "ring").agg(
            F.sum("cells").alias("cells"),
            F.min("top").alias("top"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("behind")).alias("o"), "corners"))), lambda x: x["corners"])).alias("corners"),
        ),
        "rings",
    )
    outer = hierarchical_row_number(
        rings.filter("cells > 0").select("scene_id", "site_id", F.col("ring").alias("outer"), F.col("top.r").alias("r"), F.col("top.c").alias("c")), ["scene_id", "site_id"], ["r", "c"], "part"
    ).select("scene_id", "outer", (F.col("part") - 1).cast("int").alias("part"))
    placed = rings.join(_holders(chains, rings), ["scene_id", "ring"], "left").withColumn("outer", F.coalesce("outer", "ring")).join(outer, ["scene_id", "outer"])
    # The outer ring starts first: its first corner is above or left of those of its holes.
    numbered = hierarchical_row_number(
        placed.select("scene_id", "site_id", "part", "ring", (F.col("cells") < 0).alias("is_hole"), F.col("top.r").alias("r"), F.col("top.c").alias("c"), "corners", "top"),
        ["scene_id", "site_id", "part"], ["r", "c"], "_number",
    )
    spec = grids.select("scene_id", "minx", "maxy", F.col("resolution_m").cast("double").alias("_size"))
    first = F.array_position("corners", F.array_min("corners")).cast("int")
    turned = F.concat(F.slice("corners", first, F.size("corners")), F.slice("corners", F.lit(1), first))
    return (
        numbered.withColumn("corners", turned)
        .join(spec, "scene_id")
        .select(
            "scene_id", "site_id", "part", (F.col("_number") - 1).cast("int").alias("ring"), "is_hole",
            F.transform("corners", lambda p: F.col("minx") + p["c"] * F.col("_size")).alias("xs"),
            F.transform("corners", lambda p: F.col("maxy") - p["r"] * F.col("_size")).alias("ys"),
        )
    )


def rings_lonlat(rings: DataFrame, grids: DataFrame) -> DataFrame:
    """Rings with their corners in WGS-84: xs are longitudes, ys latitudes, as feature documents need them."""
    ring = ["scene_id", "site_id", "part", "ring", "is_hole"]
    corners = rings.join(grids.select("scene_id", "epsg"), "scene_id").select(
        *ring, "epsg", F.posexplode(F.arrays_zip("xs", "ys")).alias("at", "p")
    )
    placed = with_lonlat(corners.select(*ring, "epsg", "at", F.col("p.xs").alias("x"), F.col("p.ys").alias("y")), "x", "y", "epsg", "lon", "lat")
    walked = placed.groupBy(*ring).agg(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))).alias("c"))
    return walked.select(*ring, F.transform("c", lambda p: p["lon"]).alias("xs"), F.transform("c", lambda p: p["lat"]).alias("ys"))


def site_polygons(rings: DataFrame) -> DataFrame:
    """Rings to one MULTIPOLYGON-shaped column per site: parts of rings of corners."""
    points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y")))
    parts = (
        rings.groupBy("scene_id", "site_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("ring", points.alias("points")))).alias("r"))
        .select("scene_id", "site_id", "part", F.transform("r", lambda r: r["points"]).alias("rings"))
    )
    return (
        parts.groupBy("scene_id", "site_id")
        .agg(F.array_sort(F.collect_list(F.struct("part", "rings"))).alias("p"))
        .select("scene_id", "site_id", F.transform("p", lambda p: p["rings"]).alias("polygons"))
    )


def ring_measures(rings: DataFrame) -> DataFrame:
    """Signed shoelace area (holes negative), perimeter and corner count per ring."""

    def side_sum(f) -> Column:
        n = F.size("xs")
        idx = F.sequence(F.lit(1), n - 1)
        return F.aggregate(
            F.transform(idx, lambda i: f(F.element_at("xs", i), F.element_at("ys", i), F.element_at("xs", i + 1), F.element_at("ys", i + 1))),
            F.lit(0.0),
            lambda s, v: s + v,
        )

    return rings.select(
        "scene_id",
        "site_id",
        "part",
        "ring",
        "is_hole",
        (-side_sum(lambda x0, y0, x1, y1: x0 * y1 - x1 * y0) / 2.0).alias("area_m2"),
        side_sum(lambda x0, y0, x1, y1: F.hypot(x1 - x0, y1 - y0)).alias("perimeter_m"),
        (F.size("xs") - 1).alias("corners"),
    )


def polygon_centroids(rings: DataFrame) -> DataFrame:
    """(scene_id, site_id, x, y): area centroid of each site's rings from their corners; NULL where they enclose nothing.

    Holes run the other way round, so their moments subtract.
    """
    x0, y0 = F.element_at("xs", 1), F.element_at("ys", 1)

    def moment(weight) -> Column:
        def side(i):
            xa, ya = F.element_at("xs", i) - x0, F.element_at("ys", i) - y0
            xb, yb = F.element_at("xs", i + 1) - x0, F.element_at("ys", i + 1) - y0
            return (xa * yb - xb * ya) * weight(xa + xb, ya + yb)

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.size("xs") - 1), side), F.lit(0.0), lambda s, v: s + v)

    doubled = moment(lambda _x, _y: F.lit(1.0))
    measured = rings.select(
        "scene_id", "site_id", doubled.alias("a"),
        (doubled * x0 + moment(lambda x, _y: x) / 3.0).alias("mx"), (doubled * y0 + moment(lambda _x, y: y) / 3.0).alias("my"),
    )
    total = F.nullif(F.sum("a"), F.lit(0.0))
    return measured.groupBy("scene_id", "site_id").agg((F.sum("mx") / total).alias("x"), (F.sum("my") / total).alias("y"))
