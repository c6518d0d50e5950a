"""Full validity of areas (C8): sides against sides by a spatial hash, then points against rings.

A valid area has rings that neither cross nor touch themselves, rings of a part that meet in single points
only and leave its interior connected, holes inside their shell and not inside each other, and parts whose
interiors are apart and which share points only.

Sides are dealt to the squares they cross, of a grid with about one square a side over the area, and squares
that hold many sides are divided again, so that a side meets a few others however many the area has. The test
of two sides is exact: a determinant within its rounding error is computed anew with fractions. Where rings
only touch, their sides are cut at the touching points, and the middles of the pieces tell which rings lie
inside which; a middle meets only the sides that cross its level, again by a hash. The interior is connected
if the graph of rings and touching points has no cycle, whose components are found by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.functions.bind import bind
from terralux.operators.components import contract
from terralux.session import cut

#: A square with more sides than this is divided so that about SHARE sides are left in each part.
CROWDED = 32
SHARE = 4

_PAIR = "aoi_id {id}, p INT, r INT, s INT, q INT, t INT, u INT, kind STRING, x DOUBLE, y DOUBLE"


def ring_sides(areas: DataFrame) -> DataFrame:
    """One row per side of non-zero length, numbered along its ring, with the area's grid (minx, miny, square)."""
    rings = areas.select("aoi_id", F.posexplode("polygons").alias("part", "_rings")).select("aoi_id", "part", F.posexplode("_rings").alias("ring", "_ring"))
    # An open ring is closed. Repeated corners are no fault; without them every side has a length.
    closed = bind(rings, {"_ring": F.concat("_ring", F.slice("_ring", 1, 1))})
    fresh = F.filter(
        F.transform("_ring", lambda v, i: F.struct(v["x"].alias("x"), v["y"].alias("y"), ((i == 0) | (v != F.get("_ring", i - 1))).alias("new"))),
        lambda v: v["new"],
    )
    corners = bind(closed, {"_c": fresh}).drop("_ring")
    # The corners end here: a row that carries them beside each of its sides would be as long as the ring.
    ends = F.arrays_zip(F.slice("_c", F.lit(1), F.size("_c") - 1).alias("a"), F.slice("_c", F.lit(2), F.size("_c") - 1).alias("b"))
    paired = bind(corners, {"n_sides": F.size("_c") - 1, "_s": ends}).drop("_c")
    return paired.select("aoi_id", "part", "ring", "n_sides", F.posexplode("_s").alias("side", "s")).selectExpr(
        "aoi_id", "part", "ring", "side", "n_sides", "s.a.x AS x0", "s.a.y AS y0", "s.b.x AS x1", "s.b.y AS y1"
    )


def degenerate_rings(areas: DataFrame) -> DataFrame:
    """(aoi_id, fault) of areas with a ring that is a single point."""
    point = F.exists(F.flatten("polygons"), lambda ring: ~F.exists(ring, lambda v: v != F.get(ring, F.lit(0))))
    return areas.filter(F.coalesce(point, F.lit(False))).select("aoi_id", F.lit("degenerate_ring").alias("fault"))


def with_grid(sides: DataFrame) -> DataFrame:
    """Adds the area's least corner and the width of its squares: as many squares as sides."""
    extent = sides.groupBy("aoi_id").agg(
        F.min(F.least("x0", "x1")).alias("minx"), F.min(F.least("y0", "y1")).alias("miny"),
        F.greatest(F.max(F.greatest("x0", "x1")) - F.min(F.least("x0", "x1")), F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))).alias("_span"),
        F.ceil(F.sqrt(F.count("*"))).alias("_n"),
    )
    return sides.join(extent.select("aoi_id", "minx", "miny", (F.col("_span") / F.col("_n")).alias("square"), "_n"), "aoi_id")


def _span(lo: Column, hi: Column, last: Column) -> Column:
    first, end = F.greatest(F.floor(lo - 1e-9), F.lit(0)), F.least(F.floor(hi + 1e-9), last)
    return F.explode(F.when(first <= end, F.sequence(first, end)))


def _crossed(df: DataFrame, u0: str, v0: str, u1: str, v1: str, last: Column, out: tuple[str, str]) -> DataFrame:
    """Squares 0..last each way that the side (u0, v0)-(u1, v1) of unit squares crosses or touches."""
    col, row = out
    banded = df.withColumn(row, _span(F.least(v0, v1), F.greatest(v0, v1), last))
    dv = F.nullif(F.col(v1) - F.col(v0), F.lit(0.0))
    at = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((F.col(row) + d - F.col(v0)) / dv, F.lit(float(d))))) for d in (0, 1)]
    ends = [F.col(u0) + t * (F.col(u1) - F.col(u0)) for t in at]
    return banded.withColumn(col, _span(F.least(*ends), F.greatest(*ends), last))


def squared(sides: DataFrame) -> DataFrame:
    """Sides with the squares they cross (_ix, _iy, _jx, _jy); crowded squares are divided once more."""
    keep = sides.columns
    scaled = sides.withColumns({f"_{c}": (F.col(c) - F.col(f"min{c[0]}")) / F.col("square") for c in ("x0", "y0", "x1", "y1")})
    first = _crossed(scaled, "_x0", "_y0", "_x1", "_y1", F.col("_n") - 1, ("_ix", "_iy"))
    crowd = first.groupBy("aoi_id", "_ix", "_iy").agg(F.count("*").alias("_in")).filter(F.col("_in") > CROWDED)
    parts = F.coalesce(F.ceil(F.sqrt(F.col("_in") / F.lit(SHARE))), F.lit(1))
    divided = first.join(crowd, ["aoi_id", "_ix", "_iy"], "left").withColumn("_s", parts)
    finer = divided.withColumns({f"_{c}": (F.col(f"_{c}") - F.col(f"_i{c[0]}")) * F.col("_s") for c in ("x0", "y0", "x1", "y1")})
    return _crossed(finer, "_x0", "_y0", "_x1", "_y1", F.col("_s") - 1, ("_jx", "_jy")).select(*keep, "_ix", "_iy", "_jx", "_jy")


def _turns(ax, ay, bx, by, cx, cy) -> np.ndarray:
    """Exact signs of the turns a-b-c."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    found = np.sign(left - right)
    # Shewchuk's bound on the error of the difference.
    unsure = (np.abs(left - right) <= 3.4e-16 * (np.abs(left) + np.abs(right))) & ((left != 0) | (right != 0))
    corner = ((cx == ax) & (cy == ay)) | ((cx == bx) & (cy == by))
    found[corner] = 0
    for k in np.flatnonzero(unsure & ~corner):
        a, b, c = ((Fraction(float(x[k])), Fraction(float(y[k]))) for x, y in ((ax, ay), (bx, by), (cx, cy)))
        d = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        found[k] = (d > 0) - (d < 0)
    return found


def _classify(pairs: pd.DataFrame) -> pd.DataFrame:
    """Pairs of sides that meet: 'cross', 'overlap' or, for each common point, 'touch'."""
    a, b, c, d = ((pairs[f"{n}x{e}"].to_numpy(), pairs[f"{n}y{e}"].to_numpy()) for n in "ab" for e in "01")
    turns = np.stack([_turns(*a, *b, *c), _turns(*a, *b, *d), _turns(*c, *d, *a), _turns(*c, *d, *b)])
    cross = (turns[0] * turns[1] < 0) & (turns[2] * turns[3] < 0)
    line = (turns == 0).all(axis=0)
    # On a common line sides are compared along it; lexicographic order is the order along a line.
    swap_a = (a[0] > b[0]) | ((a[0] == b[0]) & (a[1] > b[1]))
    swap_c = (c[0] > d[0]) | ((c[0] == d[0]) & (c[1] > d[1]))
    lo_a, hi_a = (tuple(np.where(swap_a ^ up, b[k], a[k]) for k in (0, 1)) for up in (False, True))
    lo_c, hi_c = (tuple(np.where(swap_c ^ up, d[k], c[k]) for k in (0, 1)) for up in (False, True))

    def before(p, q):
        return (p[0] < q[0]) | ((p[0] == q[0]) & (p[1] < q[1]))

    overlap = line & before(lo_a, hi_c) & before(lo_c, hi_a)
    out = []
    ids = ["aoi_id", "p", "r", "s", "q", "t", "u"]

    def emit(mask, kind, x, y):
        if mask.any():
            some = pairs.loc[mask, ids].copy()
            some["kind"], some["x"], some["y"] = kind, x[mask], y[mask]
            out.append(some)

    emit(cross, "cross", a[0], a[1])
    emit(overlap, "overlap", a[0], a[1])
    free = ~cross & ~overlap

    def on(p, turn, e, f):
        inside = (np.minimum(e[0], f[0]) <= p[0]) & (p[0] <= np.maximum(e[0], f[0])) & (np.minimum(e[1], f[1]) <= p[1]) & (p[1] <= np.maximum(e[1], f[1]))
        return free & (turn == 0) & inside

    for point, turn, e, f in ((c, turns[0], a, b), (d, turns[1], a, b), (a, turns[2], c, d), (b, turns[3], c, d)):
        emit(on(point, turn, e, f), "touch", *point)
    return pd.concat(out) if out else pairs.loc[[], ids].assign(kind="", x=0.0, y=0.0)


def meetings(sides: DataFrame) -> DataFrame:
    """Pairs of sides of an area that meet: (part, ring, side) as (p, r, s) and (q, t, u), kind and point.

    Neighbours along a ring that share just their corner are left out.
    """
    dealt = squared(sides)
    square = ["aoi_id", "_ix", "_iy", "_jx", "_jy"]
    one = dealt.select(*square, F.col("part").alias("p"), F.col("ring").alias("r"), F.col("side").alias("s"), "n_sides", *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")))
    two = dealt.select(*square, F.col("part").alias("q"), F.col("ring").alias("t"), F.col("side").alias("u"), *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    near = (F.greatest(F.least("ax0", "ax1"), F.least("bx0", "bx1")) <= F.least(F.greatest("ax0", "ax1"), F.greatest("bx0", "bx1"))) & (
        F.greatest(F.least("ay0", "ay1"), F.least("by0", "by1")) <= F.least(F.greatest("ay0", "ay1"), F.greatest("by0", "by1"))
    )
    pairs = one.join(two, square).filter(F.struct("p", "r", "s") < F.struct("q", "t", "u")).filter(near)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _classify(batch.reset_index(drop=True))
            first = batch.iloc[found.index]
            n, x0, y0, x1, y1 = (first[c].to_numpy() for c in ("n_sides", "ax0", "ay0", "ax1", "ay1"))
            x, y, step = found["x"].to_numpy(), found["y"].to_numpy(), (found["u"] - found["s"]).to_numpy()
            # The common corner of neighbours; a ring of two sides folds back, which is an overlap.
            joint = ((step == 1) & (x == x1) & (y == y1)) | ((step == n - 1) & (x == x0) & (y == y0))
            same = (found["p"] == found["q"]) & (found["r"] == found["t"]) & (found["kind"] == "touch")
            yield found[~(same.to_numpy() & joint)]

    id_type = dict(sides.dtypes)["aoi_id"]
    return pairs.drop("_ix", "_iy", "_jx", "_jy").mapInPandas(classify, _PAIR.format(id=id_type)).distinct()


def _middles(sides: DataFrame, touches: DataFrame) -> DataFrame:
    """Middles of the pieces of touched sides, and of the first side of every ring: (aoi_id, part, ring, x, y)."""
    length2 = (F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2
    cuts = touches.groupBy("aoi_id", "part", "ring", "side").agg(F.collect_set(F.struct("x", "y")).alias("_at"))
    joined = sides.join(cuts, ["aoi_id", "part", "ring", "side"], "left").filter(F.col("_at").isNotNull() | (F.col("side") == 0))
    along = F.transform(
        F.coalesce("_at", F.array().cast("array<struct<x:double,y:double>>")),
        lambda p: ((p["x"] - F.col("x0")) * (F.col("x1") - F.col("x0")) + (p["y"] - F.col("y0")) * (F.col("y1") - F.col("y0"))) / length2,
    )
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(along, lambda t: (t > 0) & (t < 1)))))
    cutted = bind(joined, {"_t": stops})
    middle = F.explode(F.zip_with(F.slice("_t", F.lit(1), F.size("_t") - 1), F.slice("_t", F.lit(2), F.size("_t") - 1), lambda a, b: (a + b) / 2))
    return cutted.withColumn("_m", middle).select(
        "aoi_id", "part", "ring", "side", "minx", "miny", "square", "_n",
        (F.col("x0") + F.col("_m") * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + F.col("_m") * (F.col("y1") - F.col("y0"))).alias("y"),
    )


def _holders(middles: DataFrame, sides: DataFrame) -> DataFrame:
    """(middle, part2, ring2): the other rings that a middle lies inside, by the parity of the sides to its right."""
    level = F.least(F.floor((F.col("y") - F.col("miny")) / F.col("square")), F.col("_n") - 1)
    points = middles.select("aoi_id", "part", "ring", "side", "x", "y", level.alias("_iy"))
    v0, v1 = ((F.col(c) - F.col("miny")) / F.col("square") for c in ("y0", "y1"))
    bands = sides.withColumn("_iy", _span(F.least(v0, v1), F.greatest(v0, v1), F.col("_n") - 1)).select(
        "aoi_id", "_iy", F.col("part").alias("part2"), F.col("ring").alias("ring2"), "x0", "y0", "x1", "y1"
    )
    passes = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (
        F.col("x") < (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)) + F.col("x0")
    )
    point = ["aoi_id", "part", "ring", "side", "x", "y"]
    other = (F.col("part") != F.col("part2")) | (F.col("ring") != F.col("ring2"))
    return points.join(bands, ["aoi_id", "_iy"]).filter(other & passes).groupBy(*point, "part2", "ring2").agg(F.count("*").alias("_k")).filter("_k % 2 = 1").drop("_k")


def _loops(touches: DataFrame) -> DataFrame:
    """Parts whose rings and touching points make a cycle: links - nodes + components > 0."""
    links = touches.select("aoi_id", "part", "ring", "x", "y").distinct()
    # Components are found per part; its rings are small numbers, points numbers above them all.
    named = links.select(
        F.to_json(F.struct("aoi_id", "part")).alias("scene_id"), F.col("ring").cast("long").alias("v"),
        (F.lit(1 << 40) + F.pmod(F.xxhash64("x", "y"), F.lit(1 << 61))).alias("u"),
    )
    stored = cut(named, "touches")
    merged = contract(stored.select("scene_id", "u", "v"))
    both = stored.select("scene_id", F.explode(F.array("u", "v")).alias("node")).distinct().groupBy("scene_id").agg(F.count("*").alias("nodes"))
    components = merged.groupBy("scene_id").agg(F.count_distinct("region").alias("components"))
    counted = stored.groupBy("scene_id").agg(F.count("*").alias("links"))
    loops = counted.join(both, "scene_id").join(components, "scene_id").filter(F.col("links") - F.col("nodes") + F.col("components") > 0)
    return loops.select("scene_id")


def topology_faults(areas: DataFrame) -> DataFrame:
    """(aoi_id, fault) of every area that is not valid; ``areas`` is (aoi_id, polygons)."""
    # Outlines are read twice, and what parsed them is long.
    areas = cut(areas.select("aoi_id", "polygons"), "areas")
    sides = cut(with_grid(ring_sides(areas)), "sides")
    # A corner that a ring visits twice makes the area invalid already, and would be a crowd no square can part.
    twice = sides.groupBy("aoi_id", "part", "ring", "x0", "y0").agg(F.count("*").alias("n")).filter("n > 1").select("aoi_id").distinct()
    rest = sides.join(twice, "aoi_id", "left_anti")
    met = cut(meetings(rest), "meetings")
    within, same_ring = F.col("p") == F.col("q"), (F.col("p") == F.col("q")) & (F.col("r") == F.col("t"))
    crossing = met.filter(same_ring | (F.col("kind") != "touch")).select(
        "aoi_id", F.when(same_ring, F.lit("self_intersection")).when(within, F.lit("rings_cross")).otherwise(F.lit("parts_overlap")).alias("fault")
    )
    named = twice.select("aoi_id", F.lit("self_intersection").alias("fault")).unionByName(crossing).unionByName(degenerate_rings(areas))
    faulty = cut(named.distinct(), "faulty")
    # Only where rings do at most touch is it defined which lies inside which.
    clean = sides.join(faulty, "aoi_id", "left_anti")
    touching = met.filter(F.col("kind") == "touch").join(faulty, "aoi_id", "left_anti")
    touches = cut(
        touching.select("aoi_id", F.explode(F.array(F.struct(F.col("p").alias("part"), F.col("r").alias("ring"), F.col("s").alias("side")), F.struct(F.col("q").alias("part"), F.col("t").alias("ring"), F.col("u").alias("side")))).alias("e"), "x", "y", within.alias("within"))
        .select("aoi_id", "e.*", "x", "y", "within").distinct(),
        "touches",
    )
    middles = _middles(clean, touches)
    inside = _holders(middles, clean)
    point = ["aoi_id", "part", "ring", "side", "x", "y"]
    own = F.col("part") == F.col("part2")
    # Per middle and other part: inside its shell, and inside any of its holes.
    placed = middles.select(*point).join(inside, point, "left").groupBy(*point, F.col("part2")).agg(
        F.coalesce(F.bool_or(F.col("ring2") == 0), F.lit(False)).alias("in_shell"), F.coalesce(F.bool_or(F.col("ring2") > 0), F.lit(False)).alias("in_hole"),
    )
    judged = placed.groupBy(*point).agg(
        F.coalesce(F.bool_or(own & F.col("in_shell")), F.lit(False)).alias("in_own"),
        F.coalesce(F.bool_or(own & F.col("in_hole") & (F.col("ring") > 0)), F.lit(False)).alias("in_other_hole"),
        F.coalesce(F.bool_or(~own & F.col("in_shell") & ~F.col("in_hole")), F.lit(False)).alias("in_other_part"),
    )
    misplaced = judged.select(
        "aoi_id",
        F.explode(F.array_compact(F.array(
            F.when((F.col("ring") > 0) & ~F.col("in_own"), F.lit("hole_outside")),
            F.when(F.col("in_other_hole"), F.lit("nested_holes")),
            F.when(F.col("in_other_part"), F.lit("parts_overlap")),
        ))).alias("fault"),
    )
    found = faulty.unionByName(misplaced)
    inner = touches.filter("within")
    if inner.isEmpty():
        return found.distinct()
    loops = _loops(inner)
    parts = inner.select("aoi_id", F.to_json(F.struct("aoi_id", "part")).alias("scene_id")).distinct()
    disconnected = parts.join(loops, "scene_id").select("aoi_id", F.lit("disconnected_interior").alias("fault"))
    return found.unionByName(disconnected).distinct()
