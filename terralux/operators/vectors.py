"""Vector features: assembly, filters, rasterisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terralux.functions.geodesy import inside_ring
from terralux.session import cut

#: Levels of tiles below the whole one in J8, each a quarter as wide, and extents that begin in a tile that is not split.
LEVELS = 3
CROWDED = 500

# Tag values of the four feature layers.
ROAD_VALUES = (
    "motorway",
    "motorway_link",
    "trunk",
    "trunk_link",
    "primary",
    "primary_link",
    "secondary",
    "secondary_link",
)
PLACE_VALUES = ("city", "town", "village")
POWER_VALUES = ("line", "substation")


def tag_matches(tags: Column, wanted: dict[str, tuple[str, ...] | None]) -> Column:
    """Every key must carry an allowed value; ``None`` allows any value."""
    ok = F.lit(True)
    for key, values in wanted.items():
        found = F.try_element_at(tags, F.lit(key))
        ok = ok & (found.isNotNull() if values is None else F.coalesce(found.isin(*values), F.lit(False)))
    return ok


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Way references joined to node positions, regrouped in order.

    Missing nodes are dropped, ways with fewer than two positions too. A closed way of at
    least four positions is a polygon. Published ways hold at most 2,000 nodes, so the
    regroup is bounded per way.
    """
    refs = ways.select("scene_id", "feature_id", F.posexplode("nodes").alias("pos", "node_id"))
    placed = refs.join(nodes.select("scene_id", "node_id", "x", "y"), ["scene_id", "node_id"])
    shapes = placed.groupBy("scene_id", "feature_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "x", "y"))),
            lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")),
        ).alias("coords")
    )
    closed = (F.size("coords") >= 4) & (F.element_at("coords", 1) == F.element_at("coords", -1))
    return (
        shapes.filter(F.size("coords") >= 2)
        .withColumn("geom_type", F.when(closed, F.lit("Polygon")).otherwise(F.lit("LineString")))
        .join(ways.select("scene_id", "feature_id", "tags"), ["scene_id", "feature_id"])
    )


def point_features(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "scene_id",
        F.col("node_id").alias("feature_id"),
        F.array(F.struct("x", "y")).alias("coords"),
        F.lit("Point").alias("geom_type"),
        "tags",
    )


def concat_features(*frames: DataFrame) -> DataFrame:
    """Concatenation of ragged feature tables."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def drop_duplicate_geometries(features: DataFrame) -> DataFrame:
    """One feature per scene and geometry, the lowest id.

    Grouped by a digest of the coordinates and combined on the map side, so a heap of
    copies is reduced before it travels.
    """
    rest = [c for c in features.columns if c not in ("scene_id", "geom_key")]
    keyed = features.withColumn("geom_key", F.sha2(F.to_json(F.struct("geom_type", "coords")), 256))
    return (
        keyed.groupBy("scene_id", "geom_key")
        .agg(F.min_by(F.struct(*rest), F.col("feature_id")).alias("f"))
        .select("scene_id", "f.*")
    )


def power_features(ways: DataFrame, points: DataFrame, require_tags: bool = False) -> DataFrame:
    """Lines plus every node of the answer; ``require_tags`` keeps tagged elements only."""
    both = ways.unionByName(points)
    if require_tags:
        both = both.filter(tag_matches(F.col("tags"), {"power": POWER_VALUES}))
    return drop_duplicate_geometries(both)


def road_features(ways: DataFrame) -> DataFrame:
    """S7."""
    return drop_duplicate_geometries(ways.filter(tag_matches(F.col("tags"), {"highway": ROAD_VALUES})))


def railway_features(ways: DataFrame) -> DataFrame:
    """S8."""
    return drop_duplicate_geometries(ways.filter(tag_matches(F.col("tags"), {"railway": ("rail",)})))


def urban_features(ways: DataFrame, points: DataFrame) -> DataFrame:
    """Residential outlines and place nodes."""
    homes = ways.filter(tag_matches(F.col("tags"), {"landuse": ("residential",)}))
    places = points.filter(tag_matches(F.col("tags"), {"place": PLACE_VALUES}))
    return drop_duplicate_geometries(homes.unionByName(places))


def _to_cell_space(features: DataFrame, grids: DataFrame) -> DataFrame:
    """Coordinates as fractional cell indices (u across, v down)."""
    spec = grids.select("scene_id", "minx", "maxy", "resolution_m", "width", "height")
    return features.join(spec, "scene_id").withColumn(
        "path",
        F.transform(
            "coords",
            lambda p: F.struct(
                ((p["x"] - F.col("minx")) / F.col("resolution_m")).alias("u"),
                ((F.col("maxy") - p["y"]) / F.col("resolution_m")).alias("v"),
            ),
        ),
    )


def _inside_grid() -> Column:
    return F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)


_PLACED = ["scene_id", "feature_id", "width", "height"]


def _point_cells(features: DataFrame) -> DataFrame:
    return features.select(
        *_PLACED,
        F.floor(F.col("path")[0]["v"]).cast("int").alias("row"),
        F.floor(F.col("path")[0]["u"]).cast("int").alias("col"),
    )


def _sides(features: DataFrame) -> DataFrame:
    n = F.size("path")
    pairs = F.arrays_zip(
        F.slice("path", F.lit(1), n - 1).alias("a"), F.slice("path", F.lit(2), n - 1).alias("b")
    )
    return features.select(*_PLACED, F.explode(pairs).alias("s")).select(
        *_PLACED,
        F.col("s.a.u").alias("u0"),
        F.col("s.a.v").alias("v0"),
        F.col("s.b.u").alias("u1"),
        F.col("s.b.v").alias("v1"),
    )


def _line_cells(features: DataFrame) -> DataFrame:
    """One step per cell along the longer axis of each side; only steps that can lie in the grid are made."""
    stepped = _sides(features).withColumns({c: F.floor(c) for c in ("u0", "v0", "u1", "v1")})
    steps = F.greatest(F.abs(F.col("u1") - F.col("u0")), F.abs(F.col("v1") - F.col("v0")))

    def at(lo: str, hi: str) -> Column:
        share = F.coalesce(F.col("i") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
        return (F.col(lo) + F.floor((F.col(hi) - F.col(lo)) * share + 0.5)).cast("int")

    def share_inside(lo: str, hi: str, size: str) -> tuple[Column, Column]:
        """Least and largest share of the way that is within a cell of the grid on one axis."""
        way = F.nullif(F.col(hi) - F.col(lo), F.lit(0))
        enter, leave = (-1 - F.col(lo)) / way, (F.col(size) - F.col(lo)) / way
        still = F.col(lo).between(0, F.col(size) - 1)
        return (
            F.coalesce(F.least(enter, leave), F.when(still, F.lit(0.0)).otherwise(F.lit(1.0))),
            F.coalesce(F.greatest(enter, leave), F.when(still, F.lit(1.0)).otherwise(F.lit(0.0))),
        )

    (u_from, u_to), (v_from, v_to) = share_inside("u0", "u1", "width"), share_inside("v0", "v1", "height")
    first = F.greatest(F.lit(0), F.floor(F.greatest(u_from, v_from) * F.col("n")) - 1)
    last = F.least(F.col("n"), F.ceil(F.least(u_to, v_to) * F.col("n")) + 1)
    return (
        stepped.withColumn("n", steps)
        .withColumns({"_first": first, "_last": last})
        .filter("_first <= _last")
        .withColumn("i", F.explode(F.sequence("_first", "_last")))
        .select(*_PLACED, at("v0", "v1").alias("row"), at("u0", "u1").alias("col"))
    )


def polygon_cells(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Scanline fill: cells whose centre lies inside by the even-odd rule.

    Each side yields its crossing with every cell row it spans; sorted crossings of one
    polygon row pair up to spans of columns. Work grows with outline plus filled cells, and
    no cell is tested against a polygon.
    """
    top, bottom = F.least("v0", "v1"), F.greatest("v0", "v1")
    crossed = (
        sides.withColumns({"r0": F.ceil(top - 0.5).cast("int"), "r1": (F.ceil(bottom - 0.5) - 1).cast("int")})
        .withColumns({"r0": F.greatest("r0", F.lit(0)), "r1": F.least(F.col("r1"), F.col("height") - 1)})
        .filter("r0 <= r1")
        .withColumn("row", F.explode(F.sequence("r0", "r1")))
        .withColumn(
            "u",
            F.col("u0")
            + (F.col("row") + 0.5 - F.col("v0"))
            / F.nullif(F.col("v1") - F.col("v0"), F.lit(0.0))
            * (F.col("u1") - F.col("u0")),
        )
    )
    line = W.partitionBy(*keys, "row").orderBy("u")
    spans = (
        crossed.withColumns({"k": F.row_number().over(line), "u_end": F.lead("u").over(line)})
        .filter("k % 2 = 1 AND u_end IS NOT NULL")
        .withColumns({"c0": F.ceil(F.col("u") - 0.5).cast("int"), "c1": (F.ceil(F.col("u_end") - 0.5) - 1).cast("int")})
        .withColumns({"c0": F.greatest("c0", F.lit(0)), "c1": F.least(F.col("c1"), F.col("width") - 1)})
        .filter("c0 <= c1")
    )
    return spans.select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def rasterize(features: DataFrame, grids: DataFrame) -> DataFrame:
    """Distinct (scene_id, row, col) touched by points, lines and filled polygons."""
    placed = _to_cell_space(features, grids)
    points = _point_cells(placed.filter("geom_type = 'Point'"))
    lines = _line_cells(placed.filter("geom_type = 'LineString'"))
    direct = points.unionByName(lines).filter(_inside_grid()).select("scene_id", "row", "col")
    filled = polygon_cells(_sides(placed.filter("geom_type = 'Polygon'")), ["scene_id", "feature_id"])
    return direct.unionByName(filled.select("scene_id", "row", "col")).distinct()


def distinct_outlines(areas: DataFrame) -> DataFrame:
    """Areas with equal outlines (and scene and bounds, where given) as one row, that of the least id.

    What areas cover together does not change. Combined on the map side, so copies go before they travel, and the
    shuffle tells the joins behind it how many outlines there are.
    """
    same = [c for c in ("scene_id", "minx", "miny", "maxx", "maxy", "rings") if c in areas.columns]
    return areas.groupBy(*same).agg(F.min("area_id").alias("area_id"))


def protected_cells(areas: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells inside protected areas. ``areas`` is (scene_id, area_id, rings), one row per area; repeated rows count once."""
    once = distinct_outlines(areas.select("scene_id", "area_id", "rings"))
    rings = once.select("scene_id", F.col("area_id").alias("feature_id"), F.explode("rings").alias("coords"))
    filled = polygon_cells(_sides(_to_cell_space(rings, grids)), ["scene_id", "feature_id"])
    return filled.select("scene_id", "row", "col").distinct()


def meets_box(rings: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Exact polygon-box intersection: a side touches the box, or the box lies inside."""

    def side_touches(a: Column, b: Column) -> Column:
        # Separating axes: the box's two, then the normal of the side.
        apart = (
            (F.greatest(a["x"], b["x"]) < minx)
            | (F.least(a["x"], b["x"]) > maxx)
            | (F.greatest(a["y"], b["y"]) < miny)
            | (F.least(a["y"], b["y"]) > maxy)
        )

        def offset(x: Column, y: Column) -> Column:
            return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])

        corners = [offset(x, y) for x in (minx, maxx) for y in (miny, maxy)]
        return ~apart & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    def ring_touches(ring: Column) -> Column:
        n = F.size(ring)
        pairs = F.arrays_zip(
            F.slice(ring, F.lit(1), n - 1).alias("a"), F.slice(ring, F.lit(2), n - 1).alias("b")
        )
        return F.exists(pairs, lambda s: side_touches(s["a"], s["b"]))

    holds = F.size(F.filter(rings, lambda ring: inside_ring(minx, miny, ring))) % 2 == 1
    return F.exists(rings, ring_touches) | holds


def _finest(df: DataFrame, tile: float) -> DataFrame:
    """Extents in whole squares of the finest level, so that a square's parts follow from it by shifts."""
    scale = F.lit(float(1 << (2 * LEVELS)) / tile)
    return df.withColumns({f"_{c}": F.floor(F.col(c) * scale) for c in ("minx", "miny", "maxx", "maxy")})


def crowded_squares(*extents: DataFrame) -> DataFrame:
    """(level, tx, ty) of squares to be split into 4 x 4: those in which more than ``CROWDED`` extents begin.

    One aggregate over the corners at the finest level; coarser levels are sums of its rows.
    """
    corners = [df.select(F.col("_minx").alias("fx"), F.col("_miny").alias("fy")) for df in extents]
    counts = corners[0]
    for other in corners[1:]:
        counts = counts.unionByName(other)
    finest = counts.groupBy("fx", "fy").agg(F.count("*").alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    up = finest.select("fx", "fy", "n", level).withColumn("by", F.expr(f"2 * ({LEVELS} - level)"))
    squares = up.selectExpr("level", "shiftright(fx, by) AS tx", "shiftright(fy, by) AS ty", "n")
    return squares.groupBy("level", "tx", "ty").agg(F.sum("n").alias("n")).filter(F.col("n") > CROWDED).select("level", "tx", "ty")


def leaf_squares(df: DataFrame, split: DataFrame) -> DataFrame:
    """Each extent once per leaf (_level, _tx, _ty) that it covers: whole tiles, or parts of the split ones."""

    def covered(axis: str, by: int, lowest: Column | None = None) -> Column:
        lo, hi = F.shiftright(f"_min{axis}", by), F.shiftright(f"_max{axis}", by)
        if lowest is not None:
            lo, hi = F.greatest(lo, lowest), F.least(hi, lowest + 3)
        return F.sequence(lo, hi)

    rows = df.withColumn("_tx", F.explode(covered("x", 2 * LEVELS))).withColumn("_ty", F.explode(covered("y", 2 * LEVELS))).withColumn("_level", F.lit(0))
    for level in range(LEVELS):
        here = split.filter(F.col("level") == level).select(F.col("level").alias("_level"), F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.lit(True).alias("_split"))
        by = 2 * (LEVELS - level - 1)
        rows = rows.join(here, ["_level", "_tx", "_ty"], "left")
        for axis in ("x", "y"):
            own = F.col(f"_t{axis}")
            rows = rows.withColumn(f"_t{axis}", F.explode(F.when(F.col("_split"), covered(axis, by, own * 4)).otherwise(F.array(own))))
        rows = rows.withColumn("_level", F.when(F.col("_split"), F.lit(level + 1)).otherwise(F.col("_level"))).drop("_split")
    return rows


def areas_meeting_boxes(areas: DataFrame, boxes: DataFrame, tile: float = 1.0) -> DataFrame:
    """(scene_id, area) pairs whose polygon meets the scene's box.

    Both sides are dealt to the leaves of a quadtree: tiles, of which those where many areas and boxes begin
    are split into 4 x 4, up to ``LEVELS`` times. The join is an equality on the leaf; a pair is kept in the one
    leaf that holds the least corner of what both extents share, then tested exactly. Extents that stay together in a
    leaf of the last level overlap or nearly so; what is left of such a key is split by Spark's skew join.
    The table of split squares has at most one row per ``CROWDED`` extents and level, and joins without a hint.
    Areas and boxes with a null bound meet nothing.
    """
    known = F.lit(True)
    for c in ("minx", "miny", "maxx", "maxy"):
        known = known & F.col(c).isNotNull()
    a = _finest(areas.filter(known), tile)
    b = _finest(boxes.filter(known).select("scene_id", "minx", "miny", "maxx", "maxy"), tile)
    split = cut(crowded_squares(a, b), "squares")
    b = leaf_squares(b, split).select("scene_id", "_level", "_tx", "_ty", *(F.col(f"_{c}").alias(f"_b_{c}") for c in ("minx", "miny")), *(F.col(c).alias(f"b_{c}") for c in ("minx", "miny", "maxx", "maxy")))

    def holds(axis: str) -> Column:
        return F.expr(f"shiftright(greatest(_min{axis}, _b_min{axis}), 2 * ({LEVELS} - _level)) = _t{axis}")

    return (
        leaf_squares(a, split)
        .join(b, ["_level", "_tx", "_ty"])
        .filter(holds("x") & holds("y"))
        .filter(
            (F.col("minx") <= F.col("b_maxx"))
            & (F.col("maxx") >= F.col("b_minx"))
            & (F.col("miny") <= F.col("b_maxy"))
            & (F.col("maxy") >= F.col("b_miny"))
        )
        .filter(meets_box(F.col("rings"), F.col("b_minx"), F.col("b_miny"), F.col("b_maxx"), F.col("b_maxy")))
        .select("scene_id", *areas.columns)
    )
