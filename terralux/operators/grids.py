"""Grids, lattices, tiles and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.functions.geodesy import with_lonlat, with_utm
from terralux.operators.stencil import with_patch

# Resolution limits, lattice sides, area that one sampling unit covers, tile split.
MIN_LATTICE_SIDE = 2
MAX_LATTICE_SIDE = 25
LATTICE_FULL_AREA_KM2 = 10000.0
SPLIT_ABOVE_KM2 = 2500.0
ELEVATION_TILE_DEG = 1
LAND_COVER_TILE_DEG = 3

CELL = ["scene_id", "row", "col"]


def snap_grid(extents: DataFrame, resolution: Column) -> DataFrame:
    """Extents in metres (minx..maxy) grown outward to whole cells; adds width and height."""
    r = resolution
    return (
        extents.withColumn("resolution_m", r)
        .withColumns(
            {
                **{c: F.floor(F.col(c) / r) * r.cast("double") for c in ("minx", "miny")},
                **{c: F.ceil(F.col(c) / r) * r.cast("double") for c in ("maxx", "maxy")},
            }
        )
        .withColumns({"width": _cells("minx", "maxx"), "height": _cells("miny", "maxy")})
    )


def _cells(lo: str, hi: str) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / F.col("resolution_m")).cast("int"))


def grid_faults(grids: DataFrame) -> DataFrame:
    """One row per broken rule."""
    return grids.select(
        "scene_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("minx") >= F.col("maxx"), F.lit("minx_not_below_maxx")),
                    F.when(F.col("miny") >= F.col("maxy"), F.lit("miny_not_below_maxy")),
                    F.when(F.col("resolution_m") <= 0, F.lit("resolution_not_positive")),
                )
            )
        ).alias("rule"),
    )


def cell_x(col: Column) -> Column:
    return F.col("minx") + (col + F.lit(0.5)) * F.col("resolution_m")


def cell_y(row: Column) -> Column:
    return F.col("maxy") - (row + F.lit(0.5)) * F.col("resolution_m")


def generate_cells(grids: DataFrame) -> DataFrame:
    """One row per cell with its centre.

    Rows are exploded first and spread over the cluster, columns after: one huge grid does
    not stay in the task that read its description.
    """
    rows = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return (
        rows.repartition("scene_id", "row")
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        .select("scene_id", "row", "col", cell_x(F.col("col")).alias("x"), cell_y(F.col("row")).alias("y"))
    )


def align(base: DataFrame, *layers: DataFrame) -> DataFrame:
    """Layers joined to the grid on (scene_id, row, col); cells without a value stay missing.

    All joins share one key, so the grid is shuffled once and stays in place.
    """
    for layer in layers:
        base = base.join(layer, CELL, "left")
    return base


def cell_area_km2(resolution: Column) -> Column:
    """C25."""
    return resolution * resolution / F.lit(1e6)


def transform_from_cells(cells: DataFrame) -> DataFrame:
    """Origin and pixel size from centre coordinates; a single line of cells counts as 1 m."""
    many = (F.max("col") > F.min("col")) & (F.max("row") > F.min("row"))
    dx = F.when(many, (F.max("x") - F.min("x")) / (F.max("col") - F.min("col"))).otherwise(F.lit(1.0))
    dy = F.when(many, (F.max("y") - F.min("y")) / (F.max("row") - F.min("row"))).otherwise(F.lit(1.0))
    return cells.groupBy("scene_id").agg(
        dx.alias("dx"),
        (-dy).alias("dy"),
        (F.min("x") - dx / 2.0).alias("west"),
        (F.max("y") + dy / 2.0).alias("north"),
        (dx * dy / 1e6).alias("cell_area_km2"),
    )


def covering_tiles(boxes: DataFrame, step: int) -> DataFrame:
    """South-west corners (tile_lat, tile_lon) of the step-degree tiles a box touches.

    A box is bounded by the area cap, so it touches a handful of tiles.
    """

    def corners(lo: str, hi: str) -> Column:
        start = F.floor(F.col(lo) / step) * step
        stop = F.ceil(F.col(hi) / step) * step - step
        return F.when(stop >= start, F.sequence(start, stop, F.lit(step).cast("bigint")))

    return boxes.withColumn("tile_lat", F.explode(corners("miny", "maxy"))).withColumn(
        "tile_lon", F.explode(corners("minx", "maxx"))
    )


def tile_name(lat: Column, lon: Column) -> Column:
    """Tile name from its corner, e.g. N30E027."""
    return F.concat(
        F.when(lat >= 0, F.lit("N")).otherwise(F.lit("S")),
        F.lpad(F.abs(lat).cast("string"), 2, "0"),
        F.when(lon >= 0, F.lit("E")).otherwise(F.lit("W")),
        F.lpad(F.abs(lon).cast("string"), 3, "0"),
    )


def split_large_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes above 2,500 km2 become four quadrants; ``part`` numbers them."""
    midx, midy = (F.col("minx") + F.col("maxx")) / 2.0, (F.col("miny") + F.col("maxy")) / 2.0

    def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"))

    lo_x, lo_y, hi_x, hi_y = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    quarters = F.array(
        box(lo_x, lo_y, midx, midy), box(lo_x, midy, midx, hi_y), box(midx, lo_y, hi_x, midy), box(midx, midy, hi_x, hi_y)
    )
    parts = F.when(F.col("area_km2") > SPLIT_ABOVE_KM2, quarters).otherwise(F.array(box(lo_x, lo_y, hi_x, hi_y)))
    rest = [c for c in boxes.columns if c not in ("minx", "miny", "maxx", "maxy")]
    return boxes.select(*rest, F.posexplode(parts).alias("part", "b")).select(*rest, "part", "b.*")


def inset_lattice(boxes: DataFrame, side: int) -> DataFrame:
    """Side x side points, one (side+1)-th of the extent away from the border."""
    dx = (F.col("maxx") - F.col("minx")) / (side + 1)
    dy = (F.col("maxy") - F.col("miny")) / (side + 1)
    steps = F.sequence(F.lit(0), F.lit(side - 1))
    return boxes.withColumn("j", F.explode(steps)).withColumn("i", F.explode(steps)).withColumns(
        {"lon": F.col("minx") + dx * (F.col("i") + 1), "lat": F.col("miny") + dy * (F.col("j") + 1)}
    )


def lattice_side(area_km2: Column) -> Column:
    """C17: side of the sampling lattice, growing with the square root of the area."""
    raw = F.ceil(F.sqrt(F.greatest(area_km2, F.lit(0.0)) / LATTICE_FULL_AREA_KM2) * MAX_LATTICE_SIDE)
    return F.greatest(F.lit(MIN_LATTICE_SIDE), F.least(raw.cast("int"), F.lit(MAX_LATTICE_SIDE)))


def centred_lattice(boxes: DataFrame) -> DataFrame:
    """C17: side x side points at the centres of an even division of the box (side <= 25)."""
    sided = boxes.withColumn("side", lattice_side(F.col("area_km2")))
    steps = F.sequence(F.lit(0), F.col("side") - 1)
    return sided.withColumn("j", F.explode(steps)).withColumn("i", F.explode(steps)).withColumns(
        {
            "lon": F.col("minx") + (F.col("i") + 0.5) * ((F.col("maxx") - F.col("minx")) / F.col("side")),
            "lat": F.col("miny") + (F.col("j") + 0.5) * ((F.col("maxy") - F.col("miny")) / F.col("side")),
        }
    )


def _bilinear(t: Column) -> list[Column]:
    return [1.0 - t, t]


def _cubic(t: Column) -> list[Column]:
    """Catmull-Rom weights of the four taps around t."""
    return [
        -0.5 * t + t**2 - 0.5 * t**3,
        1.0 - 2.5 * t**2 + 1.5 * t**3,
        0.5 * t + 2.0 * t**2 - 1.5 * t**3,
        -0.5 * t**2 + 0.5 * t**3,
    ]


_KERNELS = {"bilinear": (0, 1, _bilinear), "cubic": (1, 2, _cubic)}


def resample(targets: DataFrame, source: DataFrame, method: str = "bilinear") -> DataFrame:
    """C11: source raster values on target cells.

    ``targets`` carries fractional source indices (src_row, src_col; centres are whole
    numbers) and ``source`` is (scene_id, row, col, value) with one row per pixel. Source
    pixels gather their patch once, so every kernel needs a single equi-join instead of one
    join per tap. The weighted sum is renormalised over the pixels that have a value. Pixels are
    never broadcast: files of rasters are far smaller than their rows.
    """
    if method == "average":
        hits = source.select("scene_id", "value", "target_row", "target_col")
        return (
            hits.groupBy("scene_id", F.col("target_row").alias("row"), F.col("target_col").alias("col"))
            .agg(F.avg("value").alias("value"))
        )
    if method == "nearest":
        placed = targets.withColumns(
            {"_r": F.floor(F.col("src_row") + 0.5).cast("int"), "_c": F.floor(F.col("src_col") + 0.5).cast("int")}
        )
        picked = source.select(
            "scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), "value"
        )
        return placed.join(picked.hint("merge"), ["scene_id", "_r", "_c"], "left").drop("_r", "_c", "src_row", "src_col")
    if method not in _KERNELS:
        raise ValueError(f"unknown resampling {method!r}")
    before, after, kernel = _KERNELS[method]
    # A pixel ring outside the raster lets edge targets find a base pixel.
    patches = with_patch(source, ["scene_id"], "value", before, after).select(
        "scene_id", F.col("row").alias("_r"), F.col("col").alias("_c"), "patch"
    )
    placed = targets.withColumns(
        {"_r": F.floor("src_row").cast("int"), "_c": F.floor("src_col").cast("int")}
    ).withColumns({"_v": F.col("src_row") - F.col("_r"), "_u": F.col("src_col") - F.col("_c")})
    down, across = kernel(F.col("_v")), kernel(F.col("_u"))
    weights = F.array(*(d * a for d in down for a in across))
    pairs = F.arrays_zip(F.col("patch").alias("v"), weights.alias("w"))
    used = F.filter(pairs, lambda p: p["v"].isNotNull())
    total = F.aggregate(used, F.lit(0.0), lambda s, p: s + p["w"] * p["v"])
    weight = F.aggregate(used, F.lit(0.0), lambda s, p: s + p["w"])
    return (
        placed.join(patches.hint("merge"), ["scene_id", "_r", "_c"], "left")
        .withColumn("value", total / F.nullif(weight, F.lit(0.0)))
        .drop("_r", "_c", "_u", "_v", "patch", "src_row", "src_col")
    )


def source_indices(cells: DataFrame, grids: DataFrame, affine: DataFrame) -> DataFrame:
    """C11 with C3: where each cell's centre lies in its scene's WGS-84 raster.

    ``cells`` (scene_id, row, col, x, y), ``grids`` gives the EPSG code, ``affine`` (scene_id, west, north,
    dlon, dlat) the raster's outer north-west corner and pixel size. Adds src_row and src_col, in
    which pixel centres are whole numbers; NULL in scenes without a raster.
    """
    coded = cells.join(grids.select("scene_id", "epsg"), "scene_id")
    located = with_lonlat(coded, "x", "y", "epsg", "_lon", "_lat").join(
        affine.select("scene_id", "west", "north", "dlon", "dlat"), "scene_id", "left"
    )
    return located.withColumns(
        {
            "src_row": (F.col("north") - F.col("_lat")) / F.col("dlat") - 0.5,
            "src_col": (F.col("_lon") - F.col("west")) / F.col("dlon") - 0.5,
        }
    ).drop("epsg", "_lon", "_lat", "west", "north", "dlon", "dlat")


def target_indices(source: DataFrame, grids: DataFrame, affine: DataFrame) -> DataFrame:
    """The other way round, for averages: the cell that holds each pixel's centre (target_row, target_col)."""
    spec = affine.join(grids.select("scene_id", "epsg", "minx", "maxy", "resolution_m", F.col("width").alias("_w"), F.col("height").alias("_h")), "scene_id")
    placed = source.join(spec, "scene_id").withColumns(
        {
            "_lon": F.col("west") + (F.col("col") + 0.5) * F.col("dlon"),
            "_lat": F.col("north") - (F.col("row") + 0.5) * F.col("dlat"),
        }
    )
    metres = with_utm(placed, "_lon", "_lat", "epsg", "_x", "_y").withColumns(
        {
            "target_row": F.floor((F.col("maxy") - F.col("_y")) / F.col("resolution_m")).cast("int"),
            "target_col": F.floor((F.col("_x") - F.col("minx")) / F.col("resolution_m")).cast("int"),
        }
    )
    inside = F.col("target_row").between(0, F.col("_h") - 1) & F.col("target_col").between(0, F.col("_w") - 1)
    return metres.filter(inside).select(*source.columns, "target_row", "target_col")


def warp(cells: DataFrame, grids: DataFrame, source: DataFrame, affine: DataFrame, method: str = "bilinear") -> DataFrame:
    """C11: a WGS-84 raster (scene_id, row, col, value) on the cells of the working grid.

    ``affine`` also gives the raster's width and height in pixels. Cells that no pixel reaches are NULL.
    """
    if method == "average":
        means = resample(cells, target_indices(source, grids, affine), "average")
        return cells.join(means, ["scene_id", "row", "col"], "left")
    targets = source_indices(cells, grids, affine)
    ring = 0 if method == "nearest" else _KERNELS[method][1] + 1
    padded = pad_raster(source, affine, ring) if ring else source
    return resample(targets, padded, method)


def pad_raster(source: DataFrame, grids: DataFrame, ring: int) -> DataFrame:
    """Adds ``ring`` lines of missing pixels around a raster (for targets at its border)."""
    lines = grids.select(
        "scene_id",
        F.explode(F.sequence(F.lit(-ring), F.col("height") - 1 + ring)).alias("row"),
        "width",
        "height",
    ).repartition("scene_id", "row")
    cols = F.sequence(F.lit(-ring), F.col("width") - 1 + ring)
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("height"))
    rim = F.when(inside, F.filter(cols, lambda c: (c < 0) | (c >= F.col("width")))).otherwise(cols)
    empty = lines.select("scene_id", "row", F.explode(rim).alias("col"), F.lit(None).cast("double").alias("value"))
    return source.select("scene_id", "row", "col", "value").unionByName(empty)
