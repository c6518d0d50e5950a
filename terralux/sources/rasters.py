"""Tiled rasters, protected areas and dataset assembly."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralux import schema
from terralux.functions.bind import bind
from terralux.functions.geodesy import with_lonlat
from terralux.operators.grids import align, covering_tiles, resample, warp
from terralux.operators.vectors import areas_meeting_boxes
from terralux.session import cut, is_committed, scratch_path, write_plain

# Fixed value: missing-elevation code of the tiles.
NO_ELEVATION = -9999.0


def mosaic(pixels: DataFrame, keys: list[str], value: str = "value", order: str = "tile_order") -> DataFrame:
    """Overlapping tile pixels to one, the first tile with a value wins.

    A combining aggregate: duplicates are dropped before the shuffle.
    """
    usable = pixels.filter(F.col(value).isNotNull())
    return usable.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def elevation_pixels(tiles: DataFrame, value: str = "value") -> DataFrame:
    """The missing code becomes NULL."""
    return tiles.withColumn(value, F.nullif(F.col(value), F.lit(NO_ELEVATION)))


def write_tiles(pixels: DataFrame, path: str) -> None:
    """Pixels (tile_lat, tile_lon, pixel_row, pixel_col, value) as one folder per tile; rows count from the tile's north-west corner."""
    # Rebalanced: a task sorts a bounded share of the pixels by folder, however many there are.
    pixels.hint("rebalance", "tile_lat", "tile_lon").write.mode("overwrite").partitionBy("tile_lat", "tile_lon").parquet(path)


def _on_globe() -> Column:
    return F.col("tile_lat").between(-90, 89) & F.col("tile_lon").between(-180, 179)


def _chosen_tiles(spark: SparkSession, path: str, tiles: DataFrame) -> DataFrame:
    """Pixels of these tiles. The path is partitioned by tile_lat and tile_lon, and the tiles are broadcast, so that
    the folders are chosen at run time; there are 64,800 tiles of a degree on the globe."""
    chosen = tiles.select("tile_lat", "tile_lon").distinct().filter(_on_globe())
    return spark.read.parquet(path).join(F.broadcast(chosen), ["tile_lat", "tile_lon"], "left_semi")


def read_tiles(spark: SparkSession, path: str, covering: DataFrame) -> DataFrame:
    """Pixels of the covering tiles of every scene, with ``scene_id``; a scene has a handful of tiles."""
    needed = covering.select("scene_id", "tile_lat", "tile_lon").distinct()
    return _chosen_tiles(spark, path, needed).join(needed, ["tile_lat", "tile_lon"])


def _touched_tiles(located: DataFrame, step: int, margin: float) -> DataFrame:
    """(tile_lat, tile_lon) of the tiles within ``margin`` degrees of any position; combined on the map side."""

    def near(at: str) -> Column:
        return F.array_distinct(F.array(*(F.floor((F.col(at) + by) / step) * step for by in (-margin, margin))))

    return located.select(F.explode(near("lat")).alias("tile_lat"), "lon").select("tile_lat", F.explode(near("lon")).alias("tile_lon")).distinct()


def tiles_to_cells(
    spark: SparkSession, path: str, cells: DataFrame, grids: DataFrame, step: int, pixels_per_degree: int, method: str, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """A tiled WGS-84 raster on the cells (scene_id, row, col, x, y) of every scene, as ``value``.

    The tiles are those that a cell touches, with a margin of the kernel's reach, so that a kernel meets the pixels
    beyond a tile's border. They are one raster with rows from 90 N and columns from 180 W, which all scenes
    share: a pixel is read once however many scenes need it, and a long scene needs no tiles beside its cells.
    The first tile with a value wins where they overlap. Missing tiles leave missing pixels.
    """
    at = cells.select("scene_id", "row", "col", "x", "y")
    located = with_lonlat(at.join(grids.select("scene_id", "epsg"), "scene_id"), "x", "y", "epsg")
    margin = 3.0 / pixels_per_degree
    if method == "average":
        return _averaged_tiles(spark, path, at, located, grids, step, pixels_per_degree, margin, prepare)
    tiles = cut(_touched_tiles(located, step, margin), "tiles")
    pixels = _chosen_tiles(spark, path, tiles)
    pixels = prepare(pixels) if prepare else pixels

    def place(df: DataFrame, *more: Column) -> DataFrame:
        return df.select(
            F.lit("globe").alias("scene_id"),
            ((90 - F.col("tile_lat") - step) * pixels_per_degree + F.col("pixel_row")).cast("int").alias("row"),
            ((F.col("tile_lon") + 180) * pixels_per_degree + F.col("pixel_col")).cast("int").alias("col"),
            *more,
        )

    raster = mosaic(place(pixels, F.col("value").cast("double").alias("value"), F.struct("tile_lat", "tile_lon").alias("tile_order")), ["scene_id", "row", "col"])
    if method != "nearest":
        # Kernels read a patch around each pixel, so places without a pixel must be rows too.
        line = F.sequence(F.lit(0), F.lit(step * pixels_per_degree - 1))
        lines = tiles.select("*", F.explode(line).alias("pixel_row")).repartition("tile_lat", "tile_lon", "pixel_row")
        raster = place(lines.select("*", F.explode(line).alias("pixel_col"))).join(raster.hint("merge"), ["scene_id", "row", "col"], "left")
    # Bound, as pixels are joined by them: Spark follows the keys of a join back to a scan by putting in what they are computed from,
    # and the repeated steps of a latitude, written out as one expression, fill the driver's heap.
    placed = bind(located, {"src_row": (90.0 - F.col("lat")) * pixels_per_degree - 0.5, "src_col": (F.col("lon") + 180.0) * pixels_per_degree - 0.5})
    targets = placed.select(F.lit("globe").alias("scene_id"), F.col("scene_id").alias("_scene"), "row", "col", "x", "y", "src_row", "src_col")
    return resample(targets, raster, method).drop("scene_id").select(F.col("_scene").alias("scene_id"), "row", "col", "x", "y", "value")


def _averaged_tiles(
    spark: SparkSession, path: str, at: DataFrame, located: DataFrame, grids: DataFrame, step: int, pixels_per_degree: int, margin: float, prepare: Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    """Means of the pixels in each cell: a pixel counts once in every scene that holds it, so each scene takes the tiles of its box."""
    boxes = located.groupBy("scene_id").agg(
        (F.min("lon") - margin).alias("minx"), (F.min("lat") - margin).alias("miny"), (F.max("lon") + margin).alias("maxx"), (F.max("lat") + margin).alias("maxy")
    )
    covering = cut(covering_tiles(boxes, step).select("scene_id", "tile_lat", "tile_lon"), "tiles")
    size = 1.0 / pixels_per_degree
    span = covering.groupBy("scene_id").agg(
        F.min("tile_lon").cast("double").alias("west"), (F.max("tile_lat") + step).cast("double").alias("north")
    ).withColumns({"dlon": F.lit(size), "dlat": F.lit(size)})
    pixels = read_tiles(spark, path, covering)
    pixels = prepare(pixels) if prepare else pixels
    # A scene's tiles are pixels of one raster: rows from its north edge, columns from its west edge.
    placed = pixels.join(span.select("scene_id", "west", "north"), "scene_id").select(
        "scene_id",
        ((F.col("north") - F.col("tile_lat") - step) * pixels_per_degree + F.col("pixel_row")).cast("int").alias("row"),
        ((F.col("tile_lon") - F.col("west")) * pixels_per_degree + F.col("pixel_col")).cast("int").alias("col"),
        F.col("value").cast("double").alias("value"), F.struct("tile_lat", "tile_lon").alias("tile_order"),
    )
    return warp(at, grids, mosaic(placed, ["scene_id", "row", "col"]), span, "average")


def with_fallback(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The secondary raster where the primary has no pixel or no value."""
    joined = primary.select(*keys, F.col(value).alias("_first")).join(
        secondary.select(*keys, F.col(value).alias("_second")), keys, "full"
    )
    return joined.select(*keys, F.coalesce("_first", "_second").alias(value))


def curve_place(x: Column, y: Column, extent: tuple[float, float, float, float], bits: int = 15) -> Column:
    """Place on a Z-shaped curve through the extent (minx, miny, maxx, maxy): near places have near numbers."""
    last = 2**bits - 1

    def step(at: Column, low: float, high: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(last), F.floor((at - low) / max(high - low, 1e-9) * last))).cast("bigint")

    i, j = step(x, extent[0], extent[2]), step(y, extent[1], extent[3])
    both = [(F.shiftright(of, k).bitwiseAND(F.lit(1)), 2 * k + odd) for k in range(bits) for odd, of in enumerate((i, j))]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(bit.cast("bigint"), to) for bit, to in both])


def write_protected(areas: DataFrame, path: str) -> None:
    """Areas in the order of a curve through their boxes' middles, so that a reader skips row groups far from its box."""
    e = areas.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    extent = tuple(0.0 if v is None else float(v) for v in e)
    middle = curve_place((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, extent)
    placed = areas.withColumn("_place", middle)
    placed.repartitionByRange("_place").sortWithinPartitions("_place").drop("_place").write.mode("overwrite").parquet(path)


def read_protected(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, bool]:
    """The protected-area table; a missing path gives an empty table and False.

    With a box (minx, miny, maxx, maxy) only areas whose box meets it; the scan skips what its statistics rule out.
    """
    try:
        areas = spark.read.schema(schema.PROTECTED).parquet(path)
    except AnalysisException as error:
        # Anything else, such as a denied path, is not "no protected areas".
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema.PROTECTED), False
    if box is not None:
        minx, miny, maxx, maxy = map(float, box)
        areas = areas.filter((F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy))
    return areas, True


def protected_in_boxes(areas: DataFrame, boxes: DataFrame, **options) -> DataFrame:
    """Areas meeting each scene's box (columns scene_id plus those of ``areas``); options as for J8."""
    return areas_meeting_boxes(areas, boxes, **options)


def merge_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Shards with differing columns as one table."""
    merged = spark.read.parquet(paths[0])
    for path in paths[1:]:
        merged = merged.unionByName(spark.read.parquet(path), allowMissingColumns=True)
    return merged


#: What a source may fail with; anything else is a mistake of the program and is not caught.
SOURCE_ERRORS = (PySparkException, Py4JJavaError, OSError)


def _committed(spark: SparkSession, provide: Callable[[], DataFrame], path: str) -> DataFrame:
    """The source's table, written and committed on its own; a table committed earlier is read again."""
    if not is_committed(spark, path):
        # Plain, as every layer is joined to the grid.
        write_plain(provide(), path)
    return spark.read.parquet(path)


def assemble(
    base: DataFrame, providers: dict[str, Callable[[], DataFrame] | list[Callable[[], DataFrame]]], store: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Layers joined to the grid; a source that fails, also while it runs, is skipped and reported.

    A layer may have several sources, which are tried in order (S14). Each is written to a folder of its own, below ``store``
    if given, where a later call finds those already committed. Returns (cells, report) with report =
    (layer, source, reason): a row per failed source, numbered from 0.
    """
    spark, layers, failed = base.sparkSession, [], []
    for name, sources in providers.items():
        path = f"{store}/{name}" if store else scratch_path(spark, f"layer-{name}")
        for number, provide in enumerate(sources if isinstance(sources, list) else [sources]):
            try:
                layers.append(_committed(spark, provide, path))
                break
            except SOURCE_ERRORS as error:
                failed.append((name, number, f"{type(error).__name__}: {str(error).splitlines()[0][:200]}"))
    report = spark.createDataFrame(failed, "layer STRING, source INT, reason STRING")
    return align(base, *layers), report
