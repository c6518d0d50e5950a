"""Candidate sites from classified cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terralux.functions.geodesy import with_lonlat
from terralux.operators.components import label_regions, position_col, position_row
from terralux.operators.grids import cell_area_km2
from terralux.operators.numbering import hierarchical_row_number
from terralux.operators.polygons import polygon_centroids, site_polygons, site_rings
from terralux.session import cut

# Extraction defaults.
TOP_CLASSES = (5,)
MIN_AREA_KM2 = 0.5
TOP_K = 10

PIECE = ["first_row", "first_col", "tile_r", "tile_c"]


def top_class_mask(cells: DataFrame, classes: Sequence[int] = TOP_CLASSES, cls: str = "lsi_class") -> DataFrame:
    """R1."""
    return cells.filter(F.col(cls).isin(*classes))


def tile_side(max_area_km2: float, cell_area: Column, strict: bool = False) -> Column:
    """Side of the split square in cells. Rounding may exceed the cap; ``strict`` never does."""
    root = F.sqrt(max_cells(max_area_km2, cell_area))
    return F.greatest(F.lit(1), (F.floor(root) if strict else F.rint(root)).cast("int"))


def max_cells(max_area_km2: float, cell_area: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(max_area_km2) / cell_area))


def split_regions(mask: DataFrame, grids: DataFrame, max_area_km2: float | None, strict: bool = False) -> DataFrame:
    """R2 + R4 / W9: mask cells with the piece they belong to.

    A piece is (first_row, first_col, tile_r, tile_c): the first cell of its region and its
    tile on a square grid anchored at the region's least row and column. Regions under the
    cap have the single tile (0, 0).
    """
    labelled, regions = label_regions(mask)
    merged = regions.groupBy("scene_id", "region").agg(
        F.sum("cells").alias("region_cells"), F.min("rmin").alias("r0"), F.min("cmin").alias("c0")
    )
    # One row per block label; a hot region is at most a few rows per block here.
    plan = regions.select("scene_id", "label", "region").join(merged, ["scene_id", "region"])
    if max_area_km2 is None:
        plan = plan.withColumn("side", F.lit(None).cast("int"))
    else:
        spec = grids.select("scene_id", cell_area_km2(F.col("resolution_m")).alias("_area"))
        plan = plan.join(spec, "scene_id").withColumn(
            "side",
            F.when(
                F.col("region_cells") > max_cells(max_area_km2, F.col("_area")),
                tile_side(max_area_km2, F.col("_area"), strict),
            ),
        )

    def tile(at: str, origin: str) -> Column:
        return F.coalesce(F.floor((F.col(at) - F.col(origin)) / F.col("side")).cast("int"), F.lit(0))

    return (
        labelled.join(plan, ["scene_id", "label"])
        .select(
            "scene_id",
            "row",
            "col",
            position_row(F.col("region")).alias("first_row"),
            position_col(F.col("region")).alias("first_col"),
            tile("row", "r0").alias("tile_r"),
            tile("col", "c0").alias("tile_c"),
        )
    )


def number_pieces(pieces: DataFrame) -> DataFrame:
    """1-based site_id in raster order of regions, then of tiles, counted level by level."""
    return hierarchical_row_number(pieces, ["scene_id"], PIECE, "site_id")


def site_statistics(site_cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Per piece cell count, area, mean and maximum score, mean line distance, centroid.

    Missing values are skipped. The mean of equal squares' centres is the area centroid.
    """
    spec = grids.select("scene_id", "epsg", cell_area_km2(F.col("resolution_m")).alias("_area"))
    has_ptl = "dist_power" in site_cells.columns
    ptl = F.avg("dist_power") if has_ptl else F.lit(None).cast("double")
    stats = site_cells.groupBy("scene_id", *PIECE).agg(
        F.count("*").alias("cells"),
        F.avg("lsi").alias("mean_lsi"),
        F.max("lsi").alias("max_lsi"),
        ptl.alias("mean_ptl_dist"),
        F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
    )
    return stats.join(spec, "scene_id").withColumn("area_km2", F.col("cells") * F.col("_area")).drop("_area")


def rank_sites(sites: DataFrame, top_k: int | None = TOP_K) -> DataFrame:
    """Rank per scene by mean score, area, line distance, number; missing values last.

    Sums differ in their last bits between runs, so scores and distances are compared to 12
    and 6 decimals. With a limit Spark keeps top_k rows per task before the shuffle.
    """
    order = W.partitionBy("scene_id").orderBy(
        F.desc_nulls_last(F.round("mean_lsi", 12)),
        F.desc("area_km2"),
        F.asc_nulls_last(F.round("mean_ptl_dist", 6)),
        F.asc("site_id"),
    )
    ranked = sites.withColumn("rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


def extract_sites(
    cells: DataFrame,
    grids: DataFrame,
    classes: Sequence[int] = TOP_CLASSES,
    min_area_km2: float = MIN_AREA_KM2,
    max_site_area_km2: float | None = None,
    top_k: int | None = TOP_K,
    strict: bool = False,
    simplify_tolerance_m: float | None = None,
) -> DataFrame:
    """Ranked sites of every scene. An input without a matching cell gives an empty table
    with the same columns (R10). With a tolerance, also 0.0, sites carry their outlines, see :func:`with_outlines`."""
    sites, members = extract_with_cells(cells, grids, classes, min_area_km2, max_site_area_km2, top_k, strict)
    return sites if simplify_tolerance_m is None else with_outlines(sites, members, grids, simplify_tolerance_m)


def with_outlines(sites: DataFrame, members: DataFrame, grids: DataFrame, simplify_tolerance_m: float = 0.0) -> DataFrame:
    """Adds ``polygons``, simplified by the tolerance, and takes the centroid from their corners.

    Area and rank stay those of the cells. Polygons that enclose nothing after simplification keep the cells' centroid.
    """
    sites = cut(sites, "outlined-sites")
    rings = cut(site_rings(cut(members, "outlined-cells"), grids, simplify_tolerance_m), "outlined-rings")
    at = polygon_centroids(rings).select("scene_id", "site_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    key = ["scene_id", "site_id"]
    moved = sites.join(at, key, "left").withColumns({"centroid_x": F.coalesce("_x", "centroid_x"), "centroid_y": F.coalesce("_y", "centroid_y")})
    moved = with_lonlat(moved.drop("_x", "_y", "centroid_lon", "centroid_lat"), "centroid_x", "centroid_y", "epsg", "centroid_lon", "centroid_lat")
    return moved.select(*sites.columns).join(site_polygons(rings), key, "left")


def extract_with_cells(
    cells: DataFrame,
    grids: DataFrame,
    classes: Sequence[int] = TOP_CLASSES,
    min_area_km2: float = MIN_AREA_KM2,
    max_site_area_km2: float | None = None,
    top_k: int | None = TOP_K,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """R8 plus the member cells of the returned sites (scene_id, site_id, row, col).

    ``cells`` is read more than once, so it should be a stored table.
    """
    needed = ["lsi", "lsi_class", "x", "y"]
    missing = [c for c in needed if c not in cells.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    values = ["lsi", "x", "y", *(["dist_power"] if "dist_power" in cells.columns else [])]
    mask = top_class_mask(cells, classes).select("scene_id", "row", "col", *values)
    # Pieces and numbers are read twice: by the sites and by their cells.
    member = cut(split_regions(mask.select("scene_id", "row", "col"), grids, max_site_area_km2, strict), "pieces")
    stats = cut(site_statistics(member.join(mask, ["scene_id", "row", "col"]), grids), "sites")
    large = number_pieces(stats).filter(F.col("area_km2") >= min_area_km2)
    ranked = with_lonlat(rank_sites(large, top_k), "centroid_x", "centroid_y", "epsg", "centroid_lon", "centroid_lat")
    chosen = ranked.select(
        "scene_id",
        "site_id",
        "area_km2",
        "mean_lsi",
        "max_lsi",
        "centroid_x",
        "centroid_y",
        "centroid_lon",
        "centroid_lat",
        "mean_ptl_dist",
        "rank",
        "epsg",
        *PIECE,
    )
    sites = cut(chosen, "ranked")
    inside = member.join(sites.select("scene_id", "site_id", *PIECE), ["scene_id", *PIECE]).select(
        "scene_id", "site_id", "row", "col"
    )
    return sites.drop(*PIECE), inside
