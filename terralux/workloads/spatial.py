"""Grids, projections, terrain, distances, regions and sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralux import schema
from terralux.functions import geodesy as g
from terralux.operators import aoi as ao
from terralux.operators import components, energy, grids as gr, polygons, proximity, sites, terrain, vectors
from terralux.operators.interpolate import interpolate
from terralux.operators.quantiles import quantiles
from terralux.plans.sources import sites_from_sources
from terralux.plans.suitability import SITE_CAP_KM2, SITE_CLASSES, classified_cells, select_sites
from terralux.session import cut, scratch_path, spread
from terralux.sinks import tables as sink
from terralux.sources import rasters
from terralux.sources.documents import parse_areas
from terralux.workloads.catalog import query
from terralux.workloads.inputs import (
    BASE_SQL,
    EPSG,
    FEATURES_SQL,
    KINDS,
    LAND_COVER,
    LAYERS,
    MAXY,
    MINX,
    RESOLUTION_M,
    base_cells,
    cells,
    cells_sql,
    duck_text,
    feature_cells,
    grids,
    table,
)
from terralux.workloads.land import CELL, QUANTILE_SQL, REG

GRIDS_SQL = f"""
grids AS (SELECT scene_id, {MINX}::DOUBLE AS minx, {MAXY}::DOUBLE - (max(row) + 1) * {RESOLUTION_M}.0 AS miny,
  {MINX}::DOUBLE + (max(col) + 1) * {RESOLUTION_M}.0 AS maxx, {MAXY}::DOUBLE AS maxy, max(col) + 1 AS width, max(row) + 1 AS height
  FROM base GROUP BY scene_id)"""


# ---- projections as SQL text, for the checks -------------------------------------------


def _series_sql(base: str, terms, f1: str, f2: str, xi: str, eta: str, sign: str) -> str:
    return base + "".join(
        f" {sign} {c!r}::DOUBLE * {f1}({2.0 * j} * {xi}) * {f2}({2.0 * j} * {eta})" for j, c in enumerate(terms, 1)
    )


def forward_sql(source: str, name: str, keep: str) -> str:
    """CTEs that add x, y from lon, lat, epsg."""
    e, k = repr(g.ECC), repr(g.UTM_SCALE * g.RECTIFYING)
    east = _series_sql("eta", g.FORWARD_SERIES, "cos", "sinh", "xi", "eta", "+")
    north = _series_sql("xi", g.FORWARD_SERIES, "sin", "cosh", "xi", "eta", "+")
    return f"""
{name}_1 AS (SELECT {keep}, epsg, tan(radians(lat)) AS t, radians(lon) - radians((epsg % 100) * 6.0 - 183.0) AS lam FROM {source}),
{name}_2 AS (SELECT *, sinh({e}::DOUBLE * atanh({e}::DOUBLE * t / sqrt(1 + t * t))) AS sg FROM {name}_1),
{name}_3 AS (SELECT *, t * sqrt(1 + sg * sg) - sg * sqrt(1 + t * t) AS tp FROM {name}_2),
{name}_4 AS (SELECT *, atan2(tp, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tp * tp + cos(lam) * cos(lam))) AS eta FROM {name}_3),
{name} AS (SELECT {keep}, epsg, 500000.0 + {k}::DOUBLE * ({east}) AS x,
  {k}::DOUBLE * ({north}) + CASE WHEN epsg >= 32700 THEN 10000000.0 ELSE 0.0 END AS y FROM {name}_4)"""


def inverse_sql(source: str, name: str, keep: str) -> str:
    """CTEs that add lon, lat from x, y, epsg."""
    e, e2, k = repr(g.ECC), repr(g.ECC2), repr(g.UTM_SCALE * g.RECTIFYING)
    xp = _series_sql("xi", g.INVERSE_SERIES, "sin", "cosh", "xi", "eta", "-")
    ep = _series_sql("eta", g.INVERSE_SERIES, "cos", "sinh", "xi", "eta", "-")
    text = f"""
{name}_1 AS (SELECT {keep}, epsg, (y - CASE WHEN epsg >= 32700 THEN 10000000.0 ELSE 0.0 END) / {k}::DOUBLE AS xi, (x - 500000.0) / {k}::DOUBLE AS eta FROM {source}),
{name}_2 AS (SELECT {keep}, epsg, {xp} AS xp, {ep} AS ep FROM {name}_1),
{name}_3 AS (SELECT *, sin(xp) / sqrt(sinh(ep) * sinh(ep) + cos(xp) * cos(xp)) AS tp, sin(xp) / sqrt(sinh(ep) * sinh(ep) + cos(xp) * cos(xp)) AS t FROM {name}_2)"""
    last = f"{name}_3"
    for i in range(3):
        text += f""",
{name}_s{i} AS (SELECT *, sinh({e}::DOUBLE * atanh({e}::DOUBLE * t / sqrt(1 + t * t))) AS sg FROM {last}),
{name}_i{i} AS (SELECT *, t * sqrt(1 + sg * sg) - sg * sqrt(1 + t * t) AS ti FROM {name}_s{i}),
{name}_n{i} AS (SELECT * EXCLUDE (t, sg, ti), t + (tp - ti) / sqrt(1 + ti * ti) * (1 + (1 - {e2}::DOUBLE) * t * t) / ((1 - {e2}::DOUBLE) * sqrt(1 + t * t)) AS t FROM {name}_i{i})"""
        last = f"{name}_n{i}"
    return text + f""",
{name} AS (SELECT {keep}, epsg, degrees(radians((epsg % 100) * 6.0 - 183.0) + atan2(sinh(ep), cos(xp))) AS lon, degrees(atan(t)) AS lat FROM {last})"""


# ---- points derived from customers -----------------------------------------------------

PTS_SQL = """pts AS (SELECT c_custkey AS id, CAST(-179 + (c_custkey * 7) % 358 AS DOUBLE) + 0.25 AS lon,
  CAST(-70 + (c_custkey * 11) % 140 AS DOUBLE) + 0.5 AS lat FROM customer)"""
EPSG_SQL = "CAST(CAST(floor((lon + 180.0) / 6.0) AS INTEGER) % 60 + 1 + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS INTEGER)"


def points(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CAST(-179 + (c_custkey * 7) % 358 AS DOUBLE) + 0.25D AS lon",
        "CAST(-70 + (c_custkey * 11) % 140 AS DOUBLE) + 0.5D AS lat",
    )
    return df.withColumn("epsg", g.utm_epsg(F.col("lon"), F.col("lat")))


@query("c1_utm_zone", f"WITH {PTS_SQL} SELECT id, {EPSG_SQL} AS epsg FROM pts")
def c1_utm_zone(spark, sf_dir):
    return points(spark, sf_dir).select("id", "epsg")


@query(
    "c3_projection_round_trip",
    f"WITH {PTS_SQL}, src AS (SELECT *, {EPSG_SQL} AS epsg FROM pts),{forward_sql('src', 'fwd', 'id')},{inverse_sql('fwd', 'inv', 'id')}"
    " SELECT id, round(f.x, 3) AS x, round(f.y, 3) AS y, round(i.lon, 7) AS lon, round(i.lat, 7) AS lat FROM fwd f JOIN inv i USING (id)",
)
def c3_projection_round_trip(spark, sf_dir):
    there = g.with_utm(points(spark, sf_dir), "lon", "lat", "epsg").drop("lon", "lat")
    back = g.with_lonlat(there, "x", "y", "epsg")
    return back.select(
        "id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat")
    )


# ---- areas of interest derived from suppliers ------------------------------------------

# A rectangle per supplier as a GeoJSON document; some documents are faulty on purpose.
BOX_SQL = """box AS (SELECT s_suppkey AS id, s_suppkey % 12 AS f, CAST(-170 + (s_suppkey * 13) % 330 AS DOUBLE) AS x0,
  CAST(-60 + (s_suppkey * 7) % 110 AS DOUBLE) AS y0,
  CASE WHEN s_suppkey % 12 = 8 THEN 3.0::DOUBLE ELSE CAST(1 + s_suppkey % 8 AS DOUBLE) / 8.0 END AS w, CAST(1 + s_suppkey % 4 AS DOUBLE) / 8.0 AS h FROM supplier)"""

_POINT = "concat('[', CAST({} AS STRING), ',', CAST({} AS STRING), ']')"


def area_documents(spark, sf_dir):
    """Document kinds by s_suppkey % 12: bow tie (7), too large (8), line (9), two features (10), null geometry (11),
    feature (1), collection (2), multipolygon (3), else a bare polygon."""
    box = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS aoi_id",
        "s_suppkey % 12 AS f",
        "CAST(-170 + (s_suppkey * 13) % 330 AS DOUBLE) AS x0",
        "CAST(-60 + (s_suppkey * 7) % 110 AS DOUBLE) AS y0",
        "CASE WHEN s_suppkey % 12 = 8 THEN 3.0D ELSE CAST(1 + s_suppkey % 8 AS DOUBLE) / 8.0D END AS w",
        "CAST(1 + s_suppkey % 4 AS DOUBLE) / 8.0D AS h",
    )
    p = [_POINT.format(x, y) for x, y in (("x0", "y0"), ("x0 + w", "y0"), ("x0 + w", "y0 + h"), ("x0", "y0 + h"))]

    def ring(order):
        return "concat('[', " + ", ',', ".join(p[i] for i in order) + ", ']')"

    doc = box.selectExpr(
        "*",
        f"IF(f = 7, {ring((0, 2, 1, 3, 0))}, {ring((0, 1, 2, 3, 0))}) AS ring",
    ).selectExpr(
        "*",
        """CASE WHEN f = 3 THEN concat('{"type":"MultiPolygon","coordinates":[[', ring, ']]}')
             WHEN f = 9 THEN concat('{"type":"LineString","coordinates":', ring, '}')
             ELSE concat('{"type":"Polygon","coordinates":[', ring, ']}') END AS geom""",
    )
    return doc.selectExpr(
        "aoi_id",
        """CASE WHEN f = 1 THEN concat('{"type":"Feature","properties":{},"geometry":', geom, '}')
             WHEN f = 2 THEN concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":', geom, '}]}')
             WHEN f = 10 THEN concat('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":', geom, '},{"type":"Feature","geometry":', geom, '}]}')
             WHEN f = 11 THEN '{"type":"Feature","geometry":null}' ELSE geom END AS text""",
    )


def areas(spark, sf_dir):
    return ao.with_faults(ao.with_measures(parse_areas(area_documents(spark, sf_dir))))


def _q(lat: str) -> str:
    s, e, e2 = f"sin(radians({lat}))", repr(g.ECC), repr(g.ECC2)
    return (
        f"((1 - {e2}::DOUBLE) * ({s} / (1 - {e2}::DOUBLE * {s} * {s}) - 1 / (2 * {e}::DOUBLE) * ln((1 - {e}::DOUBLE * {s}) / (1 + {e}::DOUBLE * {s}))))"
    )


# A rectangle's equal-area size has a closed form; the bow tie's two triangles cancel out.
AREA_SQL = f"""
meas AS (SELECT *, CASE WHEN f = 7 THEN 0.0 ELSE {g.SEMI_MAJOR}::DOUBLE * {g.SEMI_MAJOR}::DOUBLE / 2 * radians(w) * ({_q('y0 + h')} - {_q('y0')}) / 1e6 END AS area_km2 FROM box WHERE f NOT IN (9, 10, 11))"""


@query(
    "s1_aoi_scan",
    f"""WITH {BOX_SQL} SELECT id AS aoi_id, CASE f WHEN 9 THEN 'unsupported_type' WHEN 10 THEN 'not_one_feature' WHEN 11 THEN 'null_geometry' END AS doc_fault,
  CASE WHEN f IN (9, 10, 11) THEN -1 ELSE 5 END AS corners FROM box""",
)
def s1_aoi_scan(spark, sf_dir):
    parsed = parse_areas(area_documents(spark, sf_dir))
    corners = F.when(F.col("polygons").isNull(), F.lit(-1)).otherwise(F.size(F.flatten(F.flatten("polygons"))))
    return parsed.select("aoi_id", "doc_fault", corners.alias("corners"))


@query(
    "c4_equal_area_size",
    f"WITH {BOX_SQL},{AREA_SQL} SELECT id AS aoi_id, round(area_km2, 4) AS area_km2 FROM meas WHERE f <> 7",
)
def c4_equal_area_size(spark, sf_dir):
    df = areas(spark, sf_dir).filter("doc_fault IS NULL AND NOT array_contains(faults, 'self_intersection')")
    return df.select("aoi_id", F.round("area_km2", 4).alias("area_km2"))


@query(
    "c5_c8_aoi_faults",
    f"""WITH {BOX_SQL},{AREA_SQL} SELECT id AS aoi_id, CASE WHEN f = 7 THEN 'self_intersection' WHEN f IN (9) THEN 'unsupported_type' WHEN f = 10 THEN 'not_one_feature'
  WHEN f = 11 THEN 'null_geometry' WHEN area_km2 > 10000 THEN 'too_large' END AS fault FROM box LEFT JOIN meas USING (id, f)
  WHERE f IN (7, 9, 10, 11) OR area_km2 > 10000""",
)
def c5_c8_aoi_faults(spark, sf_dir):
    return areas(spark, sf_dir).select("aoi_id", F.explode("faults").alias("fault"))


@query(
    "c2_c6_bounds_centroid_zone",
    f"""WITH {BOX_SQL}, c AS (SELECT *, x0 + w / 2 AS lon, y0 + h / 2 AS lat FROM box WHERE f NOT IN (7, 9, 10, 11))
SELECT id AS aoi_id, x0 AS minx, y0 AS miny, x0 + w AS maxx, y0 + h AS maxy, round(lon, 8) AS centroid_lon, round(lat, 8) AS centroid_lat, {EPSG_SQL} AS epsg FROM c""",
)
def c2_c6_bounds_centroid_zone(spark, sf_dir):
    df = areas(spark, sf_dir).filter("doc_fault IS NULL AND NOT array_contains(faults, 'self_intersection')")
    return df.select(
        "aoi_id", "minx", "miny", "maxx", "maxy", F.round("centroid_lon", 8).alias("centroid_lon"),
        F.round("centroid_lat", 8).alias("centroid_lat"), "epsg",
    )


@query(
    "c7_aoi_hash",
    f"""WITH {BOX_SQL} SELECT CAST(count(*) AS BIGINT) AS areas, CAST(count(DISTINCT (x0, y0, w, h, f = 7)) AS BIGINT) AS distinct_hashes FROM box WHERE f NOT IN (9, 10, 11)""",
)
def c7_aoi_hash(spark, sf_dir):
    """Equal outlines share a hash, different ones do not."""
    ok = areas(spark, sf_dir).filter("doc_fault IS NULL")
    once = ok.groupBy("hash").agg(F.count("*").alias("n"))
    return once.agg(F.sum("n").alias("areas"), F.count("*").alias("distinct_hashes"))


VALID_SQL = f"{BOX_SQL},{AREA_SQL}, ok AS (SELECT id AS aoi_id, x0, y0, w, h, area_km2 FROM meas WHERE f <> 7 AND area_km2 <= 10000)"


def valid_areas(spark, sf_dir):
    return areas(spark, sf_dir).filter(F.size("faults") == 0)


@query(
    "c9_grid_snap",
    f"""WITH {VALID_SQL}, v AS (SELECT aoi_id, unnest([x0, x0 + w, x0 + w, x0]) AS lon, unnest([y0, y0, y0 + h, y0 + h]) AS lat, x0 + w / 2 AS clon, y0 + h / 2 AS clat FROM ok),
src AS (SELECT aoi_id, lon, lat, {EPSG_SQL.replace('lon', 'clon').replace('lat >', 'clat >')} AS epsg FROM v),{forward_sql('src', 'fwd', 'aoi_id')},
ext AS (SELECT aoi_id, floor(min(x) / 500) * 500 AS minx, floor(min(y) / 500) * 500 AS miny, ceil(max(x) / 500) * 500 AS maxx, ceil(max(y) / 500) * 500 AS maxy FROM fwd GROUP BY 1)
SELECT *, CAST((maxx - minx) / 500 AS INTEGER) AS width, CAST((maxy - miny) / 500 AS INTEGER) AS height FROM ext""",
)
def c9_grid_snap(spark, sf_dir):
    extents = ao.project_extent(valid_areas(spark, sf_dir))
    return gr.snap_grid(extents, F.lit(RESOLUTION_M)).select("aoi_id", "minx", "miny", "maxx", "maxy", "width", "height")


@query(
    "c10_grid_faults",
    """WITH g AS (SELECT s_suppkey, s_suppkey % 9 AS f FROM supplier)
SELECT CAST(s_suppkey AS VARCHAR) AS scene_id, rule FROM (
  SELECT s_suppkey, 'minx_not_below_maxx' AS rule FROM g WHERE f = 1 UNION ALL
  SELECT s_suppkey, 'miny_not_below_maxy' FROM g WHERE f = 2 UNION ALL
  SELECT s_suppkey, 'resolution_not_positive' FROM g WHERE f IN (3, 1))""",
)
def c10_grid_faults(spark, sf_dir):
    specs = table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS scene_id",
        "IF(s_suppkey % 9 = 1, 10.0D, 0.0D) AS minx",
        "IF(s_suppkey % 9 = 2, 10.0D, 0.0D) AS miny",
        "10.0D AS maxx",
        "10.0D AS maxy",
        "CASE s_suppkey % 9 WHEN 3 THEN 0 WHEN 1 THEN -5 ELSE 1 END AS resolution_m",
    )
    return gr.grid_faults(specs)


def _boxes(spark, sf_dir):
    return valid_areas(spark, sf_dir).select(
        F.col("aoi_id").cast("string").alias("scene_id"), "minx", "miny", "maxx", "maxy", "area_km2"
    )


OKBOX_SQL = f"{VALID_SQL}, b AS (SELECT CAST(aoi_id AS VARCHAR) AS scene_id, x0 AS minx, y0 AS miny, x0 + w AS maxx, y0 + h AS maxy, area_km2 FROM ok)"


def _tiles_sql(step: int) -> str:
    return f"""lat{step} AS (SELECT scene_id, maxy, minx, maxx, unnest(range(CAST(floor(miny / {step}) * {step} AS BIGINT), CAST(ceil(maxy / {step}) * {step} AS BIGINT), {step})) AS tile_lat FROM b),
t{step} AS (SELECT scene_id, tile_lat, unnest(range(CAST(floor(minx / {step}) * {step} AS BIGINT), CAST(ceil(maxx / {step}) * {step} AS BIGINT), {step})) AS tile_lon FROM lat{step})"""


_NAME_SQL = (
    "(CASE WHEN tile_lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(tile_lat) AS VARCHAR), 2, '0') || "
    "CASE WHEN tile_lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(tile_lon) AS VARCHAR), 3, '0'))"
)


@query(
    "c13_covering_tiles",
    f"WITH {OKBOX_SQL}, {_tiles_sql(1)}, {_tiles_sql(3)} SELECT scene_id, 1 AS step, tile_lat, tile_lon, {_NAME_SQL} AS tile FROM t1 "
    f"UNION ALL SELECT scene_id, 3, tile_lat, tile_lon, {_NAME_SQL} FROM t3",
)
def c13_covering_tiles(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    both = [
        gr.covering_tiles(boxes, step).withColumn("step", F.lit(step))
        for step in (gr.ELEVATION_TILE_DEG, gr.LAND_COVER_TILE_DEG)
    ]
    return both[0].unionByName(both[1]).select(
        "scene_id", "step", "tile_lat", "tile_lon", gr.tile_name(F.col("tile_lat"), F.col("tile_lon")).alias("tile")
    )


@query(
    "c15_quadrant_split",
    f"""WITH {OKBOX_SQL}, q AS (SELECT *, unnest(CASE WHEN area_km2 > 2500 THEN [0, 1, 2, 3] ELSE [-1] END) AS p FROM b)
SELECT scene_id, CAST(greatest(p, 0) AS INTEGER) AS part, CASE WHEN p IN (2, 3) THEN (minx + maxx) / 2 ELSE minx END AS minx,
  CASE WHEN p IN (1, 3) THEN (miny + maxy) / 2 ELSE miny END AS miny, CASE WHEN p IN (0, 1) THEN (minx + maxx) / 2 ELSE maxx END AS maxx,
  CASE WHEN p IN (0, 2) THEN (miny + maxy) / 2 ELSE maxy END AS maxy FROM q""",
)
def c15_quadrant_split(spark, sf_dir):
    return gr.split_large_boxes(_boxes(spark, sf_dir)).drop("area_km2")


@query(
    "c16_inset_lattice",
    f"""WITH {OKBOX_SQL} SELECT scene_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(minx + (maxx - minx) / 6 * (i + 1), 9) AS lon, round(miny + (maxy - miny) / 6 * (j + 1), 9) AS lat
FROM b, range(5) t(i), range(5) u(j)""",
)
def c16_inset_lattice(spark, sf_dir):
    return gr.inset_lattice(_boxes(spark, sf_dir), 5).select(
        "scene_id", "i", "j", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat")
    )


@query(
    "c17_centred_lattice",
    f"""WITH {OKBOX_SQL}, s AS (SELECT *, greatest(2, least(CAST(ceil(sqrt(area_km2 / 10000) * 25) AS INTEGER), 25)) AS side FROM b)
SELECT scene_id, side, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(minx + (i + 0.5) * (maxx - minx) / side, 9) AS lon, round(miny + (j + 0.5) * (maxy - miny) / side, 9) AS lat
FROM s, range(25) t(i), range(25) u(j) WHERE i < side AND j < side""",
)
def c17_centred_lattice(spark, sf_dir):
    return gr.centred_lattice(_boxes(spark, sf_dir)).select(
        "scene_id", "side", "i", "j", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat")
    )


@query(
    "c20_roof_area",
    """WITH p AS (SELECT c_custkey AS id, CAST(c_custkey % 120 - 60 AS DOUBLE) AS lat, CAST(c_custkey % 300 - 150 AS DOUBLE) AS lon,
  CAST(1 + c_custkey % 17 AS DOUBLE) / 1e5 AS w, CAST(1 + c_custkey % 13 AS DOUBLE) / 1e5 AS h FROM customer)
SELECT id, round(radians(w) * radians(h) * 6378137.0 * 6378137.0 * cos(radians(lat + h / 2)), 2) AS area_m2 FROM p""",
)
def c20_roof_area(spark, sf_dir):
    """Rectangular roofs, half of them drawn as open rings."""
    p = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CAST(c_custkey % 120 - 60 AS DOUBLE) AS lat", "CAST(c_custkey % 300 - 150 AS DOUBLE) AS lon",
        "CAST(1 + c_custkey % 17 AS DOUBLE) / 1e5D AS w", "CAST(1 + c_custkey % 13 AS DOUBLE) / 1e5D AS h",
    )
    ring = p.selectExpr(
        "id",
        "array(named_struct('x', lon, 'y', lat), named_struct('x', lon + w, 'y', lat), named_struct('x', lon + w, 'y', lat + h), named_struct('x', lon, 'y', lat + h)) AS open",
    ).selectExpr("id", "IF(id % 2 = 0, open, concat(open, slice(open, 1, 1))) AS ring")
    return ring.select("id", F.round(g.roof_area_m2(F.col("ring")), 2).alias("area_m2"))


@query(
    "c23_array_geometry",
    f"""WITH {PTS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id % 60 AS DOUBLE) ELSE abs(lat) END AS tilt,
  CASE WHEN id % 4 = 0 THEN CAST(id % 360 AS DOUBLE) WHEN lat >= 0 THEN 180.0 ELSE 0.0 END AS azimuth FROM pts""",
)
def c23_array_geometry(spark, sf_dir):
    given = points(spark, sf_dir).selectExpr(
        "id", "lat", "IF(id % 3 = 0, CAST(id % 60 AS DOUBLE), NULL) AS tilt", "IF(id % 4 = 0, CAST(id % 360 AS DOUBLE), NULL) AS azimuth"
    )
    return given.select(
        "id", g.effective_tilt(F.col("tilt"), F.col("lat")).alias("tilt"), g.effective_azimuth(F.col("azimuth"), F.col("lat")).alias("azimuth")
    )


@query(
    "c25_cell_transform",
    f"WITH {BASE_SQL},{GRIDS_SQL} SELECT scene_id, 500.0::DOUBLE AS dx, -500.0::DOUBLE AS dy, minx AS west, maxy AS north, 0.25::DOUBLE AS cell_area_km2 FROM grids",
)
def c25_cell_transform(spark, sf_dir):
    return gr.transform_from_cells(cells(spark, sf_dir, "x", "y"))


@query(
    "s16_cell_generator",
    f"""WITH {BASE_SQL},{GRIDS_SQL}, r AS (SELECT *, unnest(range(height)) AS row FROM grids), c AS (SELECT *, unnest(range(width)) AS col FROM r)
SELECT scene_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, minx + (col + 0.5) * 500 AS x, maxy - (row + 0.5) * 500 AS y FROM c""",
)
def s16_cell_generator(spark, sf_dir):
    return gr.generate_cells(grids(spark, sf_dir))


@query(
    "j1_layer_alignment",
    f"""WITH {cells_sql('ghi_annual', 'slope', 'lulc', keep_base=True)} SELECT scene_id, row, col, ghi_annual, slope, CASE WHEN k % 5 <> 0 THEN lulc END AS lulc FROM cells""",
)
def j1_layer_alignment(spark, sf_dir):
    """Three layers of different completeness on the generated grid."""
    base = gr.generate_cells(grids(spark, sf_dir)).select(*CELL)
    full = base_cells(spark, sf_dir).select(*CELL, "k").join(cells(spark, sf_dir, "lulc"), CELL)
    ghi = cells(spark, sf_dir, "ghi_annual").filter("ghi_annual IS NOT NULL")
    return gr.align(base, ghi, cells(spark, sf_dir, "slope"), full.filter("k % 5 <> 0").drop("k"))


# ---- terrain ---------------------------------------------------------------------------

MEDIAN_SQL = """
med AS (SELECT scene_id, quantile_cont(elevation, 0.5) AS m FROM cells GROUP BY 1),
f AS (SELECT scene_id, row, col, elevation, coalesce(elevation, m, 0) AS z FROM cells LEFT JOIN med USING (scene_id))"""
SLOPE_SQL = f"""{MEDIAN_SQL},
n AS (SELECT *, lag(z) OVER r AS zw, lead(z) OVER r AS ze, lag(z) OVER c AS zn, lead(z) OVER c AS zs FROM f
  WINDOW r AS (PARTITION BY scene_id, row ORDER BY col), c AS (PARTITION BY scene_id, col ORDER BY row)),
gr AS (SELECT *, (coalesce(ze, z) - coalesce(zw, z)) / (CASE WHEN ze IS NULL OR zw IS NULL THEN 500.0 ELSE 1000.0 END) AS dx,
  -(coalesce(zs, z) - coalesce(zn, z)) / (CASE WHEN zs IS NULL OR zn IS NULL THEN 500.0 ELSE 1000.0 END) AS dy FROM n),
sl AS (SELECT scene_id, row, col, elevation, dx, dy, degrees(atan(sqrt(dx * dx + dy * dy))) AS s, degrees(atan2(-dx, -dy)) AS b FROM gr),
cl AS (SELECT *, CASE WHEN b < 0 THEN b + 360 ELSE b END AS bearing FROM sl)"""


@query(
    "p8_median_fill",
    f"WITH {cells_sql('elevation')},{MEDIAN_SQL} SELECT scene_id, row, col, z AS filled FROM f",
)
def p8_median_fill(spark, sf_dir):
    return terrain.fill_with_median(cells(spark, sf_dir, "elevation"), ["scene_id"]).select(*CELL, "filled")


@query(
    "p6_slope",
    f"WITH {cells_sql('elevation')},{SLOPE_SQL} SELECT scene_id, row, col, CASE WHEN elevation IS NULL THEN NULL ELSE round(s, 6) END AS slope FROM cl",
)
def p6_slope(spark, sf_dir):
    df = terrain.slope_aspect(cells(spark, sf_dir, "elevation"), ["scene_id"], F.lit(float(RESOLUTION_M)))
    return df.select(*CELL, F.round("slope", 6).alias("slope"))


@query(
    "p7_aspect_class",
    f"""WITH {cells_sql('elevation')},{SLOPE_SQL} SELECT scene_id, row, col, CASE WHEN elevation IS NULL OR s < 0.5 THEN 0
  WHEN bearing >= 337.5 OR bearing < 22.5 THEN 1 WHEN bearing < 67.5 THEN 2 WHEN bearing < 112.5 THEN 3 WHEN bearing < 157.5 THEN 4
  WHEN bearing < 202.5 THEN 5 WHEN bearing < 247.5 THEN 6 WHEN bearing < 292.5 THEN 7 ELSE 8 END AS aspect_class FROM cl""",
)
def p7_aspect_class(spark, sf_dir):
    df = terrain.slope_aspect(cells(spark, sf_dir, "elevation"), ["scene_id"], F.lit(float(RESOLUTION_M)))
    return df.select(*CELL, "aspect_class")


@query(
    "w7_gradient_neighbours",
    f"""WITH {cells_sql('slope')} SELECT scene_id, row, col, lag(slope) OVER r AS v_w, lead(slope) OVER r AS v_e, lag(slope) OVER c AS v_n, lead(slope) OVER c AS v_s FROM cells
WINDOW r AS (PARTITION BY scene_id, row ORDER BY col), c AS (PARTITION BY scene_id, col ORDER BY row)""",
)
def w7_gradient_neighbours(spark, sf_dir):
    from terralux.operators.stencil import with_cross

    return with_cross(cells(spark, sf_dir, "slope"), ["scene_id"], "slope").drop("slope")


# ---- resampling and interpolation ------------------------------------------------------

# Targets are cells of every scene, shifted by a third of a pixel against a source of half the resolution.
TARGET_SQL = "tg AS (SELECT scene_id, row, col, (row + 0.5) / 2 - 0.5 + 0.25 AS sr, (col + 0.5) / 2 - 0.5 + 0.125 AS sc FROM base)"
COARSE_SQL = """co AS (SELECT scene_id, row // 2 AS row, col // 2 AS col, CASE WHEN min(k) % 7 = 0 THEN NULL ELSE CAST(min(k) % 1000 AS DOUBLE) END AS value FROM base GROUP BY 1, 2, 3)"""


def _targets(spark, sf_dir):
    return base_cells(spark, sf_dir).selectExpr(
        "scene_id", "row", "col", "(row + 0.5D) / 2 - 0.5D + 0.25D AS src_row", "(col + 0.5D) / 2 - 0.5D + 0.125D AS src_col"
    )


def _coarse(spark, sf_dir):
    coarse = base_cells(spark, sf_dir).groupBy(
        "scene_id", F.expr("CAST(row div 2 AS INT)").alias("row"), F.expr("CAST(col div 2 AS INT)").alias("col")
    ).agg(F.min("k").alias("k"))
    return coarse.selectExpr("scene_id", "row", "col", "IF(k % 7 = 0, NULL, CAST(k % 1000 AS DOUBLE)) AS value")


def _padded(spark, sf_dir, ring):
    spec = _coarse(spark, sf_dir).groupBy("scene_id").agg(
        (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")
    )
    return gr.pad_raster(_coarse(spark, sf_dir), spec, ring)


def _kernel_sql(taps: list[int], weight) -> str:
    t = "UNION ALL ".join(
        f"SELECT scene_id, row, col, CAST(floor(sr) AS INTEGER) + {i} AS pr, CAST(floor(sc) AS INTEGER) + {j} AS pc, ({weight('(sr - floor(sr))', i)}) * ({weight('(sc - floor(sc))', j)}) AS w FROM tg "
        for i in taps
        for j in taps
    )
    return f"""WITH {BASE_SQL}, {TARGET_SQL}, {COARSE_SQL}, taps AS ({t})
SELECT t.scene_id, t.row, t.col, round(sum(CASE WHEN value IS NOT NULL THEN w * value END) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0), 6) AS value
FROM taps t LEFT JOIN co s ON s.scene_id = t.scene_id AND s.row = t.pr AND s.col = t.pc GROUP BY 1, 2, 3"""


def _linear_w(t: str, i: int) -> str:
    return f"1 - {t}" if i == 0 else t


def _cubic_w(t: str, i: int) -> str:
    return {
        -1: f"-0.5 * {t} + {t} * {t} - 0.5 * {t} * {t} * {t}",
        0: f"1 - 2.5 * {t} * {t} + 1.5 * {t} * {t} * {t}",
        1: f"0.5 * {t} + 2 * {t} * {t} - 1.5 * {t} * {t} * {t}",
        2: f"-0.5 * {t} * {t} + 0.5 * {t} * {t} * {t}",
    }[i]


@query(
    "c11_resample_nearest",
    f"""WITH {BASE_SQL}, {TARGET_SQL}, {COARSE_SQL} SELECT t.scene_id, t.row, t.col, value FROM tg t LEFT JOIN co s
ON s.scene_id = t.scene_id AND s.row = floor(sr + 0.5) AND s.col = floor(sc + 0.5)""",
)
def c11_resample_nearest(spark, sf_dir):
    return gr.resample(_targets(spark, sf_dir), _coarse(spark, sf_dir), "nearest").select(*CELL, "value")


@query("c11_resample_bilinear", _kernel_sql([0, 1], _linear_w))
def c11_resample_bilinear(spark, sf_dir):
    df = gr.resample(_targets(spark, sf_dir), _padded(spark, sf_dir, 1), "bilinear")
    return df.select(*CELL, F.round("value", 6).alias("value"))


@query("c11_resample_cubic", _kernel_sql([-1, 0, 1, 2], _cubic_w))
def c11_resample_cubic(spark, sf_dir):
    df = gr.resample(_targets(spark, sf_dir), _padded(spark, sf_dir, 2), "cubic")
    return df.select(*CELL, F.round("value", 6).alias("value"))


@query(
    "c11_resample_average",
    f"WITH {cells_sql('elevation')} SELECT scene_id, row // 3 AS row, col // 3 AS col, round(avg(elevation), 6) AS value FROM cells GROUP BY 1, 2, 3",
)
def c11_resample_average(spark, sf_dir):
    source = cells(spark, sf_dir, "elevation").selectExpr(
        "scene_id", "elevation AS value", "CAST(row div 3 AS INT) AS target_row", "CAST(col div 3 AS INT) AS target_col"
    )
    df = gr.resample(source, source, "average")
    return df.select(*CELL, F.round("value", 6).alias("value"))


# A WGS-84 raster of half the resolution over each scene: its outer corner and pixel size in degrees.
WEST, NORTH, DLON, DLAT = 24.9, 31.64, 0.0105, 0.009


def _affine(spark, sf_dir):
    return _coarse(spark, sf_dir).groupBy("scene_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width")).withColumns(
        {"west": F.lit(WEST), "north": F.lit(NORTH), "dlon": F.lit(DLON), "dlat": F.lit(DLAT)}
    )


_WARP_SQL = f"""{BASE_SQL}, pt AS (SELECT scene_id, row, col, {EPSG} AS epsg, {MINX}::DOUBLE + (col + 0.5) * 500 AS x, {MAXY}::DOUBLE - (row + 0.5) * 500 AS y FROM base),
{inverse_sql('pt', 'geo', 'scene_id, row, col')},
tg AS MATERIALIZED (SELECT scene_id, row, col, ({NORTH}::DOUBLE - lat) / {DLAT}::DOUBLE - 0.5 AS sr, (lon - {WEST}::DOUBLE) / {DLON}::DOUBLE - 0.5 AS sc FROM geo), {COARSE_SQL}"""


@query(
    "c11_reprojected_nearest",
    f"WITH {_WARP_SQL} SELECT t.scene_id, t.row, t.col, value FROM tg t LEFT JOIN co s ON s.scene_id = t.scene_id AND s.row = floor(sr + 0.5) AND s.col = floor(sc + 0.5)",
)
def c11_reprojected_nearest(spark, sf_dir):
    """A raster in degrees on the cells of a UTM grid."""
    at = cells(spark, sf_dir, "x", "y").select(*CELL, "x", "y")
    return gr.warp(at, grids(spark, sf_dir), _coarse(spark, sf_dir), _affine(spark, sf_dir), "nearest").select(*CELL, "value")


@query(
    "c11_reprojected_bilinear",
    f"""WITH {_WARP_SQL}, taps AS (SELECT scene_id, row, col, floor(sr) + i AS pr, floor(sc) + j AS pc, abs(1 - i - (sr - floor(sr))) * abs(1 - j - (sc - floor(sc))) AS w FROM tg, range(2) a(i), range(2) b(j))
SELECT t.scene_id, t.row, t.col, round(sum(CASE WHEN value IS NOT NULL THEN w * value END) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0), 5) AS value
FROM taps t LEFT JOIN co s ON s.scene_id = t.scene_id AND s.row = t.pr AND s.col = t.pc GROUP BY 1, 2, 3""",
)
def c11_reprojected_bilinear(spark, sf_dir):
    at = cells(spark, sf_dir, "x", "y").select(*CELL, "x", "y")
    df = gr.warp(at, grids(spark, sf_dir), _coarse(spark, sf_dir), _affine(spark, sf_dir), "bilinear")
    return df.select(*CELL, F.round("value", 5).alias("value"))


# Tiles of a globe-wide raster around all scenes; pixels are numbered from the north-west corner of the globe.
PIXELS_PER_DEGREE = 60


def _tile_folder(spark, sf_dir, step, value):
    """Tiles that the scenes touch and their neighbours, written as a folder per tile."""
    at = cells(spark, sf_dir, "x", "y").join(grids(spark, sf_dir).select("scene_id", "epsg"), "scene_id")
    touched = g.with_lonlat(at, "x", "y", "epsg").select((F.floor(F.col("lat") / step) * step).alias("tile_lat"), (F.floor(F.col("lon") / step) * step).alias("tile_lon")).distinct()
    around = F.array(*(F.struct(F.lit(a * step).alias("a"), F.lit(b * step).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    tiles = touched.select("*", F.explode(around).alias("d")).select((F.col("tile_lat") + F.col("d.a")).alias("tile_lat"), (F.col("tile_lon") + F.col("d.b")).alias("tile_lon")).distinct()
    tiles = cut(tiles, "tile-names")
    line = F.sequence(F.lit(0), F.lit(step * PIXELS_PER_DEGREE - 1))
    # Sixteen tiles a task, as a tile's name grows to all of its pixels.
    spread = tiles.repartition(1 + tiles.count() // 16, "tile_lat", "tile_lon")
    pixels = spread.withColumn("pixel_row", F.explode(line)).withColumn("pixel_col", F.explode(line)).withColumns(
        {"gr": (90 - F.col("tile_lat") - step) * PIXELS_PER_DEGREE + F.col("pixel_row"), "gc": (F.col("tile_lon") + 180) * PIXELS_PER_DEGREE + F.col("pixel_col")}
    )
    path = scratch_path(spark, "tiles")
    rasters.write_tiles(pixels.select("tile_lat", "tile_lon", "pixel_row", "pixel_col", F.expr(value).alias("value")), path)
    return path


def _from_tiles(spark, sf_dir, step, value, method, prepare=None):
    at = cells(spark, sf_dir, "x", "y")
    return rasters.tiles_to_cells(spark, _tile_folder(spark, sf_dir, step, value), at, grids(spark, sf_dir), step, PIXELS_PER_DEGREE, method, prepare)


_GLOBE_SQL = f"""{BASE_SQL}, pt AS (SELECT scene_id, row, col, {EPSG} AS epsg, {MINX}::DOUBLE + (col + 0.5) * 500 AS x, {MAXY}::DOUBLE - (row + 0.5) * 500 AS y FROM base),
{inverse_sql('pt', 'geo', 'scene_id, row, col')},
tg AS MATERIALIZED (SELECT scene_id, row, col, (90 - lat) * {PIXELS_PER_DEGREE} - 0.5 AS sr, (lon + 180) * {PIXELS_PER_DEGREE} - 0.5 AS sc FROM geo)"""


@query(
    "s12_tiles_to_cells",
    f"""WITH {_GLOBE_SQL}, taps AS (SELECT scene_id, row, col, CAST(floor(sr) AS BIGINT) + i AS gr, CAST(floor(sc) AS BIGINT) + j AS gc, abs(1 - i - (sr - floor(sr))) * abs(1 - j - (sc - floor(sc))) AS w FROM tg, range(2) a(i), range(2) b(j)),
v AS (SELECT scene_id, row, col, w, CASE WHEN (gr * 7 + gc * 3) % 41 <> 0 THEN CAST((gr * 31 + gc * 17) % 900 AS DOUBLE) END AS value FROM taps)
SELECT scene_id, row, col, round(sum(w * value) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0), 4) AS value FROM v GROUP BY 1, 2, 3""",
)
def s12_tiles_to_cells(spark, sf_dir):
    """Elevation from one-degree tiles; the missing code counts as missing, and kernels cross tile borders."""
    value = f"IF((gr * 7 + gc * 3) % 41 = 0, {rasters.NO_ELEVATION}, CAST((gr * 31 + gc * 17) % 900 AS DOUBLE))"
    df = _from_tiles(spark, sf_dir, gr.ELEVATION_TILE_DEG, value, "bilinear", rasters.elevation_pixels)
    return df.select(*CELL, F.round("value", 4).alias("value"))


@query(
    "s13_tiles_to_cells",
    f"WITH {_GLOBE_SQL} SELECT scene_id, row, col, ([{', '.join(map(str, LAND_COVER))}])[(CAST(floor(sr + 0.5) AS BIGINT) // 5 + CAST(floor(sc + 0.5) AS BIGINT) // 7) % 11 + 1] AS code FROM tg",
)
def s13_tiles_to_cells(spark, sf_dir):
    """Land-cover codes from three-degree tiles, the nearest pixel each."""
    value = f"element_at(array({', '.join(map(str, LAND_COVER))}), CAST((gr div 5 + gc div 7) % 11 AS INT) + 1)"
    df = _from_tiles(spark, sf_dir, gr.LAND_COVER_TILE_DEG, value, "nearest")
    return df.select(*CELL, F.col("value").cast("int").alias("code"))


# Samples every 20 cells, offset by half; a sheared position so that quads are no rectangles.
LATTICE_SQL = """smp AS (SELECT scene_id, col // 20 AS i, row // 20 AS j, (col + 0.0) * 500 + (row + 0.0) * 25 AS x, (row + 0.0) * 500 AS y,
  CAST(k % 313 AS DOUBLE) AS value FROM base WHERE row % 20 = 10 AND col % 20 = 10),
dim AS (SELECT scene_id, max(i) + 1 AS ni, max(j) + 1 AS nj, list([x, y, value]) AS pts FROM smp GROUP BY 1),
cl AS (SELECT scene_id, row, col, (col + 0.0) * 500 + (row + 0.0) * 25 AS x, (row + 0.0) * 500 AS y, (col - 10) / 20.0 AS fi, (row - 10) / 20.0 AS fj, ni, nj, pts FROM base LEFT JOIN dim USING (scene_id)),
q AS (SELECT *, greatest(0, least(CAST(floor(fi) AS INTEGER), ni - 2)) AS qi, greatest(0, least(CAST(floor(fj) AS INTEGER), nj - 2)) AS qj FROM cl),
jn AS (SELECT q.*, a.value AS v0, b.value AS v1, c.value AS v2, d.value AS v3, fi - qi AS u, fj - qj AS w,
  [[(q.x-a.x)*(q.x-a.x)+(q.y-a.y)*(q.y-a.y), a.value], [(q.x-b.x)*(q.x-b.x)+(q.y-b.y)*(q.y-b.y), b.value], [(q.x-c.x)*(q.x-c.x)+(q.y-c.y)*(q.y-c.y), c.value], [(q.x-d.x)*(q.x-d.x)+(q.y-d.y)*(q.y-d.y), d.value]] AS near
  FROM q LEFT JOIN smp a ON a.scene_id = q.scene_id AND a.i = qi AND a.j = qj LEFT JOIN smp b ON b.scene_id = q.scene_id AND b.i = qi + 1 AND b.j = qj
  LEFT JOIN smp c ON c.scene_id = q.scene_id AND c.i = qi AND c.j = qj + 1 LEFT JOIN smp d ON d.scene_id = q.scene_id AND d.i = qi + 1 AND d.j = qj + 1)"""


@query(
    "j12_lattice_interpolation",
    f"""WITH {BASE_SQL}, {LATTICE_SQL} SELECT scene_id, row, col, round(CASE WHEN fi BETWEEN 0 AND ni - 1 AND fj BETWEEN 0 AND nj - 1 AND v0 + v1 + v2 + v3 IS NOT NULL THEN
  CASE WHEN u >= w THEN v0 + u * (v1 - v0) + w * (v3 - v1) ELSE v0 + w * (v2 - v0) + u * (v3 - v2) END
  ELSE coalesce(list_min(list_filter(near, lambda p: p[2] IS NOT NULL))[2], list_min(list_transform(pts, lambda p: [(x - p[1]) * (x - p[1]) + (y - p[2]) * (y - p[2]), p[3]]))[2]) END, 6) AS value FROM jn""",
)
def j12_lattice_interpolation(spark, sf_dir):
    base = base_cells(spark, sf_dir).selectExpr(
        "scene_id", "row", "col", "k", "col * 500.0D + row * 25.0D AS x", "row * 500.0D AS y", "CAST(col AS DOUBLE) AS u", "CAST(row AS DOUBLE) AS v"
    )
    samples = base.filter("row % 20 = 10 AND col % 20 = 10").selectExpr(
        "scene_id", "CAST(col div 20 AS INT) AS i", "CAST(row div 20 AS INT) AS j", "x", "y", "CAST(k % 313 AS DOUBLE) AS value"
    )
    lattice = samples.groupBy("scene_id").agg((F.max("i") + 1).alias("side_i"), (F.max("j") + 1).alias("side_j")).selectExpr(
        "scene_id", "10.0D AS u0", "10.0D AS v0", "20.0D AS du", "20.0D AS dv", "side_i", "side_j"
    )
    df = interpolate(base.drop("k"), samples, lattice)
    return df.select(*CELL, F.round("value", 6).alias("value"))


# ---- distances -------------------------------------------------------------------------


@query(
    "j10_nearest_feature_distance",
    f"WITH {BASE_SQL}, {FEATURES_SQL}, d AS (SELECT b.scene_id, b.row, b.col, f.kind, min(sqrt((b.row - f.row) * (b.row - f.row) + (b.col - f.col) * (b.col - f.col)::DOUBLE)) * 500 AS dist "
    "FROM base b JOIN feats f ON f.scene_id = b.scene_id GROUP BY 1, 2, 3, 4) SELECT b.scene_id, b.row, b.col, "
    + ", ".join(f"round(max(CASE WHEN kind = '{k}' THEN dist END), 6) AS dist_{k}" for k in KINDS)
    + " FROM base b LEFT JOIN d ON d.scene_id = b.scene_id AND d.row = b.row AND d.col = b.col GROUP BY 1, 2, 3",
)
def j10_nearest_feature_distance(spark, sf_dir):
    """Four distance layers over the full grid in one pair of passes."""
    flagged = proximity.feature_flags(base_cells(spark, sf_dir).select(*CELL), feature_cells(spark, sf_dir), KINDS)
    df = proximity.distances(flagged, [f"is_{k}" for k in KINDS], F.lit(RESOLUTION_M))
    return df.select(*CELL, *(F.round(f"dist_{k}", 6).alias(f"dist_{k}") for k in KINDS))


# ---- regions and sites -----------------------------------------------------------------

MASK_SQL = "mask AS (SELECT scene_id, row, col, lsi, x, y, dist_power FROM classed WHERE lsi_class IN (5, 4))"
REGION_SQL = """
nodes AS (SELECT scene_id, row, col, row::BIGINT * 16777216 + col AS p, scene_id || chr(58) || (row::BIGINT * 16777216 + col) AS id FROM mask),
links AS (SELECT a.id AS u, b.id AS v FROM nodes a JOIN (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dr, dc)) o ON true
  JOIN nodes b ON b.scene_id = a.scene_id AND b.row = a.row + o.dr AND b.col = a.col + o.dc),
cc(id, p) USING KEY (id) AS (SELECT id, p FROM nodes UNION
  SELECT l.u AS id, min(w.p) AS p FROM cc w JOIN links l ON l.v = w.id JOIN recurring.cc o ON o.id = l.u WHERE w.p < o.p GROUP BY l.u),
lab AS (SELECT n.scene_id, n.row, n.col, c.p AS region FROM nodes n JOIN cc c USING (id))"""


def site_cells(spark, sf_dir, *extra):
    """Quantile-classified cells, as the site run uses them."""
    names = ["x", "y", "lsi", "lsi_class", "dist_power", "ghi_annual"]
    return classified_cells(cells(spark, sf_dir), REG, "quantile").select(*CELL, *names)


@query("r1_top_class_mask", f"WITH {QUANTILE_SQL}, {MASK_SQL} SELECT scene_id, row, col FROM mask")
def r1_top_class_mask(spark, sf_dir):
    return sites.top_class_mask(site_cells(spark, sf_dir), SITE_CLASSES).select(*CELL)


@query(
    "r2_connected_components",
    f"WITH RECURSIVE {QUANTILE_SQL}, {MASK_SQL},{REGION_SQL} SELECT scene_id, row, col, CAST(region AS BIGINT) AS region FROM lab",
)
def r2_connected_components(spark, sf_dir):
    return components.region_cells(sites.top_class_mask(site_cells(spark, sf_dir), SITE_CLASSES).select(*CELL))


PIECE_SQL = """
reg AS (SELECT scene_id, region, count(*) AS n, min(row) AS r0, min(col) AS c0 FROM lab GROUP BY 1, 2),
pc AS (SELECT l.scene_id, l.row, l.col, l.region, CASE WHEN n > 200 THEN (l.row - r0) // 14 ELSE 0 END AS tr, CASE WHEN n > 200 THEN (l.col - c0) // 14 ELSE 0 END AS tc
  FROM lab l JOIN reg USING (scene_id, region)),
num AS (SELECT *, dense_rank() OVER (PARTITION BY scene_id ORDER BY region, tr, tc) AS site_id FROM pc)"""
STATS_SQL = """
st AS (SELECT n.scene_id, n.site_id, count(*) AS cells, count(*) * 0.25 AS area_km2, avg(m.lsi) AS mean_lsi, max(m.lsi) AS max_lsi, avg(m.dist_power) AS mean_ptl_dist, avg(m.x) AS cx, avg(m.y) AS cy
  FROM num n JOIN mask m USING (scene_id, row, col) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY round(mean_lsi, 12) DESC NULLS LAST, area_km2 DESC, round(mean_ptl_dist, 6) ASC NULLS LAST, site_id) AS rank FROM st WHERE area_km2 >= 0.5),
top AS (SELECT *, cx AS x, cy AS y, 32635 AS epsg FROM rk WHERE rank <= 10)"""
REGIONS_SQL = f"WITH RECURSIVE {QUANTILE_SQL}, {MASK_SQL},{REGION_SQL}"
SITES_SQL = f"{REGIONS_SQL},{PIECE_SQL},{STATS_SQL}"


@query(
    "r3_r4_w9_split_and_number",
    f"{REGIONS_SQL},{PIECE_SQL} SELECT scene_id, row, col, CAST(site_id AS BIGINT) AS site_id FROM num",
)
def r3_r4_w9_split_and_number(spark, sf_dir):
    """Regions above 50 km2 on a square grid; pieces numbered in raster order."""
    mask = sites.top_class_mask(site_cells(spark, sf_dir), SITE_CLASSES).select(*CELL)
    pieces = cut(sites.split_regions(mask, grids(spark, sf_dir), SITE_CAP_KM2))
    numbered = sites.number_pieces(pieces.select("scene_id", *sites.PIECE).distinct())
    return pieces.join(numbered, ["scene_id", *sites.PIECE]).select(*CELL, "site_id")


@query(
    "a12_a13_site_statistics",
    f"{SITES_SQL} SELECT scene_id, CAST(site_id AS BIGINT) AS site_id, cells, CAST(area_km2 AS DOUBLE) AS area_km2, round(mean_lsi, 8) AS mean_lsi, round(max_lsi, 8) AS max_lsi, "
    "round(mean_ptl_dist, 5) AS mean_ptl_dist, round(cx, 4) AS centroid_x, round(cy, 4) AS centroid_y FROM st",
)
def a12_a13_site_statistics(spark, sf_dir):
    base = cut(sites.top_class_mask(site_cells(spark, sf_dir), SITE_CLASSES))
    spec = grids(spark, sf_dir)
    pieces = sites.split_regions(base.select(*CELL), spec, SITE_CAP_KM2)
    stats = cut(sites.site_statistics(pieces.join(base, CELL), spec))
    return sites.number_pieces(stats).select(
        "scene_id", "site_id", "cells", "area_km2", F.round("mean_lsi", 8).alias("mean_lsi"), F.round("max_lsi", 8).alias("max_lsi"),
        F.round("mean_ptl_dist", 5).alias("mean_ptl_dist"), F.round("centroid_x", 4).alias("centroid_x"), F.round("centroid_y", 4).alias("centroid_y"),
    )


@query(
    "r8_w1_w2_extract_sites",
    f"{SITES_SQL},{inverse_sql('top', 'geo', 'scene_id, site_id')} SELECT t.scene_id, CAST(t.site_id AS BIGINT) AS site_id, CAST(area_km2 AS DOUBLE) AS area_km2, round(mean_lsi, 8) AS mean_lsi, "
    "round(mean_ptl_dist, 5) AS mean_ptl_dist, round(lon, 7) AS centroid_lon, round(lat, 7) AS centroid_lat, CAST(rank AS INTEGER) AS rank FROM top t JOIN geo USING (scene_id, site_id)",
)
def r8_w1_w2_extract_sites(spark, sf_dir):
    df = sites.extract_sites(
        cut(site_cells(spark, sf_dir)), grids(spark, sf_dir), SITE_CLASSES, max_site_area_km2=SITE_CAP_KM2
    )
    return df.select(
        "scene_id", "site_id", "area_km2", F.round("mean_lsi", 8).alias("mean_lsi"), F.round("mean_ptl_dist", 5).alias("mean_ptl_dist"),
        F.round("centroid_lon", 7).alias("centroid_lon"), F.round("centroid_lat", 7).alias("centroid_lat"), "rank",
    )


@query(
    "r8_outlined_sites",
    f"{SITES_SQL},{inverse_sql('top', 'geo', 'scene_id, site_id')} SELECT t.scene_id, CAST(t.site_id AS BIGINT) AS site_id, CAST(rank AS INTEGER) AS rank, round(lon, 7) AS centroid_lon, round(lat, 7) AS centroid_lat, "
    "CAST(area_km2 AS DOUBLE) AS outline_km2 FROM top t JOIN geo USING (scene_id, site_id)",
)
def r8_outlined_sites(spark, sf_dir):
    """Centroids and areas from the corners of the exact outlines are those of the cells."""
    df = sites.extract_sites(
        cut(site_cells(spark, sf_dir)), grids(spark, sf_dir), SITE_CLASSES, max_site_area_km2=SITE_CAP_KM2, simplify_tolerance_m=0.0
    )
    doubled = """aggregate(flatten(transform(polygons, p -> flatten(transform(p, r -> transform(sequence(0, size(r) - 2),
        i -> (r[i + 1].x - r[i].x) * (r[i + 1].y + r[i].y)))))), 0D, (s, v) -> s + v)"""
    return df.select(
        "scene_id", "site_id", "rank", F.round("centroid_lon", 7).alias("centroid_lon"), F.round("centroid_lat", 7).alias("centroid_lat"),
        F.round(F.abs(F.expr(doubled)) / 2e6, 6).alias("outline_km2"),
    )


@query(
    "r5_minimum_area",
    f"{SITES_SQL} SELECT scene_id, count(*) AS pieces, count(*) FILTER (WHERE area_km2 >= 2) AS kept FROM st GROUP BY 1",
)
def r5_minimum_area(spark, sf_dir):
    base = cut(sites.top_class_mask(site_cells(spark, sf_dir), SITE_CLASSES))
    spec = grids(spark, sf_dir)
    pieces = sites.split_regions(base.select(*CELL), spec, SITE_CAP_KM2)
    stats = sites.site_statistics(pieces.join(base, CELL), spec)
    return stats.groupBy("scene_id").agg(F.count("*").alias("pieces"), F.count_if(F.col("area_km2") >= 2.0).alias("kept"))


@query(
    "r10_empty_result",
    "SELECT 's0' AS scene_id, CAST(0 AS BIGINT) AS site_id, CAST(0 AS INTEGER) AS rank FROM orders WHERE false",
)
def r10_empty_result(spark, sf_dir):
    """No cell is of class 9: an empty table with the full schema."""
    df = sites.extract_sites(site_cells(spark, sf_dir), grids(spark, sf_dir), classes=(9,))
    declared = [f.split(" ")[0] for f in schema.SITES.split(", ")]
    assert [c for c in df.columns if c != "epsg"] == declared
    return df.select("scene_id", "site_id", "rank")


OUTLINE_SQL = """
own AS (SELECT scene_id, row, col, t.site_id FROM num n JOIN top t USING (scene_id, site_id)),
peri AS (SELECT a.scene_id, a.site_id, count(*) FILTER (WHERE b.row IS NULL) * 500.0 AS perimeter_m FROM own a
  JOIN (VALUES (-1,0),(1,0),(0,-1),(0,1)) o(dr, dc) ON true
  LEFT JOIN own b ON b.scene_id = a.scene_id AND b.site_id = a.site_id AND b.row = a.row + o.dr AND b.col = a.col + o.dc GROUP BY 1, 2),
verts AS (SELECT scene_id, site_id, row + dr AS r, col + dc AS c, count(*) AS n, count(*) FILTER (WHERE (dr, dc) IN ((0, 0), (1, 1))) AS d FROM own, (VALUES (0,0),(0,1),(1,0),(1,1)) o(dr, dc) GROUP BY 1, 2, 3, 4),
corn AS (SELECT scene_id, site_id, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND d IN (0, 2) THEN 2 ELSE 0 END) AS corners FROM verts GROUP BY 1, 2)"""


def _site_rings(spark, sf_dir, tolerance=0.0):
    spec = grids(spark, sf_dir)
    _, member = sites.extract_with_cells(
        cut(site_cells(spark, sf_dir)), spec, SITE_CLASSES, max_site_area_km2=SITE_CAP_KM2
    )
    # Few cells, read several times for their sides.
    return polygons.site_rings(cut(member), spec, tolerance)


@query(
    "r6_site_polygons",
    f"{SITES_SQL},{OUTLINE_SQL} SELECT scene_id, CAST(site_id AS BIGINT) AS site_id, CAST(cells * 250000 AS DOUBLE) AS area_m2, CAST(perimeter_m AS DOUBLE) AS perimeter_m, CAST(corners AS BIGINT) AS corners "
    "FROM top JOIN peri USING (scene_id, site_id) JOIN corn USING (scene_id, site_id)",
)
def r6_site_polygons(spark, sf_dir):
    """Outlines of the ranked sites: area (holes taken off), perimeter and corners of each."""
    rings = polygons.ring_measures(_site_rings(spark, sf_dir))
    return rings.groupBy("scene_id", "site_id").agg(
        F.round(F.sum("area_m2"), 3).alias("area_m2"), F.round(F.sum("perimeter_m"), 3).alias("perimeter_m"),
        F.sum("corners").cast("bigint").alias("corners"),
    )


@query(
    "k3_site_features",
    f"{SITES_SQL},{OUTLINE_SQL}, edge AS MATERIALIZED (SELECT v.scene_id, v.site_id, t.epsg, {MINX}::DOUBLE + c * 500.0 AS x, {MAXY}::DOUBLE - r * 500.0 AS y FROM verts v JOIN top t USING (scene_id, site_id) WHERE n < 4),"
    f"{inverse_sql('edge', 'pt', 'scene_id, site_id')}, box AS (SELECT scene_id, site_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM pt GROUP BY 1, 2) "
    "SELECT scene_id, CAST(site_id AS BIGINT) AS site_id, CAST(rank AS INTEGER) AS rank, 'MultiPolygon' AS kind, CAST(corners AS BIGINT) AS corners, round(west, 7) AS west, round(south, 7) AS south, round(east, 7) AS east, round(north, 7) AS north "
    "FROM top JOIN box USING (scene_id, site_id) JOIN corn USING (scene_id, site_id)",
)
def k3_site_features(spark, sf_dir):
    """Ranked sites with their outlines, written as text lines per scene and read back as documents."""
    spec = grids(spark, sf_dir)
    found, member = sites.extract_with_cells(cut(site_cells(spark, sf_dir)), spec, SITE_CLASSES, max_site_area_km2=SITE_CAP_KM2)
    outlines = polygons.site_polygons(polygons.rings_lonlat(polygons.site_rings(cut(member), spec), spec))
    path = scratch_path(spark, "features")
    sink.write_features(sink.site_features(found.select("scene_id", "site_id", "rank"), outlines), path)
    shape = "properties STRUCT<site_id: BIGINT, rank: INT>, geometry STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>>"
    back = spark.read.text(path).select("scene_id", F.from_json("value", shape).alias("f"))
    rings = F.flatten("f.geometry.coordinates")
    points = F.flatten(rings)

    def edge(of, at):
        return F.round(of(F.transform(points, lambda p: p[at])), 7)

    return back.select(
        "scene_id", "f.properties.site_id", "f.properties.rank", F.col("f.geometry.type").alias("kind"),
        # A ring's first corner is also its last.
        (F.size(points) - F.size(rings)).cast("bigint").alias("corners"),
        edge(F.array_min, 0).alias("west"), edge(F.array_min, 1).alias("south"), edge(F.array_max, 0).alias("east"), edge(F.array_max, 1).alias("north"),
    )


@query(
    "r7_simplified_polygons",
    f"{SITES_SQL} SELECT scene_id, CAST(site_id AS BIGINT) AS site_id, true AS closed, true AS own_corners, true AS within_tolerance, true AS area_kept FROM top",
)
def r7_simplified_polygons(spark, sf_dir):
    """What holds for outlines simplified by 400 m, against the exact outlines of the same sites.

    Rings are closed, their corners are corners of the exact ring, no exact corner is farther than the
    tolerance from the simplified ring, and the area changes by less than perimeter times tolerance.
    """
    tolerance = 400.0
    spec = grids(spark, sf_dir)
    _, member = sites.extract_with_cells(cut(site_cells(spark, sf_dir)), spec, SITE_CLASSES, max_site_area_km2=SITE_CAP_KM2)
    member = cut(member)
    ring = ["scene_id", "site_id", "part", "ring"]
    pairs = []
    for name, by in (("exact", 0.0), ("simple", tolerance)):
        rings = cut(polygons.site_rings(member, spec, by), "rings")
        measured = polygons.ring_measures(rings).select(*ring, F.col("area_m2").alias(f"{name}_area"), F.col("perimeter_m").alias(f"{name}_perimeter"))
        corners = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y")))
        pairs.append(rings.select(*ring, corners.alias(name)).join(measured, ring))
    # Every corner is held against every side of its ring: much work for few bytes.
    both = spread(pairs[0].join(pairs[1], ring, "full"), *ring)
    sides = F.arrays_zip(F.slice("simple", 1, F.size("simple") - 1).alias("a"), F.slice("simple", 2, F.size("simple") - 1).alias("b"))

    def distance(p, side):
        a, b = side["a"], side["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = F.nullif(dx * dx + dy * dy, F.lit(0.0))
        along = F.coalesce(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / length, F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)

    offset = F.array_max(F.transform("exact", lambda p: F.array_min(F.transform("sides", lambda s: distance(p, s)))))
    checked = both.withColumn("sides", sides).select(
        "scene_id",
        "site_id",
        (F.element_at("simple", 1) == F.element_at("simple", -1)).alias("closed"),
        (F.size(F.array_except("simple", "exact")) == 0).alias("own_corners"),
        (offset <= tolerance + 1e-6).alias("within_tolerance"),
        (F.abs(F.col("simple_area") - F.col("exact_area")) <= F.col("exact_perimeter") * tolerance).alias("area_kept"),
    )
    return checked.groupBy("scene_id", "site_id").agg(*(F.bool_and(c).alias(c) for c in ("closed", "own_corners", "within_tolerance", "area_kept")))


# ---- vectors ---------------------------------------------------------------------------

# A quadrilateral per part in one of two scenes; many reach beyond the smaller scene's grid.
QUAD_SQL = f"""
qd AS (SELECT 's' || (p_partkey % 2) AS scene_id, p_partkey AS id, {MINX}::DOUBLE + (p_partkey * 37 % 30) * 500 + 100 AS x0, {MAXY}::DOUBLE - (p_partkey * 53 % 140) * 500 - 3300 AS y0,
  700 + p_partkey % 5 * 450 AS w, 600 + p_partkey % 7 * 380 AS h, p_partkey % 3 * 130 AS sk FROM part),
sides AS (SELECT scene_id, id, x0 AS xa, y0 AS ya, x0 + w AS xb, y0 + sk AS yb FROM qd UNION ALL SELECT scene_id, id, x0 + w, y0 + sk, x0 + w + sk, y0 + h FROM qd
  UNION ALL SELECT scene_id, id, x0 + w + sk, y0 + h, x0 + sk, y0 + h - 50 FROM qd UNION ALL SELECT scene_id, id, x0 + sk, y0 + h - 50, x0, y0 FROM qd)"""


def quads(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS area_id", f"CAST({MINX} AS DOUBLE) + (p_partkey * 37 % 30) * 500 + 100 AS x0",
        f"CAST({MAXY} AS DOUBLE) - (p_partkey * 53 % 140) * 500 - 3300 AS y0",
        "700 + p_partkey % 5 * 450 AS w", "600 + p_partkey % 7 * 380 AS h", "p_partkey % 3 * 130 AS sk",
    ).selectExpr(
        "concat('s', area_id % 2) AS scene_id", "area_id", "x0 AS minx", "y0 AS miny", "x0 + w + sk AS maxx", "y0 + h + sk AS maxy",
        """array(array(named_struct('x', x0, 'y', y0), named_struct('x', x0 + w, 'y', y0 + sk), named_struct('x', x0 + w + sk, 'y', y0 + h),
             named_struct('x', x0 + sk, 'y', y0 + h - 50), named_struct('x', x0, 'y', y0))) AS rings""",
    )


@query(
    "j7_c19_polygon_cells",
    f"""WITH {cells_sql('x', 'y')},{QUAD_SQL}, hit AS (SELECT c.scene_id, c.row, c.col, s.id, count(*) FILTER (WHERE (ya > y) <> (yb > y) AND x < (xb - xa) * (y - ya) / nullif(yb - ya, 0) + xa) AS n
  FROM cells c JOIN qd q ON c.scene_id = q.scene_id AND c.x BETWEEN q.x0 - 1 AND q.x0 + q.w + q.sk + 1 AND c.y BETWEEN q.y0 - 1 AND q.y0 + q.h + q.sk + 1 JOIN sides s ON s.id = q.id GROUP BY 1, 2, 3, 4)
SELECT DISTINCT scene_id, row, col FROM hit WHERE n % 2 = 1""",
)
def j7_c19_polygon_cells(spark, sf_dir):
    """Cells inside protected outlines, by scanline fill."""
    return vectors.protected_cells(quads(spark, sf_dir), grids(spark, sf_dir))


@query(
    "j8_s10_areas_in_boxes",
    # Every 2,000 areas and 100 boxes have a district of their own, so that the result grows with the tables.
    f"""WITH {QUAD_SQL}, bx AS (SELECT CAST(s_suppkey AS VARCHAR) AS scene_id, {MINX}::DOUBLE + (s_suppkey * 11 % 30) * 500 + s_suppkey // 100 * 20000 AS bx0, {MAXY}::DOUBLE - (s_suppkey * 17 % 140) * 500 AS by0 FROM supplier),
b AS (SELECT *, bx0 + 1200 AS bx1, by0 + 900 AS by1 FROM bx), east AS (SELECT id, xa + id // 2000 * 20000 AS xa, ya, xb + id // 2000 * 20000 AS xb, yb FROM sides),
ov AS (SELECT b.scene_id, s.id, max(CASE WHEN greatest(xa, xb) >= bx0 AND least(xa, xb) <= bx1 AND greatest(ya, yb) >= by0 AND least(ya, yb) <= by1
    AND least((xb-xa)*(by0-ya)-(yb-ya)*(bx0-xa), (xb-xa)*(by1-ya)-(yb-ya)*(bx0-xa), (xb-xa)*(by0-ya)-(yb-ya)*(bx1-xa), (xb-xa)*(by1-ya)-(yb-ya)*(bx1-xa)) <= 0
    AND greatest((xb-xa)*(by0-ya)-(yb-ya)*(bx0-xa), (xb-xa)*(by1-ya)-(yb-ya)*(bx0-xa), (xb-xa)*(by0-ya)-(yb-ya)*(bx1-xa), (xb-xa)*(by1-ya)-(yb-ya)*(bx1-xa)) >= 0 THEN 1 ELSE 0 END) AS touches,
  count(*) FILTER (WHERE (ya > by0) <> (yb > by0) AND bx0 < (xb - xa) * (by0 - ya) / nullif(yb - ya, 0) + xa) AS n FROM b JOIN east s ON abs(s.id // 2000 - CAST(b.scene_id AS BIGINT) // 100) <= 1 GROUP BY 1, 2)
SELECT scene_id, id AS area_id FROM ov WHERE touches = 1 OR n % 2 = 1""",
)
def j8_s10_areas_in_boxes(spark, sf_dir):
    boxes = table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS scene_id", f"CAST({MINX} AS DOUBLE) + (s_suppkey * 11 % 30) * 500 + s_suppkey DIV 100 * 20000 AS minx",
        f"CAST({MAXY} AS DOUBLE) - (s_suppkey * 17 % 140) * 500 AS miny",
    ).selectExpr("*", "minx + 1200 AS maxx", "miny + 900 AS maxy")
    east = F.expr("area_id DIV 2000 * 20000.0D")
    areas = quads(spark, sf_dir).drop("scene_id").withColumns({
        "minx": F.col("minx") + east, "maxx": F.col("maxx") + east,
        "rings": F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + east).alias("x"), p["y"].alias("y")))),
    })
    return vectors.areas_meeting_boxes(areas, boxes, tile=20000.0).select("scene_id", "area_id")


@query(
    "s10_present_protected_file",
    f"""WITH {cells_sql('x', 'y')},{QUAD_SQL}, hit AS (SELECT c.scene_id, c.row, c.col, s.id, count(*) FILTER (WHERE (ya > y) <> (yb > y) AND x < (xb - xa) * (y - ya) / nullif(yb - ya, 0) + xa) AS n
  FROM cells c JOIN qd q ON c.x BETWEEN q.x0 - 1 AND q.x0 + q.w + q.sk + 1 AND c.y BETWEEN q.y0 - 1 AND q.y0 + q.h + q.sk + 1 JOIN sides s ON s.id = q.id GROUP BY 1, 2, 3, 4),
inside AS (SELECT DISTINCT scene_id, row, col, true AS hit FROM hit WHERE n % 2 = 1)
SELECT scene_id, count(*) AS cells, count(hit) AS protected_cells, true AS available FROM cells LEFT JOIN inside USING (scene_id, row, col) GROUP BY 1""",
)
def s10_present_protected_file(spark, sf_dir):
    """A stored file of areas, read within the box around all scenes; each scene takes the areas that meet it."""
    spec = grids(spark, sf_dir)
    path = scratch_path(spark, "protected")
    declared = [f.name for f in rasters.read_protected(spark, path)[0].schema]
    rasters.write_protected(quads(spark, sf_dir).select(*declared), path)
    box = spec.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    areas, available = rasters.read_protected(spark, path, tuple(box))
    # Only what the areas cover together is asked, so equal outlines meet the scenes once.
    near = rasters.protected_in_boxes(vectors.distinct_outlines(areas), spec.select("scene_id", "minx", "miny", "maxx", "maxy"), tile=10_000.0)
    inside = vectors.protected_cells(near, spec).withColumn("hit", F.lit(True))
    joined = base_cells(spark, sf_dir).select(*CELL).join(inside, CELL, "left")
    return joined.groupBy("scene_id").agg(F.count("*").alias("cells"), F.count("hit").alias("protected_cells")).withColumn("available", F.lit(available))


@query(
    "c19_line_cells",
    f"""WITH {QUAD_SQL}, {BASE_SQL},{GRIDS_SQL}, s AS (SELECT scene_id, CAST(floor((xa - {MINX}) / 500) AS BIGINT) AS u0, CAST(floor(({MAXY} - ya) / 500) AS BIGINT) AS v0, CAST(floor((xb - {MINX}) / 500) AS BIGINT) AS u1, CAST(floor(({MAXY} - yb) / 500) AS BIGINT) AS v1 FROM sides),
st AS (SELECT *, greatest(abs(u1 - u0), abs(v1 - v0)) AS n FROM s), i AS (SELECT *, unnest(range(n + 1)) AS i FROM st),
cl AS (SELECT DISTINCT scene_id, CAST(v0 + floor((v1 - v0) * coalesce(i / nullif(n, 0)::DOUBLE, 0) + 0.5) AS INTEGER) AS row, CAST(u0 + floor((u1 - u0) * coalesce(i / nullif(n, 0)::DOUBLE, 0) + 0.5) AS INTEGER) AS col FROM i)
SELECT scene_id, row, col FROM cl JOIN grids USING (scene_id) WHERE row BETWEEN 0 AND height - 1 AND col BETWEEN 0 AND width - 1""",
)
def c19_line_cells(spark, sf_dir):
    """Outlines burned as lines, one step per cell along the longer axis."""
    lines = quads(spark, sf_dir).selectExpr(
        "scene_id", "area_id AS feature_id", "'LineString' AS geom_type", "rings[0] AS coords"
    )
    return vectors.rasterize(lines, grids(spark, sf_dir))


# ---- full pipeline ---------------------------------------------------------------------


ENERGY_SQL = f"""{SITES_SQL}, sg AS (SELECT t.*, coalesce(c.ghi_annual, a.g, 2000) AS ghi FROM top t
  JOIN (SELECT scene_id, max(col) AS w, max(row) AS h FROM base GROUP BY 1) g USING (scene_id)
  LEFT JOIN classed c ON c.scene_id = t.scene_id AND c.col = greatest(0, least(CAST(floor((cx - {MINX}) / 500) AS INTEGER), g.w)) AND c.row = greatest(0, least(CAST(floor(({MAXY} - cy) / 500) AS INTEGER), g.h))
  JOIN (SELECT scene_id, avg(ghi_annual) AS g FROM classed GROUP BY 1) a ON a.scene_id = t.scene_id),
e AS (SELECT *, greatest(0, ghi * 0.75) AS yy FROM sg)"""


@query(
    "r9_site_selection_pipeline",
    f"""{ENERGY_SQL}
SELECT scene_id, CAST(site_id AS BIGINT) AS site_id, CAST(rank AS INTEGER) AS rank, CAST(area_km2 AS DOUBLE) AS area_km2, round(yy, 1) AS kwh_per_kwp_yr, round(CAST(yy * (area_km2 * 45) / 1000 AS DOUBLE), 3) AS gwh_per_yr,
  round((1000 * (0.07 * power(1.07, 25) / (power(1.07, 25) - 1)) + 17) / yy, 5) AS lcoe, round(CAST(area_km2 * 45 AS DOUBLE), 2) AS capacity_mwp, 'ghi_pr_offline' AS energy_method FROM e""",
)
def r9_site_selection_pipeline(spark, sf_dir):
    """Layers to scores, classes, regions, ranked sites and energy, for every scene."""
    result = select_sites(cells(spark, sf_dir), grids(spark, sf_dir), REG)["sites"]
    return result.select(
        "scene_id", "site_id", "rank", "area_km2", "kwh_per_kwp_yr", "gwh_per_yr", "lcoe", "capacity_mwp", "energy_method"
    )


# Land cover of the three-degree tiles in place of the layer, and cells right of a line from each scene's north-west corner.
LEAN_M = 4100.0
SOURCED_SQL = (
    ENERGY_SQL.replace(
        f"{BASE_SQL},\ncells AS (",
        f"""{_GLOBE_SQL}, {GRIDS_SQL.strip()},
lc AS (SELECT scene_id, row, col, ([{', '.join(map(str, LAND_COVER))}])[(CAST(floor(sr + 0.5) AS BIGINT) // 5 + CAST(floor(sc + 0.5) AS BIGINT) // 7) % 11 + 1] AS code
  FROM tg JOIN pt USING (scene_id, row, col) JOIN grids g USING (scene_id) WHERE (pt.x - g.minx) * (g.maxy - g.miny) > {LEAN_M} * (g.maxy - pt.y)),
cells AS (""",
        1,
    )
    .replace(f"{duck_text(LAYERS['lulc'])} AS lulc", "lc.code AS lulc", 1)
    .replace("  FROM base\n)", "  FROM base JOIN lc USING (scene_id, row, col)\n)", 1)
)


@query(
    "r9_sources_to_sites",
    f"""{SOURCED_SQL},{inverse_sql('top', 'geo_top', 'scene_id, site_id')},
fr AS (SELECT scene_id, count(*) AS n, max(area_km2) AS largest FROM e GROUP BY 1)
SELECT scene_id, CAST(site_id AS BIGINT) AS site_id, CAST(rank AS INTEGER) AS rank, CAST(area_km2 AS DOUBLE) AS area_km2, CAST(area_km2 AS DOUBLE) AS outline_km2, round(mean_lsi, 8) AS mean_lsi,
  round(lon, 7) AS centroid_lon, round(lat, 7) AS centroid_lat, round(yy, 1) AS kwh_per_kwp_yr, round(CAST(yy * (area_km2 * 45) / 1000 AS DOUBLE), 3) AS gwh_per_yr,
  n AS sites_of_scene, CAST(round_even(largest, 0) AS BIGINT) AS largest_km2, 1 AS failed_sources
FROM e JOIN geo_top USING (scene_id, site_id) JOIN fr USING (scene_id)""",
)
def r9_sources_to_sites(spark, sf_dir):
    """Tiles, layer tables and areas to ranked sites with outlines and framing; the first source of one layer fails.

    A second call over the same store reads everything from there.
    """
    spec = grids(spark, sf_dir)
    others = [name for name in LAYERS if name not in ("x", "y", "lulc")]
    value = f"element_at(array({', '.join(map(str, LAND_COVER))}), CAST((gr div 5 + gc div 7) % 11 AS INT) + 1)"

    def unreachable():
        raise ConnectionError("source did not answer")

    sources = {
        "layers": [unreachable, lambda: cells(spark, sf_dir, *others)],
        "lulc": lambda: _from_tiles(spark, sf_dir, gr.LAND_COVER_TILE_DEG, value, "nearest").select(*CELL, F.col("value").cast("int").alias("lulc")),
    }
    corner = "named_struct('x', {}, 'y', {})".format
    corners = ", ".join([corner("minx", "maxy"), corner("maxx + 1", "maxy"), corner("maxx + 1", "miny"), corner(f"minx + {LEAN_M}", "miny"), corner("minx", "maxy")])
    areas = spec.selectExpr("scene_id", "1L AS area_id", f"array(array({corners})) AS rings")
    result = sites_from_sources(cells(spark, sf_dir, "x", "y"), spec, sources, REG, scratch_path(spark, "sites-store"), areas)
    doubled = """aggregate(flatten(transform(polygons, p -> flatten(transform(p, r -> transform(sequence(0, size(r) - 2),
        i -> (r[i + 1].x - r[i].x) * (r[i + 1].y + r[i].y)))))), 0D, (s, v) -> s + v)"""
    framing = result["framing"].select(
        "scene_id", F.regexp_extract("note", "found: ([0-9]+)", 1).cast("bigint").alias("sites_of_scene"), F.regexp_extract("note", "about ([0-9]+) km2", 1).cast("bigint").alias("largest_km2")
    )
    return result["sites"].join(framing, "scene_id").select(
        "scene_id", "site_id", "rank", "area_km2", F.round(F.abs(F.expr(doubled)) / 2e6, 6).alias("outline_km2"), F.round("mean_lsi", 8).alias("mean_lsi"),
        F.round("centroid_lon", 7).alias("centroid_lon"), F.round("centroid_lat", 7).alias("centroid_lat"),
        F.round("kwh_per_kwp_yr", 1).alias("kwh_per_kwp_yr"), F.round("gwh_per_yr", 3).alias("gwh_per_yr"),
        "sites_of_scene", "largest_km2", F.lit(result["failed"].count()).cast("int").alias("failed_sources"),
    )
