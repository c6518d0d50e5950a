"""Declared schemas of source documents and working tables."""

from __future__ import annotations

# GeoJSON: coordinate nesting differs per geometry type, so it is kept as text here
# and parsed by type in the AOI source.
_GEOMETRY = "STRUCT<type: STRING, coordinates: STRING>"
AOI_DOC = (
    f"type STRING, coordinates STRING, geometry {_GEOMETRY}, "
    f"features ARRAY<STRUCT<type: STRING, geometry: {_GEOMETRY}>>"
)
POLYGON_COORDS = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
MULTIPOLYGON_COORDS = "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>"
POLYGONS = "ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>"

MONTHLY_DOC = "outputs STRUCT<monthly: ARRAY<STRUCT<year: INT, month: INT, `H(h)_m`: DOUBLE>>>"
HOURLY_DOC = (
    "outputs STRUCT<tmy_hourly: ARRAY<STRUCT<`time(UTC)`: STRING, T2m: DOUBLE, RH: DOUBLE, "
    "`G(h)`: DOUBLE, `Gb(n)`: DOUBLE, `Gd(h)`: DOUBLE, `IR(h)`: DOUBLE, WS10m: DOUBLE, "
    "WD10m: DOUBLE, SP: DOUBLE>>>"
)
CLIMATE_DOC = (
    "latitude DOUBLE, longitude DOUBLE, hourly_units MAP<STRING, STRING>, "
    "hourly STRUCT<time: ARRAY<STRING>, temperature_2m: ARRAY<DOUBLE>, "
    "relative_humidity_2m: ARRAY<DOUBLE>, wind_speed_10m: ARRAY<DOUBLE>>"
)
ELEMENTS_DOC = (
    "elements ARRAY<STRUCT<type: STRING, id: BIGINT, lat: DOUBLE, lon: DOUBLE, "
    "nodes: ARRAY<BIGINT>, tags: MAP<STRING, STRING>>>"
)
PLACES_DOC = (
    "features ARRAY<STRUCT<geometry: STRUCT<coordinates: ARRAY<DOUBLE>>, properties: STRUCT<"
    "name: STRING, osm_key: STRING, osm_value: STRING, type: STRING, city: STRING, "
    "county: STRING, state: STRING, country: STRING, extent: ARRAY<DOUBLE>>>>"
)

FEATURES = (
    "scene_id STRING, feature_id BIGINT, kind STRING, tags MAP<STRING, STRING>, "
    "geom_type STRING, coords ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
)
PROTECTED = (
    "area_id BIGINT, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE, "
    "rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
)
SITES = (
    "scene_id STRING, site_id BIGINT, area_km2 DOUBLE, mean_lsi DOUBLE, max_lsi DOUBLE, "
    "centroid_x DOUBLE, centroid_y DOUBLE, centroid_lon DOUBLE, centroid_lat DOUBLE, "
    "mean_ptl_dist DOUBLE, rank INT"
)
