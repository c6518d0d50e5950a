"""JSON documents: areas, irradiation, hourly weather, climate, map elements, places.

Every parser takes a table with the document text, so documents can come from files
(``read_text``), a table column or a stream of either. One document is one row; its arrays
are exploded into rows right away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralux import schema
from terralux.functions.bind import bind
from terralux.functions.units import wind_to_ms
from terralux.session import null_for_nan


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (doc_id, text), the path being the id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )


# ---- S1 areas of interest ------------------------------------------------------------


def _closed_points(rings: Column) -> Column:
    return F.transform(
        rings,
        lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))),
    )


def parse_areas(docs: DataFrame, id_column: str = "aoi_id", text: str = "text") -> DataFrame:
    """Polygon, MultiPolygon, Feature or one-feature collection to (aoi_id, polygons, doc_fault).

    ``doc_fault`` names why a document holds no usable outline; polygons are NULL then.
    """
    doc = bind(docs.select(id_column, text), {"d": F.from_json(text, schema.AOI_DOC)})
    bare = F.struct(F.col("d.type").alias("type"), F.col("d.coordinates").alias("coordinates"))
    first = F.try_element_at("d.features", F.lit(1))
    geometry = (
        F.when(F.col("d.type") == "FeatureCollection", first["geometry"])
        .when(F.col("d.type") == "Feature", F.col("d.geometry"))
        .otherwise(bare)
    )
    size = F.size(F.coalesce("d.features", F.array().cast("array<struct<type:string,geometry:struct<type:string,coordinates:string>>>")))
    opened = bind(doc, {"g": geometry, "_features": size})
    polygons = (
        F.when(
            F.col("g.type") == "Polygon",
            F.array(_closed_points(F.from_json(F.col("g.coordinates"), schema.POLYGON_COORDS))),
        )
        .when(
            F.col("g.type") == "MultiPolygon",
            F.transform(F.from_json(F.col("g.coordinates"), schema.MULTIPOLYGON_COORDS), _closed_points),
        )
    )
    shaped = bind(opened, {"polygons": polygons})
    short = F.exists(F.flatten("polygons"), lambda ring: F.size(ring) < 4)
    fault = (
        F.when(F.col("d").isNull() | F.col("d.type").isNull(), F.lit("not_geojson"))
        .when((F.col("d.type") == "FeatureCollection") & (F.col("_features") != 1), F.lit("not_one_feature"))
        .when(F.col("g").isNull() | F.col("g.type").isNull(), F.lit("null_geometry"))
        .when(~F.col("g.type").isin("Polygon", "MultiPolygon"), F.lit("unsupported_type"))
        .when(F.col("polygons").isNull() | F.coalesce(short, F.lit(True)), F.lit("bad_coordinates"))
    )
    return bind(shaped, {"doc_fault": fault}).select(
        id_column, F.when(F.col("doc_fault").isNull(), F.col("polygons")).alias("polygons"), "doc_fault"
    )


# ---- S2, S3, S4 weather --------------------------------------------------------------


def parse_monthly(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(…, year, month, ghi). A document without records contributes no rows."""
    doc = docs.select(*keys, F.from_json(text, schema.MONTHLY_DOC).alias("d"))
    rows = doc.select(*keys, F.explode("d.outputs.monthly").alias("m"))
    return null_for_nan(rows.select(*keys, "m.year", "m.month", F.col("m.`H(h)_m`").alias("ghi")), "ghi")


def without_monthly(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Documents that hold no monthly record."""
    doc = docs.select(*keys, F.from_json(text, schema.MONTHLY_DOC).alias("d"))
    return doc.filter(F.coalesce(F.size("d.outputs.monthly"), F.lit(0)) <= 0).select(*keys)


def parse_hourly(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """S3: (…, ts, ghi, dni, dhi, temp_air, wind_speed); stamps are UTC."""
    doc = docs.select(*keys, F.from_json(text, schema.HOURLY_DOC).alias("d"))
    rows = doc.select(*keys, F.explode("d.outputs.tmy_hourly").alias("h"))
    wanted = {"G(h)": "ghi", "Gb(n)": "dni", "Gd(h)": "dhi", "T2m": "temp_air", "WS10m": "wind_speed"}
    return null_for_nan(
        rows.select(
            *keys,
            F.try_to_timestamp(F.col("h.`time(UTC)`"), F.lit("yyyyMMdd:HHmm")).alias("ts"),
            *(F.col(f"h.`{raw}`").alias(name) for raw, name in wanted.items()),
        ),
        *wanted.values(),
    )


def parse_climate(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Parallel hourly arrays to rows, wind in m/s."""
    doc = docs.select(*keys, F.from_json(text, schema.CLIMATE_DOC).alias("d"))
    zipped = F.arrays_zip(
        F.col("d.hourly.time").alias("time"),
        F.col("d.hourly.temperature_2m").alias("temperature"),
        F.col("d.hourly.relative_humidity_2m").alias("humidity"),
        F.col("d.hourly.wind_speed_10m").alias("wind"),
    )
    unit = F.try_element_at("d.hourly_units", F.lit("wind_speed_10m"))
    rows = doc.select(
        *keys, F.col("d.latitude").alias("lat"), F.col("d.longitude").alias("lon"), unit.alias("unit"), F.explode(zipped).alias("h")
    )
    return null_for_nan(
        rows.select(
            *keys,
            "lat",
            "lon",
            F.try_to_timestamp(F.col("h.time"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"),
            "h.temperature",
            "h.humidity",
            wind_to_ms(F.col("h.wind"), F.col("unit")).alias("wind_speed"),
        ),
        "temperature",
        "humidity",
        "wind_speed",
    )


def weather_key(lon: Column, lat: Column, decimals: int = 4) -> Column:
    """Cache key of a location's weather, from its rounded position."""
    return F.format_string(f"%.{decimals}f,%.{decimals}f", lon, lat)


# ---- S5 map elements -----------------------------------------------------------------


def parse_elements(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per element (type, id, lat, lon, nodes, tags)."""
    doc = docs.select(*keys, F.from_json(text, schema.ELEMENTS_DOC).alias("d"))
    rows = doc.select(*keys, F.explode("d.elements").alias("e")).select(*keys, "e.*")
    return rows.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))


def split_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways); a node without a position is no node."""
    nodes = elements.filter("type = 'node' AND lat IS NOT NULL AND lon IS NOT NULL").select(
        "scene_id", F.col("id").alias("node_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), "tags"
    )
    ways = elements.filter("type = 'way'").select("scene_id", F.col("id").alias("feature_id"), "nodes", "tags")
    return nodes, ways


# ---- places --------------------------------------------------------------------------


def parse_places(docs: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Lookup answers to candidate rows for :func:`terralux.operators.gazetteer.search`."""
    doc = docs.select(key, F.from_json(text, schema.PLACES_DOC).alias("d"))
    rows = doc.select(key, F.posexplode("d.features").alias("seq", "f"))
    point = F.col("f.geometry.coordinates")
    return rows.filter(F.size(point) >= 2).select(
        F.col(key).alias("query_id"), "seq", point[0].alias("lon"), point[1].alias("lat"), "f.properties.*"
    )
