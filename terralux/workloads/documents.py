"""Sources, sinks, matrices and places: documents and tables built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralux.operators import gazetteer, pairwise, vectors
from terralux.operators.overlay import class_distribution, with_class_areas
from terralux.operators.energy import annual_irradiation, annual_means, specific_yield
from terralux.plans.suitability import classified_cells
from terralux.session import scratch_path
from terralux.sinks import tables as sink
from terralux.sources import documents as doc
from terralux.sources import rasters
from terralux.workloads.catalog import query
from terralux.workloads.inputs import BASE_SQL, EPSG, WEATHER_SQL, base_cells, cells, cells_sql, table, weather
from terralux.workloads.land import CELL, DIST_SQL, EQUAL_SQL, LABEL_SQL, REG
from terralux.workloads.solar import DERATE, MONTHLY_SQL, monthly, power_sql
from terralux.workloads.spatial import inverse_sql

# ---- S2, S3, S4, S19 -------------------------------------------------------------------


def monthly_documents(spark, sf_dir):
    """One document per location; location 6 answers without records."""
    rows = F.collect_list(F.struct("year", "month", F.col("ghi").alias("H(h)_m")))
    filled = monthly(spark, sf_dir).groupBy("loc").agg(rows.alias("m"))
    empty = F.array().cast("array<struct<year:int,month:int,`H(h)_m`:double>>")
    return filled.select(
        "loc",
        F.to_json(F.struct(F.struct(F.when(F.col("loc") == 6, empty).otherwise(F.col("m")).alias("monthly")).alias("outputs"))).alias("text"),
    )


@query("s2_monthly_records", f"WITH {MONTHLY_SQL} SELECT loc, round(avg(g), 5) AS ghi_annual, count(*) AS years FROM (SELECT loc, year, sum(ghi) AS g FROM mon WHERE loc <> 6 GROUP BY 1, 2) GROUP BY 1")
def s2_monthly_records(spark, sf_dir):
    parsed = doc.parse_monthly(monthly_documents(spark, sf_dir), ["loc"])
    return annual_irradiation(parsed, ["loc"]).withColumn("ghi_annual", F.round("ghi_annual", 5))


@query("s2_without_records", "SELECT DISTINCT l_suppkey % 7 AS loc FROM lineitem WHERE l_suppkey % 7 = 6")
def s2_without_records(spark, sf_dir):
    return doc.without_monthly(monthly_documents(spark, sf_dir), ["loc"])


def hourly_documents(spark, sf_dir):
    """One document per station and day, in the source's field names."""
    record = F.struct(
        F.date_format("ts", "yyyyMMdd:HHmm").alias("time(UTC)"),
        F.col("temp_air").alias("T2m"),
        F.col("ghi").alias("G(h)"),
        F.col("dni").alias("Gb(n)"),
        F.col("dhi").alias("Gd(h)"),
        F.col("wind_speed").alias("WS10m"),
    )
    days = weather(spark, sf_dir).groupBy("site_id", "lat", "lon", F.to_date("ts").alias("day")).agg(F.collect_list(record).alias("h"))
    return days.select("site_id", "lat", "lon", F.to_json(F.struct(F.struct(F.col("h").alias("tmy_hourly")).alias("outputs"))).alias("text"))


@query("s3_hourly_records", f"WITH {WEATHER_SQL} SELECT site_id, ts, round(ghi, 8) AS ghi, round(dni, 8) AS dni, round(temp_air, 8) AS temp_air, wind_speed FROM weather")
def s3_hourly_records(spark, sf_dir):
    df = doc.parse_hourly(hourly_documents(spark, sf_dir), ["site_id"])
    return df.select("site_id", "ts", *(F.round(c, 8).alias(c) for c in ("ghi", "dni", "temp_air")), "wind_speed")


@query(
    "s19_weather_per_location",
    f"""WITH {WEATHER_SQL}, shaped AS (SELECT *, abs(lat) AS tilt, CASE WHEN lat >= 0 THEN 180.0 ELSE 0.0 END AS azimuth FROM weather),{power_sql('shaped')}
SELECT printf('%.4f', lon) || ',' || printf('%.4f', lat) AS key, round(sum(ac_w) / 1000 * {DERATE!r}::DOUBLE, 6) AS specific_yield FROM power GROUP BY 1""",
)
def s19_weather_per_location(spark, sf_dir):
    """Documents keyed by rounded position, stored once (K6), read back and modelled."""
    parsed = doc.parse_hourly(hourly_documents(spark, sf_dir), ["site_id", "lat", "lon"])
    keyed = parsed.withColumn("key", doc.weather_key(F.col("lon"), F.col("lat")))
    store = sink.ResultStore(spark, scratch_path(spark, "store"))
    kept = store.get_or_compute("weather", "all", {"decimals": 4}, lambda: keyed)
    return specific_yield(kept, ["key"]).withColumn("specific_yield", F.round("specific_yield", 6))


def climate_documents(spark, sf_dir):
    """Parallel hourly arrays per user; some values are null, units differ by user."""
    hour = F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("t"), F.expr("IF(event_id % 5 <> 0, value, NULL)").alias("v"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(hour)).alias("h"))
    unit = F.element_at(F.array(F.lit("km/h"), F.lit("m/s"), F.lit(None)), (F.col("user_id") % 3).cast("int") + 1)
    values = F.transform("h", lambda x: x["v"])
    text = F.to_json(
        F.struct(
            F.col("user_id").cast("double").alias("latitude"),
            F.lit(0.0).alias("longitude"),
            F.create_map(F.lit("wind_speed_10m"), unit).alias("hourly_units"),
            F.struct(
                F.transform("h", lambda x: x["t"]).alias("time"),
                values.alias("temperature_2m"),
                values.alias("relative_humidity_2m"),
                values.alias("wind_speed_10m"),
            ).alias("hourly"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.select("user_id", text.alias("text"))


@query(
    "s4_climate_response",
    """WITH e AS (SELECT user_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)
SELECT user_id, CAST(user_id AS DOUBLE) AS lat, round(avg(v), 6) AS temperature, round(avg(CASE WHEN user_id % 3 = 1 THEN v ELSE v / 3.6 END), 6) AS wind_speed, count(v) AS n_temperature FROM e GROUP BY 1""",
)
def s4_climate_response(spark, sf_dir):
    hourly = doc.parse_climate(climate_documents(spark, sf_dir), ["user_id"])
    means = annual_means(hourly, ["user_id", "lat"], ["temperature", "wind_speed"])
    return means.select("user_id", "lat", F.round("temperature", 6).alias("temperature"), F.round("wind_speed", 6).alias("wind_speed"), "n_temperature")


# ---- S5-S9 map elements ----------------------------------------------------------------

# Nodes from parts; a way per ten parts runs over four node ids, every third is closed, every
# seventh refers to a node that does not exist. Ways and nodes share a scene per part key.
_KEYS = ("power", "highway", "railway", "landuse")
NODES_SQL = """nd AS (SELECT 's' || (p_partkey // 500) AS scene_id, p_partkey AS node_id, CAST(p_partkey % 100 AS DOUBLE) / 10 AS x, CAST(p_partkey // 100 AS DOUBLE) / 10 AS y,
  CASE WHEN p_partkey % 20 = 3 THEN 'village' WHEN p_partkey % 20 = 4 THEN 'hamlet' END AS place, CASE WHEN p_partkey % 50 = 7 THEN 'substation' END AS power FROM part),
wy AS (SELECT 's' || (p_partkey // 500) AS scene_id, p_partkey AS id, p_partkey % 4 AS kind, p_size % 2 AS good, (p_partkey // 10) % 3 = 0 AS closed, (p_partkey // 10) % 7 = 0 AS broken FROM part WHERE p_partkey % 10 = 0),
wkind AS (SELECT *, CASE WHEN (id // 10) % 4 = 0 THEN 'power' WHEN (id // 10) % 4 = 1 THEN 'highway' WHEN (id // 10) % 4 = 2 THEN 'railway' ELSE 'landuse' END AS k FROM wy),
wv AS (SELECT *, CASE k WHEN 'power' THEN 'line' WHEN 'highway' THEN CASE WHEN good = 1 THEN 'primary' ELSE 'track' END WHEN 'railway' THEN CASE WHEN good = 1 THEN 'rail' ELSE 'tram' END ELSE CASE WHEN good = 1 THEN 'residential' ELSE 'farm' END END AS v FROM wkind)"""


def elements(spark, sf_dir):
    """One answer document per scene, parsed and split into nodes and ways."""
    part = table(spark, sf_dir, "part")
    tags = "map_filter(map('place', CASE WHEN p_partkey % 20 = 3 THEN 'village' WHEN p_partkey % 20 = 4 THEN 'hamlet' END, 'power', IF(p_partkey % 50 = 7, 'substation', NULL)), (k, v) -> v IS NOT NULL)"
    nodes = part.selectExpr(
        "concat('s', p_partkey div 500) AS scene_id",
        f"named_struct('type', 'node', 'id', p_partkey, 'lat', CAST(p_partkey div 100 AS DOUBLE) / 10, 'lon', CAST(p_partkey % 100 AS DOUBLE) / 10, 'nodes', CAST(NULL AS ARRAY<BIGINT>), 'tags', {tags}) AS e",
    )
    ways = part.filter("p_partkey % 10 = 0").selectExpr(
        "concat('s', p_partkey div 500) AS scene_id",
        "p_partkey AS id",
        "element_at(array('power', 'highway', 'railway', 'landuse'), CAST((p_partkey div 10) % 4 AS INT) + 1) AS k",
        "p_size % 2 = 1 AS good",
        "IF((p_partkey div 10) % 7 = 0, -1L, p_partkey + 2) AS third",
        "IF((p_partkey div 10) % 3 = 0, p_partkey, p_partkey + 3) AS last",
    ).selectExpr(
        "scene_id",
        """named_struct('type', 'way', 'id', id, 'lat', CAST(NULL AS DOUBLE), 'lon', CAST(NULL AS DOUBLE), 'nodes', array(id, id + 1, third, last),
             'tags', map(k, CASE k WHEN 'power' THEN 'line' WHEN 'highway' THEN IF(good, 'primary', 'track') WHEN 'railway' THEN IF(good, 'rail', 'tram') ELSE IF(good, 'residential', 'farm') END)) AS e""",
    )
    docs = nodes.unionByName(ways).groupBy("scene_id").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("text"))
    return doc.split_elements(doc.parse_elements(docs, ["scene_id"]))


WAYGEO_SQL = "geo AS (SELECT *, CASE WHEN broken THEN 3 ELSE 4 END AS positions, CASE WHEN closed AND NOT broken THEN 'Polygon' ELSE 'LineString' END AS geom_type FROM wv)"


@query("s5_elements", f"WITH {NODES_SQL} SELECT scene_id, 'node' AS type, count(*) AS n FROM nd GROUP BY 1 UNION ALL SELECT scene_id, 'way', count(*) FROM wv GROUP BY 1")
def s5_elements(spark, sf_dir):
    nodes, ways = elements(spark, sf_dir)
    both = nodes.select("scene_id", F.lit("node").alias("type")).unionByName(ways.select("scene_id", F.lit("way").alias("type")))
    return both.groupBy("scene_id", "type").agg(F.count("*").alias("n"))


@query(
    "c18_j4_way_assembly",
    f"WITH {NODES_SQL}, {WAYGEO_SQL} SELECT scene_id, id AS feature_id, geom_type, CAST(positions AS INTEGER) AS positions, round((id % 100) / 10.0, 6) + 0.0 AS first_x FROM geo",
)
def c18_j4_way_assembly(spark, sf_dir):
    nodes, ways = elements(spark, sf_dir)
    shapes = vectors.assemble_ways(ways, nodes)
    return shapes.select("scene_id", "feature_id", "geom_type", F.size("coords").alias("positions"), F.round(F.col("coords")[0]["x"], 6).alias("first_x"))


@query(
    "p11_tag_predicate",
    f"WITH {NODES_SQL} SELECT scene_id, node_id, place IS NOT NULL AS any_place, coalesce(place = 'village', false) AS village, coalesce(place = 'village' AND power IS NOT NULL, false) AS both_keys FROM nd",
)
def p11_tag_predicate(spark, sf_dir):
    nodes, _ = elements(spark, sf_dir)
    t = F.col("tags")
    return nodes.select(
        "scene_id", "node_id", vectors.tag_matches(t, {"place": None}).alias("any_place"),
        vectors.tag_matches(t, {"place": vectors.PLACE_VALUES}).alias("village"),
        vectors.tag_matches(t, {"place": ("village",), "power": None}).alias("both_keys"),
    )


def _features(spark, sf_dir):
    nodes, ways = elements(spark, sf_dir)
    return vectors.assemble_ways(ways, nodes), vectors.point_features(nodes)


def _kinds(df):
    return df.select(
        "scene_id", "feature_id", "geom_type", F.size("coords").alias("positions"), (F.round(F.col("coords")[0]["x"], 6) + 0.0).alias("first_x")
    )


_WAY_ROWS = "SELECT scene_id, id AS feature_id, geom_type, CAST(positions AS INTEGER) AS positions, round((id % 100) / 10.0, 6) + 0.0 AS first_x FROM geo"
_NODE_ROWS = "SELECT scene_id, node_id AS feature_id, 'Point' AS geom_type, CAST(1 AS INTEGER) AS positions, round(x, 6) + 0.0 AS first_x FROM nd"


@query("s6_power_features", f"WITH {NODES_SQL}, {WAYGEO_SQL} {_WAY_ROWS} UNION ALL {_NODE_ROWS}")
def s6_power_features(spark, sf_dir):
    """Every way and node of the answer."""
    return _kinds(vectors.power_features(*_features(spark, sf_dir)))


@query("s6_power_features_tagged", f"WITH {NODES_SQL}, {WAYGEO_SQL} {_WAY_ROWS} WHERE k = 'power' UNION ALL {_NODE_ROWS} WHERE power IS NOT NULL")
def s6_power_features_tagged(spark, sf_dir):
    return _kinds(vectors.power_features(*_features(spark, sf_dir), require_tags=True))


@query("s7_road_features", f"WITH {NODES_SQL}, {WAYGEO_SQL} {_WAY_ROWS} WHERE v = 'primary'")
def s7_road_features(spark, sf_dir):
    return _kinds(vectors.road_features(_features(spark, sf_dir)[0]))


@query("s8_railway_features", f"WITH {NODES_SQL}, {WAYGEO_SQL} {_WAY_ROWS} WHERE v = 'rail'")
def s8_railway_features(spark, sf_dir):
    return _kinds(vectors.railway_features(_features(spark, sf_dir)[0]))


@query("s9_urban_features", f"WITH {NODES_SQL}, {WAYGEO_SQL} {_WAY_ROWS} WHERE v = 'residential' UNION ALL {_NODE_ROWS} WHERE place = 'village'")
def s9_urban_features(spark, sf_dir):
    return _kinds(vectors.urban_features(*_features(spark, sf_dir)))


@query(
    "j9_u1_duplicate_geometries",
    "SELECT 's0' AS scene_id, min(l_orderkey * 10 + l_linenumber) AS feature_id, count(*) AS copies FROM lineitem GROUP BY l_quantity, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey END",
)
def j9_u1_duplicate_geometries(spark, sf_dir):
    """Two ragged halves concatenated; one geometry in three is a copy of few originals."""
    points = table(spark, sf_dir, "lineitem").selectExpr(
        "'s0' AS scene_id", "l_orderkey * 10 + l_linenumber AS feature_id", "'Point' AS geom_type",
        "array(named_struct('x', l_quantity, 'y', CAST(IF(l_suppkey % 3 = 0, 0, l_suppkey) AS DOUBLE))) AS coords", "l_suppkey",
    )
    both = vectors.concat_features(
        points.filter("l_suppkey % 2 = 0").withColumn("extra", F.lit("even")), points.filter("l_suppkey % 2 = 1")
    )
    kept = vectors.drop_duplicate_geometries(both)
    copies = points.groupBy("scene_id", "coords").agg(F.count("*").alias("copies"))
    return kept.join(copies, ["scene_id", "coords"]).select("scene_id", "feature_id", "copies")


# ---- S10-S14, S17 rasters --------------------------------------------------------------

# Pixels of overlapping tiles from line items: a pixel per (part, supplier block); the missing code every ninth line.
TILE_SQL = """px AS (SELECT l_partkey % 40 AS row, l_suppkey % 30 AS col, l_orderkey * 10 + l_linenumber AS tile_order, CASE WHEN l_orderkey % 9 = 0 THEN -9999.0::DOUBLE ELSE l_quantity END AS value FROM lineitem)"""


def tile_pixels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_partkey % 40 AS INT) AS row", "CAST(l_suppkey % 30 AS INT) AS col", "l_orderkey * 10 + l_linenumber AS tile_order",
        "IF(l_orderkey % 9 = 0, -9999.0D, l_quantity) AS value", "CAST(l_quantity AS INT) AS code",
    )


@query("s12_elevation_mosaic", f"WITH {TILE_SQL} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, arg_min(value, tile_order) AS value FROM px WHERE value <> -9999 GROUP BY 1, 2")
def s12_elevation_mosaic(spark, sf_dir):
    pixels = rasters.elevation_pixels(tile_pixels(spark, sf_dir))
    return rasters.mosaic(pixels, ["row", "col"])


@query("s13_land_cover_mosaic", f"WITH {TILE_SQL} SELECT CAST(l_partkey % 40 AS INTEGER) AS row, CAST(l_suppkey % 30 AS INTEGER) AS col, arg_min(CAST(l_quantity AS INTEGER), l_orderkey * 10 + l_linenumber) AS code FROM lineitem GROUP BY 1, 2")
def s13_land_cover_mosaic(spark, sf_dir):
    return rasters.mosaic(tile_pixels(spark, sf_dir), ["row", "col"], "code")


@query("s14_secondary_elevation", f"WITH {cells_sql('elevation', keep_base=True)} SELECT scene_id, row, col, CASE WHEN k % 3 = 0 OR elevation IS NULL THEN CASE WHEN k % 5 <> 0 THEN 1.0 * k END ELSE elevation END AS value FROM cells WHERE NOT (k % 3 = 0 AND k % 5 = 0)")
def s14_secondary_elevation(spark, sf_dir):
    """The primary lacks every third cell, the secondary every fifth."""
    keyed = base_cells(spark, sf_dir).select(*CELL, "k")
    primary = cells(spark, sf_dir, "elevation").join(keyed.filter("k % 3 <> 0"), CELL).select(*CELL, F.col("elevation").alias("value"))
    secondary = keyed.filter("k % 5 <> 0").select(*CELL, F.col("k").cast("double").alias("value"))
    return rasters.with_fallback(primary, secondary, CELL)


@query("s11_shard_merge", "SELECT p_partkey % 3 AS shard, count(*) AS areas, count(CASE WHEN p_partkey % 3 = 1 THEN 1 END) AS named FROM part GROUP BY 1")
def s11_shard_merge(spark, sf_dir):
    """Three stored shards, one with an extra column."""
    part = table(spark, sf_dir, "part").selectExpr("p_partkey AS area_id", "p_partkey % 3 AS shard", "p_name AS name")
    paths = []
    for i in range(3):
        shard = part.filter(F.col("shard") == i)
        paths.append(scratch_path(spark, f"shard{i}"))
        (shard if i == 1 else shard.drop("name")).write.parquet(paths[-1])
    merged = rasters.merge_shards(spark, paths)
    return merged.groupBy("shard").agg(F.count("*").alias("areas"), F.count("name").alias("named"))


@query("s10_absent_protected_file", f"WITH {BASE_SQL} SELECT scene_id, count(*) AS cells, CAST(0 AS BIGINT) AS protected_cells, false AS available FROM base GROUP BY 1")
def s10_absent_protected_file(spark, sf_dir):
    """No file: an empty layer and a flag, the run goes on."""
    from terralux.workloads.inputs import grids

    areas, available = rasters.read_protected(spark, scratch_path(spark, "absent"))
    inside = vectors.protected_cells(areas.withColumn("scene_id", F.lit("s0")), grids(spark, sf_dir)).withColumn("hit", F.lit(True))
    joined = base_cells(spark, sf_dir).select(*CELL).join(inside, CELL, "left")
    return joined.groupBy("scene_id").agg(F.count("*").alias("cells"), F.count("hit").alias("protected_cells")).withColumn("available", F.lit(available))


@query(
    "s17_dataset_assembly",
    f"WITH {cells_sql('slope', 'lulc', 'temperature')} SELECT scene_id, count(*) AS cells, count(slope) AS slope, count(lulc) AS lulc, count(temperature) AS temperature, 3 AS failed, 'humidity,humidity,temperature' AS layers FROM cells GROUP BY 1",
)
def s17_dataset_assembly(spark, sf_dir):
    """Three layers arrive, one of them from its second source as the first fails while it runs; a fourth has no source left."""

    def unreachable():
        raise ConnectionError("source did not answer")

    @F.udf("double")
    def breaks_on_row_five(row, value):
        if row == 5:
            raise ValueError("broken record")
        return value

    def breaking(layer):
        return cells(spark, sf_dir, layer).withColumn(layer, breaks_on_row_five("row", layer))

    base = base_cells(spark, sf_dir).select(*CELL)
    made, report = rasters.assemble(
        base,
        {
            "slope": lambda: cells(spark, sf_dir, "slope"),
            "humidity": [unreachable, lambda: breaking("humidity")],
            "temperature": [lambda: breaking("temperature"), lambda: cells(spark, sf_dir, "temperature")],
            "lulc": lambda: cells(spark, sf_dir, "lulc"),
        },
    )
    failed = report.agg(F.count("*").cast("int"), F.concat_ws(",", F.array_sort(F.collect_list("layer")))).first()
    return made.groupBy("scene_id").agg(F.count("*").alias("cells"), *(F.count(c).alias(c) for c in ("slope", "lulc", "temperature"))).withColumns(
        {"failed": F.lit(failed[0]), "layers": F.lit(failed[1])}
    )


@query("p9_band_selection", f"WITH {cells_sql('temperature', 'humidity', 'wind_speed')} SELECT scene_id, band, count(value) AS n, round(sum(value), 6) AS total FROM (UNPIVOT cells ON temperature, humidity, wind_speed INTO NAME band VALUE value) GROUP BY 1, 2")
def p9_band_selection(spark, sf_dir):
    """Bands are columns; the long form is an unpivot."""
    wide = cells(spark, sf_dir, "temperature", "humidity", "wind_speed")
    long = wide.unpivot(CELL, ["temperature", "humidity", "wind_speed"], "band", "value")
    return long.groupBy("scene_id", "band").agg(F.count("value").alias("n"), F.round(F.sum("value"), 6).alias("total"))


# ---- sinks -----------------------------------------------------------------------------


@query("k1_layer_write", f"WITH {EQUAL_SQL} SELECT scene_id, row, col, coalesce(lsi_class, -9999) AS lsi_class, {EPSG} AS crs_epsg FROM classed")
def k1_layer_write(spark, sf_dir):
    path = scratch_path(spark, "layer")
    sink.write_layer(classified_cells(cells(spark, sf_dir), REG), path, "lsi_class", EPSG)
    return spark.read.parquet(path).select(*CELL, "lsi_class", "crs_epsg")


@query(
    "k2_layer_bounds",
    f"WITH {cells_sql('x', 'y')}, lo AS (SELECT scene_id, {EPSG} AS epsg, min(x) AS x, min(y) AS y FROM cells GROUP BY 1), hi AS (SELECT scene_id, {EPSG} AS epsg, max(x) AS x, max(y) AS y FROM cells GROUP BY 1),"
    f"{inverse_sql('lo', 'glo', 'scene_id')},{inverse_sql('hi', 'ghi', 'scene_id').replace('ghi_', 'gh_').replace('ghi AS', 'gh AS')} "
    "SELECT scene_id, round(a.lon, 7) AS west, round(a.lat, 7) AS south, round(b.lon, 7) AS east, round(b.lat, 7) AS north FROM glo a JOIN gh b USING (scene_id)",
)
def k2_layer_bounds(spark, sf_dir):
    df = sink.layer_bounds(cells(spark, sf_dir, "x", "y").withColumn("epsg", F.lit(EPSG)))
    return df.select("scene_id", *(F.round(c, 7).alias(c) for c in ("west", "south", "east", "north")))


@query(
    "k4_class_csv",
    f"WITH {EQUAL_SQL},{DIST_SQL} SELECT scene_id, class_id, {LABEL_SQL} AS label, pct AS pct_of_valid_area, round(pct / 100e0 * 1000, 2) AS area_km2 FROM dist",
)
def k4_class_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    shares = class_distribution(classified_cells(cells(spark, sf_dir), REG), ["scene_id"], REG)
    sink.write_class_csv(with_class_areas(shares, F.lit(0.25), F.lit(1000.0)), path)
    return spark.read.schema("scene_id STRING, class_id INT, label STRING, pct_of_valid_area DOUBLE, area_km2 DOUBLE").csv(path, header=True)


@query("k6_result_store", "SELECT s_nationkey, count(*) AS suppliers, 1 AS computed FROM supplier GROUP BY 1")
def k6_result_store(spark, sf_dir):
    """The same key is computed once and read twice; after invalidation it is gone."""
    store = sink.ResultStore(spark, scratch_path(spark, "store"))
    calls = []

    def compute():
        calls.append(1)
        return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))

    store.get_or_compute("suppliers", "h", {"b": 1, "a": 2}, compute)
    kept = store.get_or_compute("suppliers", "h", {"a": 2, "b": 1}, compute)
    store.get_or_compute("gone", "h", {}, lambda: kept)
    store.invalidate("gone", "h", {})
    assert not store.exists("gone", "h", {})
    return kept.withColumn("computed", F.lit(len(calls)))


# ---- matrices --------------------------------------------------------------------------

# A 4 x 4 matrix per customer from integer weights; one pair is scaled, some are broken on purpose.
MATRIX_SQL = """mx AS (SELECT c_custkey AS id, i, j, CAST(1 + (c_custkey * (i + 3)) % 9 AS DOUBLE) / CAST(1 + (c_custkey * (j + 3)) % 9 AS DOUBLE)
  * CASE WHEN i = 0 AND j = 2 THEN 1 + c_custkey % 5 WHEN i = 2 AND j = 0 THEN 1 / CAST(1 + c_custkey % 5 AS DOUBLE) ELSE 1 END AS a0 FROM customer, range(4) t(i), range(4) u(j)),
mb AS (SELECT id, i, j, CASE WHEN id % 20 = 3 AND i = 1 AND j = 2 THEN a0 * 1.5 WHEN id % 20 = 7 AND i = 1 AND j = 1 THEN 2 WHEN id % 20 = 11 AND i = 3 AND j = 0 THEN -a0 ELSE a0 END AS a FROM mx WHERE NOT (id % 20 = 15 AND i = 2 AND j = 3)),
good AS (SELECT * FROM mb WHERE id % 20 NOT IN (3, 7, 11, 15))"""


def matrices(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS matrix_id", "explode(sequence(0, 3)) AS i"
    ).selectExpr("matrix_id", "i", "explode(sequence(0, 3)) AS j").selectExpr(
        "matrix_id", "i", "j",
        """CAST(1 + (matrix_id * (i + 3)) % 9 AS DOUBLE) / CAST(1 + (matrix_id * (j + 3)) % 9 AS DOUBLE)
           * CASE WHEN i = 0 AND j = 2 THEN CAST(1 + matrix_id % 5 AS DOUBLE) WHEN i = 2 AND j = 0 THEN 1 / CAST(1 + matrix_id % 5 AS DOUBLE) ELSE 1.0D END AS a0""",
    ).filter("NOT (matrix_id % 20 = 15 AND i = 2 AND j = 3)").selectExpr(
        "matrix_id", "i", "j",
        "CASE WHEN matrix_id % 20 = 3 AND i = 1 AND j = 2 THEN a0 * 1.5D WHEN matrix_id % 20 = 7 AND i = 1 AND j = 1 THEN 2.0D WHEN matrix_id % 20 = 11 AND i = 3 AND j = 0 THEN -a0 ELSE a0 END AS a",
    )


@query(
    "p45_matrix_validation",
    f"WITH {MATRIX_SQL} SELECT DISTINCT id AS matrix_id, CASE id % 20 WHEN 3 THEN 'not_reciprocal' WHEN 7 THEN 'diagonal' WHEN 11 THEN 'not_positive' WHEN 15 THEN 'not_square' END AS fault FROM mb",
)
def p45_matrix_validation(spark, sf_dir):
    return pairwise.with_faults(pairwise.fold(matrices(spark, sf_dir))).select("matrix_id", "fault")


_W = [f"w{i}" for i in range(4)]
_STEP = ", ".join(f"(a{i}0 * w0 + a{i}1 * w1 + a{i}2 * w2 + a{i}3 * w3) AS v{i}" for i in range(4))
AHP_SQL = (
    f"WITH RECURSIVE {MATRIX_SQL}, wide AS (SELECT id, "
    + ", ".join(f"max(CASE WHEN i = {i} AND j = {j} THEN a END) AS a{i}{j}" for i in range(4) for j in range(4))
    + " FROM good GROUP BY id), pw AS (SELECT *, 0.25::DOUBLE AS w0, 0.25::DOUBLE AS w1, 0.25::DOUBLE AS w2, 0.25::DOUBLE AS w3, 0 AS n FROM wide UNION ALL SELECT "
    + "id, " + ", ".join(f"a{i}{j}" for i in range(4) for j in range(4))
    + ", " + ", ".join(f"v{i} / (v0 + v1 + v2 + v3)" for i in range(4)) + f", n + 1 FROM (SELECT *, {_STEP} FROM pw WHERE n < 150)), "
    + f"res AS (SELECT *, (v0 / w0 + v1 / w1 + v2 / w2 + v3 / w3) / 4 AS lam FROM (SELECT *, {_STEP} FROM pw WHERE n = 150)), "
    + "ahp AS (SELECT *, (lam - 4) / 3 AS ci, (lam - 4) / 3 / 0.9 AS cr FROM res)"
)


@query(
    "p46_matrix_weights",
    f"{AHP_SQL} SELECT id AS matrix_id, round(w0, 7) AS w0, round(w1, 7) AS w1, round(w2, 7) AS w2, round(w3, 7) AS w3, round(lam, 6) AS lambda_max, round(cr, 6) + 0.0 AS cr FROM ahp",
)
def p46_matrix_weights(spark, sf_dir):
    df = pairwise.analyze(matrices(spark, sf_dir))
    return df.select(
        "matrix_id", *(F.round(F.col("weights")[i], 7).alias(n) for i, n in enumerate(_W)), F.round("lambda_max", 6).alias("lambda_max"), (F.round("cr", 6) + 0.0).alias("cr")
    )


@query("p47_strict_weights", f"{AHP_SQL} SELECT id AS matrix_id, cr <= 0.10 AS accepted FROM ahp")
def p47_strict_weights(spark, sf_dir):
    """Accepted matrices and those refused for inconsistency."""
    return pairwise.analyze(matrices(spark, sf_dir)).select("matrix_id", F.col("consistent").alias("accepted"))


@query(
    "p48_worst_triple",
    f"""WITH {MATRIX_SQL}, tr AS (SELECT x.id, x.i, x.j, z.j AS k, abs(z.a - x.a * y.a) AS d FROM good x JOIN good y ON y.id = x.id AND y.i = x.j JOIN good z ON z.id = x.id AND z.i = x.i AND z.j = y.j
  WHERE x.i <> x.j AND y.j <> x.i AND y.j <> x.j), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9) DESC, i, j, k) AS n FROM tr)
SELECT id AS matrix_id, CAST(i AS INTEGER) AS worst_i, CAST(j AS INTEGER) AS worst_j, CAST(k AS INTEGER) AS worst_k, round(d, 8) AS deviation FROM r WHERE n = 1""",
)
def p48_worst_triple(spark, sf_dir):
    """The triple and its deviation; deviations are compared to 9 decimals, then by place."""
    valid = pairwise.with_faults(pairwise.fold(matrices(spark, sf_dir))).filter("fault IS NULL")
    at = "m[{} * 4 + {}]"
    d = f"abs({at.format('worst_i', 'worst_k')} - {at.format('worst_i', 'worst_j')} * {at.format('worst_j', 'worst_k')})"
    return pairwise.with_worst_triple(valid).selectExpr("matrix_id", "worst_i", "worst_j", "worst_k", f"round({d}, 8) AS deviation")


# ---- places ----------------------------------------------------------------------------

PLACE_SQL = """pl AS (SELECT s_suppkey // 20 AS query_id, row_number() OVER (PARTITION BY s_suppkey // 20 ORDER BY s_suppkey) - 1 AS seq, s_suppkey AS k, CAST(s_suppkey % 400 AS DOUBLE) - 200 AS lon, CAST(s_suppkey % 190 AS DOUBLE) - 95 AS lat,
  CASE WHEN s_suppkey % 19 = 0 THEN '' ELSE s_name END AS name, (['place', 'boundary', 'highway', 'building', 'shop'])[CAST(s_suppkey % 5 AS INTEGER) + 1] AS osm_key,
  (['city', 'town', 'village', 'hamlet', 'locality', 'other', 'borough'])[CAST(s_suppkey % 7 AS INTEGER) + 1] AS osm_value,
  CASE WHEN s_suppkey % 4 = 0 THEN 'City' || (s_suppkey % 3) END AS city, 'State' || (s_suppkey % 6) AS state, CASE WHEN s_suppkey % 10 = 0 THEN s_name ELSE 'Country' || s_nationkey END AS country,
  CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 60 AS DOUBLE) / 10 END AS ext FROM supplier),
sc AS (SELECT *, CASE WHEN osm_key = 'place' THEN CASE osm_value WHEN 'city' THEN 60 WHEN 'town' THEN 40 WHEN 'village' THEN 30 WHEN 'hamlet' THEN 20 WHEN 'locality' THEN 10 WHEN 'borough' THEN 40 ELSE 0 END
  WHEN osm_key = 'boundary' THEN 8 WHEN osm_key IN ('highway', 'building') THEN -5 ELSE 0 END + CASE WHEN ext IS NULL THEN 0 ELSE least(ext * 2, 25) END AS score FROM pl WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND name <> '')"""


def candidates(spark, sf_dir):
    """Lookup answers as documents of at most twenty places, parsed into candidate rows."""
    place = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey div 20 AS query_id", "s_suppkey",
        """named_struct('geometry', named_struct('coordinates', array(CAST(s_suppkey % 400 AS DOUBLE) - 200, CAST(s_suppkey % 190 AS DOUBLE) - 95)),
          'properties', named_struct('name', IF(s_suppkey % 19 = 0, '', s_name), 'osm_key', element_at(array('place', 'boundary', 'highway', 'building', 'shop'), CAST(s_suppkey % 5 AS INT) + 1),
            'osm_value', element_at(array('city', 'town', 'village', 'hamlet', 'locality', 'other', 'borough'), CAST(s_suppkey % 7 AS INT) + 1), 'city', IF(s_suppkey % 4 = 0, concat('City', s_suppkey % 3), NULL),
            'state', concat('State', s_suppkey % 6), 'country', IF(s_suppkey % 10 = 0, s_name, concat('Country', s_nationkey)),
            'extent', IF(s_suppkey % 3 = 0, array(0.0D, 2.0D, CAST(s_suppkey % 60 AS DOUBLE) / 10, 0.0D), NULL))) AS f""",
    )
    listed = place.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "f"))).alias("a"))
    docs = listed.select("query_id", F.to_json(F.struct(F.transform("a", lambda x: x["f"]).alias("features"))).alias("text"))
    return doc.parse_places(docs)


_LABEL_SQL = "name || CASE WHEN coalesce(city, state) <> name THEN ', ' || coalesce(city, state) ELSE '' END || CASE WHEN country <> name THEN ', ' || country ELSE '' END"


@query("p49_place_scores", f"WITH {PLACE_SQL} SELECT query_id, CAST(seq AS INTEGER) AS seq, round(CAST(score AS DOUBLE), 6) AS score, {_LABEL_SQL} AS label FROM sc")
def p49_place_scores(spark, sf_dir):
    c = candidates(spark, sf_dir).filter(gazetteer.valid_place(F.col("lon"), F.col("lat"), F.col("name")))
    score = gazetteer.prominence(F.col("osm_key"), F.col("osm_value"), F.col("type"), F.col("extent"))
    label = gazetteer.label(*(F.col(n) for n in ("name", "city", "county", "state", "country")))
    return c.select("query_id", "seq", F.round(score, 6).alias("score"), label.alias("label"))


@query("p50_valid_places", f"WITH {PLACE_SQL} SELECT query_id, count(*) AS valid FROM sc GROUP BY 1")
def p50_valid_places(spark, sf_dir):
    ok = gazetteer.valid_place(F.col("lon"), F.col("lat"), F.col("name"))
    return candidates(spark, sf_dir).filter(ok).groupBy("query_id").agg(F.count("*").alias("valid"))


@query(
    "w8_place_ranking",
    f"WITH {PLACE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS place_rank FROM sc) SELECT query_id, CAST(place_rank AS INTEGER) AS place_rank, name, round(CAST(score AS DOUBLE), 6) AS score FROM r WHERE place_rank <= 3",
)
def w8_place_ranking(spark, sf_dir):
    return gazetteer.search(candidates(spark, sf_dir), limit=3).select("query_id", "place_rank", "name", F.round("score", 6).alias("score"))
