"""Working tables derived from the given tables, in Spark and as DuckDB CTEs.

Both sides use the same integer arithmetic. Scene ``s0`` holds about a third of all cells
and grows with the data; the other scenes are 50 rows high.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESOLUTION_M = 500
EPSG = 32635
MINX = 300000.0
MAXY = 3500000.0

LAND_COVER = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)
CAPABILITY = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII")
KINDS = ("power", "roads", "railway", "urban")
MARKS = (3, 250, 500, 750)
SEGMENTS_TO_PROFILE = {"BUILDING": "flat", "MACHINERY": "daytime", "HOUSEHOLD": "evening"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BASE_SQL = f"""
base AS (
  SELECT k, gr, gc,
    CASE WHEN gc < 34 THEN 's0' ELSE 's' || CAST(1 + gr // 50 AS VARCHAR) END AS scene_id,
    CAST(CASE WHEN gc < 34 THEN gr ELSE gr % 50 END AS INTEGER) AS row,
    CAST(CASE WHEN gc < 34 THEN gc ELSE gc - 34 END AS INTEGER) AS col
  FROM (SELECT o_orderkey AS k, o_orderkey // 100 AS gr, o_orderkey % 100 AS gc FROM orders)
)"""


def base_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey div 100 AS gr", "o_orderkey % 100 AS gc"
    )
    return grid.selectExpr(
        "k",
        "gr",
        "gc",
        "IF(gc < 34, 's0', concat('s', CAST(1 + gr div 50 AS STRING))) AS scene_id",
        "CAST(IF(gc < 34, gr, gr % 50) AS INT) AS row",
        "CAST(IF(gc < 34, gc, gc - 34) AS INT) AS col",
    )


# Each layer as one integer expression that Spark and DuckDB both read the same way;
# DIV stands for integer division.
LAYERS = {
    "x": f"CAST({MINX} AS DOUBLE) + (CAST(col AS DOUBLE) + 0.5) * {RESOLUTION_M}",
    "y": f"CAST({MAXY} AS DOUBLE) - (CAST(row AS DOUBLE) + 0.5) * {RESOLUTION_M}",
    "ghi_annual": "CASE WHEN k % 97 = 0 THEN NULL ELSE CAST(1200 + 100 * ((gr DIV 7 + gc DIV 9) % 12) AS DOUBLE) END",
    "elevation": "CASE WHEN k % 197 = 0 THEN NULL ELSE CAST((gr * gr + 3 * gc * (gr % 5)) % 400 AS DOUBLE) END",
    "slope": "CASE WHEN k % 89 = 0 THEN NULL ELSE CAST(((gr DIV 5) * 3 + (gc DIV 4) * 7) % 26 AS DOUBLE) END",
    "aspect_class": "CAST((gr DIV 3 + gc DIV 3) % 9 AS INTEGER)",
    "temperature": "CASE WHEN k % 101 = 0 THEN NULL ELSE CAST(12 + (gr DIV 8 + gc DIV 6) % 30 AS DOUBLE) END",
    "humidity": "CAST(15 + ((gr DIV 6) * 5 + (gc DIV 5) * 3) % 75 AS DOUBLE)",
    "wind_speed": "CAST(2 + (gr DIV 4 + gc DIV 7) % 22 AS DOUBLE) / 2",
    "shadow": "CAST((gr DIV 5 + gc DIV 5) % 9 AS DOUBLE) / 20",
    "lulc": "CAST(element_at(ARRAY_LULC, CAST((gr DIV 6 + gc DIV 8) % 11 AS INTEGER) + 1) AS INTEGER)",
    "land_capability": "CASE WHEN k % 103 = 0 THEN NULL ELSE element_at(ARRAY_CAP, CAST((gr DIV 9 + gc DIV 9) % 8 AS INTEGER) + 1) END",
    "dist_power": "CAST(((gr DIV 2) * 3 + (gc DIV 3) * 5) % 120 AS DOUBLE) * 500",
    "dist_roads": "CAST(((gr DIV 3) * 2 + gc DIV 4) % 100 AS DOUBLE) * 100",
    "dist_railway": "CAST((gr DIV 4 + (gc DIV 3) * 3) % 110 AS DOUBLE) * 500",
    "dist_urban": "CAST(((gr DIV 5) * 2 + (gc DIV 2) * 2) % 90 AS DOUBLE) * 600",
    "protected": "(gr DIV 10 + gc DIV 10) % 17 = 0",
}


def _spark_text(expression: str) -> str:
    lulc = "array(" + ",".join(map(str, LAND_COVER)) + ")"
    cap = "array(" + ",".join(f"'{c}'" for c in CAPABILITY) + ")"
    return expression.replace("ARRAY_LULC", lulc).replace("ARRAY_CAP", cap)


def duck_text(expression: str) -> str:
    lulc = "[" + ",".join(map(str, LAND_COVER)) + "]"
    cap = "[" + ",".join(f"'{c}'" for c in CAPABILITY) + "]"
    return expression.replace("ARRAY_LULC", lulc).replace("ARRAY_CAP", cap).replace(" DIV ", " // ").replace("element_at(", "list_extract(")


def cells(spark: SparkSession, sf_dir: str, *layers: str) -> DataFrame:
    """Cells with the asked layers (all by default)."""
    names = layers or tuple(LAYERS)
    base = base_cells(spark, sf_dir)
    return base.selectExpr("scene_id", "row", "col", *(f"{_spark_text(LAYERS[n])} AS {n}" for n in names))


def cells_sql(*layers: str, keep_base: bool = False) -> str:
    """The same as CTEs ``base`` and ``cells`` (to follow WITH)."""
    names = layers or tuple(LAYERS)
    extra = ", k, gr, gc" if keep_base else ""
    columns = ",\n    ".join(f"{duck_text(LAYERS[n])} AS {n}" for n in names)
    return f"{BASE_SQL},\ncells AS (\n  SELECT scene_id, row, col{extra},\n    {columns}\n  FROM base\n)"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid row per scene, from the extent of its cells."""
    return (
        base_cells(spark, sf_dir)
        .groupBy("scene_id")
        .agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))
        .select(
            "scene_id",
            F.lit(MINX).alias("minx"),
            (F.lit(MAXY) - F.col("height") * float(RESOLUTION_M)).alias("miny"),
            (F.lit(MINX) + F.col("width") * float(RESOLUTION_M)).alias("maxx"),
            F.lit(MAXY).alias("maxy"),
            F.lit(RESOLUTION_M).alias("resolution_m"),
            F.lit(EPSG).alias("epsg"),
            "width",
            "height",
        )
    )


def feature_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse features: (scene_id, row, col, kind)."""
    mark = F.col("k") % 997
    kind = F.when(mark == MARKS[0], F.lit(KINDS[0]))
    for m, name in zip(MARKS[1:], KINDS[1:], strict=True):
        kind = kind.when(mark == m, F.lit(name))
    return base_cells(spark, sf_dir).withColumn("kind", kind).filter("kind IS NOT NULL").select("scene_id", "row", "col", "kind")


FEATURES_SQL = "feats AS (SELECT scene_id, row, col, CASE k % 997 " + " ".join(
    f"WHEN {m} THEN '{n}'" for m, n in zip(MARKS, KINDS, strict=True)
) + f" END AS kind FROM base WHERE k % 997 IN ({', '.join(map(str, MARKS))}))"


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather of five stations from the event stream."""
    hourly = (
        table(spark, sf_dir, "events")
        .groupBy((F.col("user_id") % 5).alias("site_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(F.avg("value").alias("v"))
    )
    return hourly.select(
        "site_id",
        "ts",
        F.col("v").alias("ghi"),
        (F.col("v") * 0.85).alias("dni"),
        (F.col("v") * 0.15).alias("dhi"),
        (F.col("v") / 100.0 + 20.0).alias("temp_air"),
        F.lit(4.0).alias("wind_speed"),
        (F.col("site_id") * 20.0 - 40.0).alias("lat"),
        (F.col("site_id") * 10.0).alias("lon"),
    )


WEATHER_SQL = """
weather AS (
  SELECT site_id, ts, v AS ghi, v * 0.85::DOUBLE AS dni, v * 0.15::DOUBLE AS dhi,
    v / 100.0::DOUBLE + 20.0::DOUBLE AS temp_air, 4.0::DOUBLE AS wind_speed,
    site_id * 20.0::DOUBLE - 40.0::DOUBLE AS lat, site_id * 10.0::DOUBLE AS lon
  FROM (SELECT user_id % 5 AS site_id, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY 1, 2)
)"""


def roofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rooftop portfolio from customers; optional inputs are missing on different moduli."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS roof_id",
        "CAST(CASE WHEN c_custkey % 211 = 0 THEN 150000 WHEN c_custkey % 53 = 0 THEN 3000 ELSE 20 + c_custkey % 180 END AS DOUBLE) AS area_m2",
        "CAST(0.75 AS DOUBLE) AS usable_fraction",
        "CAST(CASE WHEN c_custkey % 97 = 0 THEN 0.30 ELSE 0.20 END AS DOUBLE) AS module_efficiency",
        "CAST(900 + c_custkey % 1200 AS DOUBLE) AS specific_yield",
        "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(2000 + c_custkey % 7000 AS DOUBLE) END AS annual_kwh",
        "CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey % 10 AS DOUBLE) / 10D END AS self_consumption_fraction",
        "element_at(array('net_metering', 'self_consumption', 'no_export', NULL), CAST(c_custkey % 4 AS INT) + 1) AS dispatch_policy",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'flat' WHEN 'MACHINERY' THEN 'daytime' WHEN 'HOUSEHOLD' THEN 'evening' "
        "WHEN 'FURNITURE' THEN 'unknown' END AS load_profile",
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(100 + c_custkey % 300 AS DOUBLE) / 100D END AS install_cost_usd_per_w",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(8 + c_custkey % 30 AS DOUBLE) / 100D END AS retail_tariff",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 8 AS DOUBLE) / 100D END AS export_rate",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 2000 AS DOUBLE) END AS incentive_usd",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(10 + c_custkey % 15 AS DOUBLE) END AS om_usd_per_kw_yr",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(100 + c_custkey % 700 AS DOUBLE) END AS grid_co2_g_per_kwh",
        "CAST(0.05 AS DOUBLE) AS discount_rate",
        "CAST(10 + c_custkey % 16 AS INT) AS analysis_years",
        "CAST(0.005 AS DOUBLE) AS degradation_per_yr",
        "c_custkey % 5 AS site_id",
    )


ROOFS_SQL = """
roofs AS (
  SELECT c_custkey AS roof_id,
    CAST(CASE WHEN c_custkey % 211 = 0 THEN 150000 WHEN c_custkey % 53 = 0 THEN 3000 ELSE 20 + c_custkey % 180 END AS DOUBLE) AS area_m2,
    CAST(0.75 AS DOUBLE) AS usable_fraction,
    CAST(CASE WHEN c_custkey % 97 = 0 THEN 0.30 ELSE 0.20 END AS DOUBLE) AS module_efficiency,
    CAST(900 + c_custkey % 1200 AS DOUBLE) AS specific_yield,
    CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(2000 + c_custkey % 7000 AS DOUBLE) END AS annual_kwh,
    CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey % 10 AS DOUBLE) / 10.0::DOUBLE END AS self_consumption_fraction,
    (['net_metering', 'self_consumption', 'no_export', NULL])[CAST(c_custkey % 4 AS INTEGER) + 1] AS dispatch_policy,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'flat' WHEN 'MACHINERY' THEN 'daytime' WHEN 'HOUSEHOLD' THEN 'evening' WHEN 'FURNITURE' THEN 'unknown' END AS load_profile,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(100 + c_custkey % 300 AS DOUBLE) / 100.0::DOUBLE END AS install_cost_usd_per_w,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(8 + c_custkey % 30 AS DOUBLE) / 100.0::DOUBLE END AS retail_tariff,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 8 AS DOUBLE) / 100.0::DOUBLE END AS export_rate,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 2000 AS DOUBLE) END AS incentive_usd,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(10 + c_custkey % 15 AS DOUBLE) END AS om_usd_per_kw_yr,
    CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(100 + c_custkey % 700 AS DOUBLE) END AS grid_co2_g_per_kwh,
    CAST(0.05 AS DOUBLE) AS discount_rate,
    CAST(10 + c_custkey % 16 AS INTEGER) AS analysis_years,
    CAST(0.005 AS DOUBLE) AS degradation_per_yr,
    c_custkey % 5 AS site_id
  FROM customer
)"""
