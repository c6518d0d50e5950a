"""Irradiation, energy, losses, rooftops, bounds and ranges."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from terralux.functions import finance, losses
from terralux.functions import solar as sp
from terralux.functions.units import wind_to_ms
from terralux.operators import energy, quality, rooftop, uncertainty
from terralux.operators.rooftop import LOAD_SHAPES
from terralux.plans.production import location_production, portfolio
from terralux.workloads.catalog import query
from terralux.workloads.inputs import ROOFS_SQL, WEATHER_SQL, roofs, table, weather
from terralux.workloads.inputs import cells, cells_sql

# ---- irradiation -----------------------------------------------------------------------

MONTHLY_SQL = """mon AS (SELECT l_suppkey % 7 AS loc, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, sum(l_extendedprice) AS ghi FROM lineitem GROUP BY 1, 2, 3)"""


def monthly(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_suppkey") % 7).alias("loc"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
        .agg(F.sum("l_extendedprice").alias("ghi"))
    )


@query("a1_annual_irradiation", f"WITH {MONTHLY_SQL} SELECT loc, round(avg(g), 5) AS ghi_annual, count(*) AS years FROM (SELECT loc, year, sum(ghi) AS g FROM mon GROUP BY 1, 2) GROUP BY 1")
def a1_annual_irradiation(spark, sf_dir):
    return energy.annual_irradiation(monthly(spark, sf_dir), ["loc"]).withColumn("ghi_annual", F.round("ghi_annual", 5))


@query("a2_monthly_normals", f"WITH {MONTHLY_SQL} SELECT loc, month, round(avg(ghi), 6) AS ghi FROM mon GROUP BY 1, 2")
def a2_monthly_normals(spark, sf_dir):
    return energy.monthly_normals(monthly(spark, sf_dir), ["loc"]).withColumn("ghi", F.round("ghi", 6))


@query(
    "a2_normals_on_cells",
    f"""WITH {cells_sql('slope')},{MONTHLY_SQL}, nm AS (SELECT 's' || loc AS scene_id, month, avg(ghi) AS ghi FROM mon GROUP BY 1, 2)
SELECT c.scene_id, n.month, count(*) AS cells, round(max(n.ghi), 6) AS ghi FROM cells c LEFT JOIN nm n USING (scene_id) GROUP BY 1, 2""",
)
def a2_normals_on_cells(spark, sf_dir):
    normals = energy.monthly_normals(monthly(spark, sf_dir), ["loc"]).withColumn("scene_id", F.concat(F.lit("s"), F.col("loc")))
    planes = energy.normals_on_cells(cells(spark, sf_dir, "slope"), normals)
    return planes.groupBy("scene_id", "month").agg(F.count("*").alias("cells"), F.round(F.max("ghi"), 6).alias("ghi"))


@query(
    "a3_annual_means",
    """SELECT user_id, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS value, count(CASE WHEN event_id % 5 <> 0 THEN value END) AS n_value FROM events GROUP BY 1""",
)
def a3_annual_means(spark, sf_dir):
    series = table(spark, sf_dir, "events").selectExpr("user_id", "IF(event_id % 5 <> 0, value, NULL) AS value")
    return energy.annual_means(series, ["user_id"], ["value"]).withColumn("value", F.round("value", 6))


@query(
    "p10_wind_units",
    """SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN value / 3.6 WHEN 1 THEN value / 3.6 WHEN 2 THEN value ELSE value / 3.6 END, 9) AS wind_speed FROM events""",
)
def p10_wind_units(spark, sf_dir):
    """km/h, KPH, m/s and a missing unit."""
    unit = F.element_at(F.array(F.lit("km/h"), F.lit("KPH"), F.lit("m/s"), F.lit(None)), (F.col("event_id") % 4).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", F.round(wind_to_ms(F.col("value"), unit), 9).alias("wind_speed"))


# ---- power -----------------------------------------------------------------------------

_N = "(epoch(ts)::DOUBLE / 86400.0 - 10957.5)"


def power_sql(source: str) -> str:
    """CTE ``power`` with ac_w, from a source with ts, lat, lon, tilt, azimuth and weather."""
    norm = math.exp(-0.008) * (1 - ((1.526 - 1) / (1.526 + 1)) ** 2)
    d = math.pi / 180
    return f"""
s1 AS (SELECT *, {_N} AS n, (epoch(ts)::DOUBLE % 86400.0) / 3600.0 AS h, {2 * math.pi / 365!r}::DOUBLE * (dayofyear(ts) - 1) AS bb, radians(tilt) AS beta, radians(azimuth) AS gam FROM {source}),
s2 AS (SELECT *, (357.528 + 0.9856003 * n) * {d!r}::DOUBLE AS gg, 280.460 + 0.9856474 * n AS ll, (23.439 - 4e-7 * n) * {d!r}::DOUBLE AS ee FROM s1),
s3 AS (SELECT *, (ll + 1.915 * sin(gg) + 0.020 * sin(2 * gg)) * {d!r}::DOUBLE AS lm FROM s2),
s4 AS (SELECT *, atan2(cos(ee) * sin(lm), cos(lm)) AS ra, asin(sin(ee) * sin(lm)) AS de, 6.697375 + 0.0657098242 * n + h AS st FROM s3),
s5 AS (SELECT *, ((st - 24 * floor(st / 24)) * 15 + lon) * {d!r}::DOUBLE - ra AS ha, radians(lat) AS phi FROM s4),
s6 AS (SELECT *, sin(phi) * sin(de) + cos(phi) * cos(de) * cos(ha) AS cz, atan2(-sin(ha) * cos(de), sin(de) * cos(phi) - cos(de) * sin(phi) * cos(ha)) AS az,
  1366.1 * (1.00011 + 0.034221 * cos(bb) + 0.00128 * sin(bb) + 0.000719 * cos(2 * bb) + 7.7e-5 * sin(2 * bb)) AS e0 FROM s5),
s7 AS (SELECT *, greatest(least(cz * cos(beta) + sqrt(greatest(1 - cz * cz, 0)) * sin(beta) * cos(az - gam), 1.0), -1.0) AS pj FROM s6),
s8 AS (SELECT *, dni * greatest(pj, 0) AS bm, greatest(pj, 0) / greatest(cz, 0.01745) AS rb, dni / e0 AS ai, sqrt(1 - (1 - pj * pj) / {1.526**2!r}::DOUBLE) AS rf FROM s7),
s9 AS (SELECT *, greatest(dhi * (ai * rb + (1 - ai) * (1 + cos(beta)) / 2), 0) + ghi * 0.25 * (1 - cos(beta)) / 2 AS sky,
  CASE WHEN pj > 0 THEN exp(-0.008 / rf) * (1 - (((pj - 1.526 * rf) / (pj + 1.526 * rf)) ** 2 + ((rf - 1.526 * pj) / (rf + 1.526 * pj)) ** 2) / 2) / {norm!r}::DOUBLE ELSE 0 END AS iam FROM s8),
s10 AS (SELECT *, (bm + sky) * exp(-3.47 - 0.0594 * wind_speed) + temp_air + (bm + sky) / 1000 * 3 AS tc FROM s9),
s11 AS (SELECT *, (bm * iam + sky) / 1000 * (1 - 0.004 * (tc - 25)) AS ze FROM s10),
power AS (SELECT *, CASE WHEN ze > 0 THEN greatest(least(0.96::DOUBLE / 0.9637 * (-0.0162 * ze * ze - 0.0059 + 0.9858 * ze) * 1000, 960.0), 0.0) ELSE 0.0 END AS ac_w FROM s11)"""


SHAPED_SQL = f"{WEATHER_SQL}, shaped AS (SELECT *, abs(lat) AS tilt, CASE WHEN lat >= 0 THEN 180.0 ELSE 0.0 END AS azimuth FROM weather),{power_sql('shaped')}"
DERATE = math.prod(1 - v / 100 for v in losses.DC_LOSSES_PCT.values())


@query("p18_weather_columns", f"WITH {WEATHER_SQL} SELECT site_id, count(*) AS hours, round(sum(ghi), 4) AS ghi, round(sum(temp_air), 4) AS temp_air FROM weather GROUP BY 1")
def p18_weather_columns(spark, sf_dir):
    """Raw column names are recognised and renamed."""
    raw = weather(spark, sf_dir).withColumnsRenamed({v: k for k, v in energy.WEATHER_NAMES.items()})
    ready = energy.prepare_weather(raw)
    return ready.groupBy("site_id").agg(
        F.count("*").alias("hours"), F.round(F.sum("ghi"), 4).alias("ghi"), F.round(F.sum("temp_air"), 4).alias("temp_air")
    )


@query("p19_sun_position", f"WITH {SHAPED_SQL} SELECT site_id, ts, round(cz, 8) AS cos_zenith, round(e0, 6) AS extra_radiation FROM power")
def p19_sun_position(spark, sf_dir):
    df = sp.with_sun(weather(spark, sf_dir))
    return df.select("site_id", "ts", F.round("cos_zenith", 8).alias("cos_zenith"), F.round("extra_radiation", 6).alias("extra_radiation"))


@query("p19_hourly_power", f"WITH {SHAPED_SQL} SELECT site_id, ts, round(ac_w, 5) AS ac_w FROM power")
def p19_hourly_power(spark, sf_dir):
    return energy.hourly_power(weather(spark, sf_dir)).select("site_id", "ts", F.round("ac_w", 5).alias("ac_w"))


@query("a4_specific_yield", f"WITH {SHAPED_SQL} SELECT site_id, round(sum(ac_w) / 1000 * {DERATE!r}::DOUBLE, 6) AS specific_yield FROM power GROUP BY 1")
def a4_specific_yield(spark, sf_dir):
    return energy.specific_yield(weather(spark, sf_dir), ["site_id"]).withColumn("specific_yield", F.round("specific_yield", 6))


_MONTHS = [f"m{m:02d}" for m in range(1, 13)]


@query(
    "a5_monthly_profile",
    f"WITH {SHAPED_SQL} SELECT site_id, round(sum(ac_w) / 1000 * {DERATE!r}::DOUBLE, 6) AS specific_yield, "
    + ", ".join(f"round(sum(CASE WHEN month(ts) = {i} THEN ac_w ELSE 0 END) / 1000 * {DERATE!r}::DOUBLE, 6) AS {m}" for i, m in enumerate(_MONTHS, 1))
    + " FROM power GROUP BY 1",
)
def a5_monthly_profile(spark, sf_dir):
    df = energy.yield_profile(weather(spark, sf_dir), ["site_id"])
    return df.select("site_id", *(F.round(c, 6).alias(c) for c in ("specific_yield", *_MONTHS)))


@query(
    "a6_diurnal_shape",
    f"WITH {SHAPED_SQL}, t AS (SELECT site_id, CAST(hour(ts) AS INTEGER) AS hour, sum(ac_w) AS w FROM power GROUP BY 1, 2) SELECT site_id, hour, round(w / sum(w) OVER (PARTITION BY site_id), 8) AS share FROM t",
)
def a6_diurnal_shape(spark, sf_dir):
    shape = energy.diurnal_shape(weather(spark, sf_dir), ["site_id"])
    return shape.select("site_id", F.posexplode("gen_shape").alias("hour", "share")).withColumn("share", F.round("share", 8))


@query(
    "a6_diurnal_shape_local",
    f"WITH {SHAPED_SQL}, t AS (SELECT site_id, CAST((hour(ts) + 2) % 24 AS INTEGER) AS hour, sum(ac_w) AS w FROM power GROUP BY 1, 2) SELECT site_id, hour, round(w / sum(w) OVER (PARTITION BY site_id), 8) AS share FROM t",
)
def a6_diurnal_shape_local(spark, sf_dir):
    """The same in local time, two hours ahead."""
    shape = energy.diurnal_shape(weather(spark, sf_dir), ["site_id"], utc_offset_h=2)
    return shape.select("site_id", F.posexplode("gen_shape").alias("hour", "share")).withColumn("share", F.round("share", 8))


@query(
    "w5_best_tilt",
    f"""WITH {WEATHER_SQL}, shaped AS (SELECT *, unnest(range(0, 61, 5))::DOUBLE AS tilt, CASE WHEN lat >= 0 THEN 180.0 ELSE 0.0 END AS azimuth FROM weather),{power_sql('shaped')},
y AS (SELECT site_id, tilt, round(sum(ac_w) / 1000 * {DERATE!r}::DOUBLE, 9) AS y FROM power GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY y DESC, tilt) AS k FROM y)
SELECT site_id, tilt AS optimal_tilt, round(y, 6) AS optimal_yield FROM r WHERE k = 1""",
)
def w5_best_tilt(spark, sf_dir):
    return energy.best_tilt(weather(spark, sf_dir), ["site_id"]).withColumn("optimal_yield", F.round("optimal_yield", 6))


@query(
    "p20_loss_stack",
    """SELECT c_custkey AS id, round(1 - 0.98 * (1 - coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 20 AS DOUBLE) END, 3) / 100) * 0.98 * 0.98 * 0.995 * 0.985 * 0.99 * 0.97, 9) AS dc_loss,
  round(0.96 * (0.98 * (1 - coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 20 AS DOUBLE) END, 3) / 100) * 0.98 * 0.98 * 0.995 * 0.985 * 0.99 * 0.97), 9) AS total_derate FROM customer""",
)
def p20_loss_stack(spark, sf_dir):
    """The default stack with an optional shading override per roof."""
    shading = F.expr("IF(c_custkey % 3 <> 0, CAST(c_custkey % 20 AS DOUBLE), NULL)")
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), losses.loss_items(shading=shading).alias("items"))
    return df.select(
        "id", F.round(losses.dc_loss_fraction(F.col("items")), 9).alias("dc_loss"), F.round(losses.total_derate(F.col("items")), 9).alias("total_derate")
    )


_LOSS_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS name, {v!r}::DOUBLE AS pct" for n, v in losses.DC_LOSSES_PCT.items()
)


@query(
    "p20_loss_line_items",
    f"WITH d AS ({_LOSS_ROWS}) SELECT name, round(sum(CASE WHEN name = 'shading' THEN CAST(c_custkey % 20 AS DOUBLE) ELSE pct END), 6) AS total_pct FROM customer, d GROUP BY 1",
)
def p20_loss_line_items(spark, sf_dir):
    items = losses.loss_items(shading=(F.col("c_custkey") % 20).cast("double"))
    return table(spark, sf_dir, "customer").select(F.inline(items)).groupBy("name").agg(F.round(F.sum("pct"), 6).alias("total_pct"))


@query(
    "p21_loss_faults",
    """SELECT id, fault FROM (SELECT c_custkey AS id, unnest([CASE WHEN c_custkey % 130 > 100 THEN 'soiling' END, CASE WHEN c_custkey % 9 < 1 THEN 'snow' END, CASE WHEN c_custkey % 30 < 10 THEN 'inverter_nominal_efficiency' END]) AS fault FROM customer) WHERE fault IS NOT NULL""",
)
def p21_loss_faults(spark, sf_dir):
    items = losses.loss_items(
        soiling=(F.col("c_custkey") % 130).cast("double"), snow=F.expr("IF(c_custkey % 9 < 1, -1.0D, 1.0D)")
    )
    inverter = F.expr("CAST(70 + c_custkey % 30 AS DOUBLE) / 100D")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(losses.loss_faults(items, inverter)).alias("fault"))


_LCOE_TOP = "(1000 * (0.07 * power(1.07, 25) / (power(1.07, 25) - 1)) + 17)"


@query(
    "p22_site_energy",
    f"SELECT p_partkey AS id, round(area * 45, 6) AS capacity_mwp, round(y * (area * 45) / 1000, 6) AS annual_gwh, round({_LCOE_TOP} / nullif(y, 0) * 1000, 6) AS lcoe_usd_per_mwh "
    "FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 2 AS area, CASE WHEN p_partkey % 50 = 0 THEN 0.0 ELSE p_retailprice END AS y FROM part)",
)
def p22_site_energy(spark, sf_dir):
    sites = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "CAST(p_size AS DOUBLE) / 2 AS area_km2", "IF(p_partkey % 50 = 0, 0.0D, p_retailprice) AS specific_yield"
    )
    df = energy.site_energy(sites)
    return df.select("id", *(F.round(c, 6).alias(c) for c in ("capacity_mwp", "annual_gwh", "lcoe_usd_per_mwh")))


@query(
    "p22_capital_recovery",
    "SELECT p_partkey AS id, round(r * power(1 + r, n) / (power(1 + r, n) - 1), 9) AS crf FROM (SELECT p_partkey, CAST(1 + p_partkey % 15 AS DOUBLE) / 100 AS r, 5 + p_partkey % 30 AS n FROM part)",
)
def p22_capital_recovery(spark, sf_dir):
    crf = finance.capital_recovery_factor(F.expr("CAST(1 + p_partkey % 15 AS DOUBLE) / 100"), F.expr("5 + p_partkey % 30"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(crf, 9).alias("crf"))


@query(
    "p23_offline_energy",
    f"""WITH {cells_sql('ghi_annual')} SELECT scene_id, row, col, round(y, 6) AS specific_yield, round({_LCOE_TOP} / nullif(y, 0) * 1000, 6) AS lcoe
FROM (SELECT *, CASE WHEN ghi_annual IS NOT NULL THEN greatest(0, (ghi_annual - 1200) * 0.75) END AS y FROM cells)""",
)
def p23_offline_energy(spark, sf_dir):
    """Yield from irradiation; no cost where nothing is produced."""
    df = cells(spark, sf_dir, "ghi_annual")
    y = energy.yield_from_ghi(F.col("ghi_annual") - 1200.0)
    return df.select("scene_id", "row", "col", F.round(y, 6).alias("specific_yield"), F.round(finance.lcoe_usd_per_mwh(y), 6).alias("lcoe"))


# ---- sites with energy -----------------------------------------------------------------

# Stand-in sites: one per part, in scene s0, centroids inside and outside the grid.
STUB_SQL = """stub AS (SELECT 's0' AS scene_id, p_partkey AS site_id, 299000.0 + (p_partkey * 331 % 20000) AS cx, 3501000.0 - (p_partkey * 617 % 80000) AS cy, CAST(1 + p_size AS DOUBLE) AS area_km2 FROM part)"""


def stub_sites(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "'s0' AS scene_id", "p_partkey AS site_id", "299000.0D + (p_partkey * 331 % 20000) AS centroid_x",
        "3501000.0D - (p_partkey * 617 % 80000) AS centroid_y", "CAST(1 + p_size AS DOUBLE) AS area_km2",
        "CAST(p_partkey % 60 AS DOUBLE) - 30 AS centroid_lat", "CAST(p_partkey % 90 AS DOUBLE) AS centroid_lon",
    )


NEAR_SQL = """ext AS (SELECT scene_id, max(row) AS h, max(col) AS w, avg(ghi_annual) AS g FROM cells GROUP BY 1),
near AS (SELECT s.*, coalesce(c.ghi_annual, e.g, 2000) AS ghi FROM stub s JOIN ext e USING (scene_id) LEFT JOIN cells c ON c.scene_id = s.scene_id
  AND c.col = greatest(0, least(CAST(floor((cx - 300000) / 500) AS INTEGER), e.w)) AND c.row = greatest(0, least(CAST(floor((3500000 - cy) / 500) AS INTEGER), e.h)))"""


@query("j11_a14_site_irradiation", f"WITH {cells_sql('ghi_annual')}, {STUB_SQL}, {NEAR_SQL} SELECT scene_id, site_id, round(ghi, 6) AS ghi FROM near")
def j11_a14_site_irradiation(spark, sf_dir):
    from terralux.workloads.inputs import grids

    df = energy.site_irradiation(stub_sites(spark, sf_dir), cells(spark, sf_dir, "ghi_annual"), grids(spark, sf_dir))
    return df.select("scene_id", "site_id", F.round("ghi", 6).alias("ghi"))


_YEAR_SQL = f"{WEATHER_SQL}, wx AS (SELECT 's' || site_id AS scene_id, ts, ghi, dni, dhi, temp_air, wind_speed FROM weather)"
_FEW_SQL = "few AS (SELECT 's' || (s_suppkey % 5) AS scene_id, s_suppkey AS site_id, CAST(s_suppkey % 60 AS DOUBLE) - 30 AS lat, CAST(s_suppkey % 90 AS DOUBLE) AS lon FROM supplier)"


@query(
    "j13_site_weather_yield",
    f"""WITH {_YEAR_SQL}, {_FEW_SQL}, shaped AS (SELECT f.site_id, f.lat, f.lon, wx.*, abs(f.lat) AS tilt, CASE WHEN f.lat >= 0 THEN 180.0 ELSE 0.0 END AS azimuth FROM few f JOIN wx USING (scene_id)),{power_sql('shaped')}
SELECT scene_id, site_id, round(sum(ac_w) / 1000 * {DERATE!r}::DOUBLE, 6) AS specific_yield FROM power GROUP BY 1, 2""",
)
def j13_site_weather_yield(spark, sf_dir):
    """Every site of a scene with the scene's weather, at its own position."""
    sites = table(spark, sf_dir, "supplier").selectExpr(
        "concat('s', s_suppkey % 5) AS scene_id", "s_suppkey AS site_id", "CAST(s_suppkey % 60 AS DOUBLE) - 30 AS centroid_lat", "CAST(s_suppkey % 90 AS DOUBLE) AS centroid_lon"
    )
    hours = weather(spark, sf_dir).withColumn("scene_id", F.concat(F.lit("s"), F.col("site_id"))).drop("site_id", "lat", "lon")
    return energy.site_yields(sites, hours).withColumn("specific_yield", F.round("specific_yield", 6))


@query(
    "p24_site_enrichment",
    f"""WITH {cells_sql('ghi_annual')}, {STUB_SQL}, {NEAR_SQL}, e AS (SELECT *, greatest(0, ghi * 0.75) AS y FROM near)
SELECT scene_id, site_id, round(y, 1) AS kwh_per_kwp_yr, round(y * (area_km2 * 45) / 1000, 3) AS gwh_per_yr, round({_LCOE_TOP} / y, 5) AS lcoe, round(area_km2 * 45, 2) AS capacity_mwp, 'ghi_pr_offline' AS energy_method FROM e""",
)
def p24_site_enrichment(spark, sf_dir):
    from terralux.workloads.inputs import grids

    df = energy.enrich_sites(stub_sites(spark, sf_dir), cells(spark, sf_dir, "ghi_annual"), grids(spark, sf_dir))
    return df.select("scene_id", "site_id", "kwh_per_kwp_yr", "gwh_per_yr", "lcoe", "capacity_mwp", "energy_method")


@query(
    "p24_weather_enrichment",
    f"""WITH {cells_sql('ghi_annual')}, stub AS (SELECT 's' || (s_suppkey % 6) AS scene_id, s_suppkey AS site_id, 299000.0 + (s_suppkey * 331 % 20000) AS cx, 3501000.0 - (s_suppkey * 617 % 80000) AS cy, CAST(1 + s_suppkey % 50 AS DOUBLE) AS area_km2 FROM supplier), {NEAR_SQL},
{_YEAR_SQL}, few AS (SELECT 's' || (s_suppkey % 6) AS scene_id, s_suppkey AS site_id, CAST(s_suppkey % 60 AS DOUBLE) - 30 AS lat, CAST(s_suppkey % 90 AS DOUBLE) AS lon FROM supplier),
shaped AS (SELECT f.site_id, f.lat, f.lon, wx.*, abs(f.lat) AS tilt, CASE WHEN f.lat >= 0 THEN 180.0 ELSE 0.0 END AS azimuth FROM few f JOIN wx USING (scene_id)),{power_sql('shaped')},
yl AS (SELECT scene_id, site_id, sum(ac_w) / 1000 * {DERATE!r}::DOUBLE AS modelled FROM power GROUP BY 1, 2),
e AS (SELECT near.*, modelled, coalesce(modelled, greatest(0, ghi * 0.75)) AS y FROM near LEFT JOIN yl USING (scene_id, site_id))
SELECT scene_id, site_id, round(y, 1) AS kwh_per_kwp_yr, round(y * (area_km2 * 45) / 1000, 3) AS gwh_per_yr, round({_LCOE_TOP} / y, 5) AS lcoe, CASE WHEN modelled IS NULL THEN 'ghi_pr_offline' ELSE 'pvlib_modelchain' END AS energy_method FROM e""",
)
def p24_weather_enrichment(spark, sf_dir):
    """Sites of five scenes with weather and of one without."""
    from terralux.workloads.inputs import grids

    sites = table(spark, sf_dir, "supplier").selectExpr(
        "concat('s', s_suppkey % 6) AS scene_id", "s_suppkey AS site_id", "299000.0D + (s_suppkey * 331 % 20000) AS centroid_x", "3501000.0D - (s_suppkey * 617 % 80000) AS centroid_y",
        "CAST(1 + s_suppkey % 50 AS DOUBLE) AS area_km2", "CAST(s_suppkey % 60 AS DOUBLE) - 30 AS centroid_lat", "CAST(s_suppkey % 90 AS DOUBLE) AS centroid_lon",
    )
    hours = weather(spark, sf_dir).withColumn("scene_id", F.concat(F.lit("s"), F.col("site_id"))).drop("site_id", "lat", "lon")
    df = energy.enrich_sites(sites, cells(spark, sf_dir, "ghi_annual"), grids(spark, sf_dir), hours)
    return df.select("scene_id", "site_id", "kwh_per_kwp_yr", "gwh_per_yr", "lcoe", "energy_method")


# ---- rooftops --------------------------------------------------------------------------


def _norm(shape):
    return "[" + ", ".join(f"{v / sum(shape)!r}::DOUBLE" for v in shape) + "]"


LOADS_SQL = f"CASE load_profile WHEN 'flat' THEN {_norm(LOAD_SHAPES['flat'])} WHEN 'daytime' THEN {_norm(LOAD_SHAPES['daytime'])} ELSE {_norm(LOAD_SHAPES['evening'])} END"
# A generation shape for roofs whose key is no multiple of five: the archetype of a day, shifted.
GEN_SQL = f"CASE WHEN roof_id % 5 <> 0 THEN {_norm(LOAD_SHAPES['daytime'])} END"
BALANCE_SQL = f"""{ROOFS_SQL},
b0 AS (SELECT *, area_m2 * usable_fraction * module_efficiency AS cap, area_m2 * usable_fraction * module_efficiency * specific_yield AS gen, coalesce(annual_kwh, 0) AS use,
  coalesce(dispatch_policy, 'net_metering') AS pol, coalesce(load_profile, 'evening') AS prof, {GEN_SQL} AS gs, {LOADS_SQL} AS ls FROM roofs),
b1 AS (SELECT *, list_sum(list_transform(range(1, 25), lambda i: least(gs[i] * (gen / 365), ls[i] * (use / 365)))) * 365 AS matched,
  (pol = 'net_metering' OR gs IS NULL OR use <= 0) AS annual FROM b0),
b2 AS (SELECT *, CASE WHEN self_consumption_fraction IS NOT NULL THEN CASE WHEN use = 0 THEN 0 ELSE least(gen * self_consumption_fraction, use) END WHEN annual THEN least(gen, use) ELSE matched END AS own FROM b1),
bal AS (SELECT *, CASE WHEN self_consumption_fraction IS NOT NULL THEN greatest(0, gen - own) WHEN NOT annual AND pol = 'no_export' THEN 0 ELSE gen - own END AS exported,
  CASE WHEN self_consumption_fraction IS NOT NULL THEN greatest(0, use - own) ELSE use - own END AS imported,
  CASE WHEN self_consumption_fraction IS NOT NULL THEN 'instantaneous_self_consumption' WHEN pol = 'net_metering' THEN 'annual_net_metering' WHEN gs IS NULL THEN pol || '_annual' ELSE pol || '_diurnal_' || prof END AS label FROM b2)"""


def shaped_roofs(spark, sf_dir):
    day = LOAD_SHAPES["daytime"]
    shape = F.array(*(F.lit(v / sum(day)) for v in day))
    return roofs(spark, sf_dir).withColumn("gen_shape", F.when(F.col("roof_id") % 5 != 0, shape))


@query(
    "p25_p26_roof_capacity",
    f"WITH {ROOFS_SQL} SELECT roof_id, round(area_m2 * usable_fraction * module_efficiency, 6) AS capacity_kwp, round(area_m2 * usable_fraction * module_efficiency * specific_yield, 4) AS production_kwh FROM roofs",
)
def p25_p26_roof_capacity(spark, sf_dir):
    capacity = rooftop.roof_capacity(F.col("area_m2"), F.col("usable_fraction"), F.col("module_efficiency"))
    return roofs(spark, sf_dir).select(
        "roof_id", F.round(capacity, 6).alias("capacity_kwp"), F.round(rooftop.annual_production(capacity, F.col("specific_yield")), 4).alias("production_kwh")
    )


@query(
    "p28_load_archetypes",
    f"WITH {ROOFS_SQL}, s AS (SELECT load_profile, {LOADS_SQL} AS ls FROM roofs) SELECT coalesce(load_profile, 'none') AS profile, count(*) AS roofs, round(max(ls[19]), 9) AS share_18h, round(max(list_sum(ls)), 9) AS total FROM s GROUP BY 1",
)
def p28_load_archetypes(spark, sf_dir):
    shape = rooftop.load_shape(F.col("load_profile"))
    df = roofs(spark, sf_dir).select(F.coalesce("load_profile", F.lit("none")).alias("profile"), shape.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, v: a + v)
    return df.groupBy("profile").agg(
        F.count("*").alias("roofs"), F.round(F.max(F.col("s")[18]), 9).alias("share_18h"), F.round(F.max(total), 9).alias("total")
    )


@query(
    "p27_p29_energy_balance",
    f"""WITH {BALANCE_SQL} SELECT roof_id, round(own, 6) + 0.0 AS self_consumed_kwh, round(exported, 6) + 0.0 AS exported_kwh, round(imported, 6) + 0.0 AS grid_import_kwh,
  round(CASE WHEN gen > 0 THEN own / gen ELSE 0 END, 6) AS self_consumption_ratio, round(CASE WHEN use > 0 THEN own / use ELSE 0 END, 6) AS self_sufficiency, label AS dispatch_label FROM bal""",
)
def p27_p29_energy_balance(spark, sf_dir):
    df = rooftop.energy_balance(shaped_roofs(spark, sf_dir))
    return df.select(
        "roof_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("self_consumed_kwh", "exported_kwh", "grid_import_kwh")),
        *(F.round(c, 6).alias(c) for c in ("self_consumption_ratio", "self_sufficiency")), "dispatch_label",
    )


ECON_SQL = f"""{BALANCE_SQL},
e0 AS (SELECT *, cap * 1000 * install_cost_usd_per_w - coalesce(incentive_usd, 0) AS net, own * retail_tariff + coalesce(exported * export_rate, 0) - coalesce(cap * om_usd_per_kw_yr, 0) AS sav FROM bal),
econ AS (SELECT *, net IS NOT NULL AND sav > 0 AS pays,
  list_sum(list_transform(range(1, analysis_years + 1), lambda t: sav * power(1 - degradation_per_yr, t - 1) / power(1 + discount_rate, t))) - net AS npv,
  list_sum(list_transform(range(1, analysis_years + 1), lambda t: sav * power(1 - degradation_per_yr, t - 1))) AS life FROM e0)"""


@query(
    "p30_w4_economics",
    f"""WITH {ECON_SQL} SELECT roof_id, round(cap * 1000 * install_cost_usd_per_w, 7) AS install_cost_usd, round(net, 7) AS net_install_cost_usd, round(sav, 7) AS annual_savings_usd,
  CASE WHEN pays THEN round(net / sav, 6) END AS simple_payback_years, CASE WHEN pays THEN round(npv, 5) END AS npv_usd, CASE WHEN pays THEN round(life, 5) END AS lifetime_savings_usd,
  concat_ws(',', CASE WHEN install_cost_usd_per_w IS NULL THEN 'install_cost_usd_per_w' END, CASE WHEN retail_tariff IS NULL THEN 'retail_tariff_usd_per_kwh' END, CASE WHEN export_rate IS NULL THEN 'export_rate_usd_per_kwh' END,
    CASE WHEN incentive_usd IS NULL THEN 'incentive_usd' END, CASE WHEN om_usd_per_kw_yr IS NULL THEN 'om_cost_usd_per_kw_yr' END) AS unverified FROM econ""",
)
def p30_w4_economics(spark, sf_dir):
    df = rooftop.economics(rooftop.energy_balance(shaped_roofs(spark, sf_dir)))
    return df.select(
        "roof_id", *(F.round(c, 7).alias(c) for c in ("install_cost_usd", "net_install_cost_usd", "annual_savings_usd")),
        F.round("simple_payback_years", 6).alias("simple_payback_years"), F.round("npv_usd", 5).alias("npv_usd"),
        F.round("lifetime_savings_usd", 5).alias("lifetime_savings_usd"), F.array_join("unverified_inputs", ",").alias("unverified"),
    )


@query(
    "p31_irr",
    f"""WITH RECURSIVE {ECON_SQL}, p AS (SELECT roof_id, net, sav, degradation_per_yr AS g, analysis_years AS n FROM econ WHERE pays),
f AS (SELECT *, -net + list_sum(list_transform(range(1, n + 1), lambda t: sav * power(1 - g, t - 1) / power(0.05, t))) AS f_lo, -net + list_sum(list_transform(range(1, n + 1), lambda t: sav * power(1 - g, t - 1) / power(3.0, t))) AS f_hi FROM p),
it AS (SELECT roof_id, net, sav, g, n, -0.95::DOUBLE AS lo, 2.0::DOUBLE AS hi, 0 AS i FROM f WHERE f_lo * f_hi <= 0
  UNION ALL SELECT roof_id, net, sav, g, n, CASE WHEN v > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN v > 0 THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, -net + list_sum(list_transform(range(1, n + 1), lambda t: sav * power(1 - g, t - 1) / power(1 + (lo + hi) / 2, t))) AS v FROM it WHERE i < 60))
SELECT e.roof_id, round((lo + hi) / 2 * 100, 4) AS irr_pct FROM econ e LEFT JOIN p ON p.roof_id = e.roof_id LEFT JOIN it ON it.roof_id = p.roof_id AND i = 60""",
)
def p31_irr(spark, sf_dir):
    df = rooftop.economics(rooftop.energy_balance(shaped_roofs(spark, sf_dir)))
    return df.select("roof_id", F.round("irr_pct", 4).alias("irr_pct"))


@query(
    "w3_cashflow",
    f"""WITH {ECON_SQL}, y AS (SELECT roof_id, net, sav, degradation_per_yr AS g, unnest(range(0, analysis_years + 1)) AS year FROM econ WHERE pays),
c AS (SELECT roof_id, CAST(year AS INTEGER) AS year, CASE WHEN year = 0 THEN -net ELSE sav * power(1 - g, year - 1) END AS cash FROM y)
SELECT roof_id, year, round(cash, 8) AS annual_cash_usd, round(sum(cash) OVER (PARTITION BY roof_id ORDER BY year), 8) AS cumulative_usd FROM c""",
)
def w3_cashflow(spark, sf_dir):
    df = rooftop.cashflow(rooftop.economics(rooftop.energy_balance(shaped_roofs(spark, sf_dir))), ["roof_id"])
    return df.select("roof_id", "year", F.round("annual_cash_usd", 8).alias("annual_cash_usd"), F.round("cumulative_usd", 8).alias("cumulative_usd"))


@query(
    "p32_co2_avoided",
    f"""WITH {BALANCE_SQL}, c AS (SELECT *, (own + exported) * grid_co2_g_per_kwh / 1000 AS kg FROM bal)
SELECT roof_id, round(kg, 8) AS co2_annual_kg, round(list_sum(list_transform(range(0, analysis_years), lambda t: kg * power(1 - degradation_per_yr, t))), 6) AS co2_lifetime_kg FROM c""",
)
def p32_co2_avoided(spark, sf_dir):
    df = rooftop.co2_avoided(rooftop.energy_balance(shaped_roofs(spark, sf_dir)))
    return df.select("roof_id", F.round("co2_annual_kg", 8).alias("co2_annual_kg"), F.round("co2_lifetime_kg", 6).alias("co2_lifetime_kg"))


@query(
    "p33_rooftop_analysis",
    f"""WITH {ECON_SQL} SELECT roof_id, label AS dispatch_label, CASE WHEN pays THEN round(least(net / sav, net / (sav * 0.96), net / (sav * 1.04)), 5) END AS payback_low,
  CASE WHEN pays THEN round(greatest(net / sav, net / (sav * 0.96), net / (sav * 1.04)), 5) END AS payback_high,
  CAST((cap > area_m2 * 0.25 + 1e-9)::INT + (specific_yield NOT BETWEEN 500 AND 2600)::INT + (specific_yield / 8760 NOT BETWEEN 0.02 AND 0.4)::INT + (module_efficiency NOT BETWEEN 0.05 AND 0.27)::INT
    + (area_m2 NOT BETWEEN 1 AND 100000)::INT + (cap NOT BETWEEN 0.05 AND 2000)::INT + coalesce((pays AND net / sav NOT BETWEEN 0.5 AND 60)::INT, 0) + coalesce((install_cost_usd_per_w NOT BETWEEN 0.7 AND 12)::INT, 0) AS INTEGER) AS broken,
  CAST((area_m2 > 2000)::INT + (cap > 100)::INT AS INTEGER) AS warnings FROM econ""",
)
def p33_rooftop_analysis(spark, sf_dir):
    """The whole rooftop chain; flags and band are compared, texts are checked in the tests."""
    df = rooftop.analyze_rooftops(shaped_roofs(spark, sf_dir))
    return df.select(
        "roof_id", "dispatch_label", F.round("payback_low", 5).alias("payback_low"), F.round("payback_high", 5).alias("payback_high"),
        F.size("sanity_messages").alias("broken"), F.size("size_warnings").alias("warnings"),
    )


# Yields, day shapes and months of the stations, and the roofs that stand at them; others keep the yield they came with.
LOCATED_SQL = f"""{SHAPED_SQL},
yl AS (SELECT site_id, sum(ac_w) / 1000 * {DERATE!r}::DOUBLE AS located FROM power GROUP BY 1),
hw AS (SELECT site_id, hour(ts) AS hr, sum(ac_w) AS w FROM power GROUP BY 1, 2), ht AS (SELECT site_id, sum(w) AS total FROM hw GROUP BY 1),
hs AS (SELECT g.site_id, list(CASE WHEN total > 0 THEN coalesce(w, 0) / total ELSE 0.0 END ORDER BY g.hr) AS gen_shape
  FROM (SELECT site_id, unnest(range(0, 24)) AS hr FROM ht) g LEFT JOIN hw USING (site_id, hr) JOIN ht ON ht.site_id = g.site_id GROUP BY 1),
mw AS (SELECT site_id, sum(CASE WHEN month(ts) = 1 THEN ac_w ELSE 0 END) / 1000 * {DERATE!r}::DOUBLE AS m01, sum(CASE WHEN month(ts) = 7 THEN ac_w ELSE 0 END) / 1000 * {DERATE!r}::DOUBLE AS m07 FROM power GROUP BY 1),
located_roofs AS (SELECT r.* EXCLUDE (specific_yield), coalesce(located, specific_yield) AS specific_yield, located, gen_shape, m01, m07
  FROM roofs r LEFT JOIN yl USING (site_id) LEFT JOIN hs USING (site_id) LEFT JOIN mw USING (site_id))"""
LOCATED_ECON_SQL = (
    ECON_SQL.replace(ROOFS_SQL, f"{ROOFS_SQL}, {LOCATED_SQL}").replace(f"{GEN_SQL} AS gs", "gen_shape AS gs").replace("AS ls FROM roofs)", "AS ls FROM located_roofs)")
)


@query(
    "p33_rooftop_portfolio_located",
    f"""WITH {LOCATED_ECON_SQL} SELECT roof_id, site_id, CASE WHEN located IS NOT NULL THEN 'pvlib_modelchain' WHEN specific_yield IS NOT NULL THEN 'caller_supplied' END AS production_method,
  round(cap, 4) AS capacity_kwp, round(gen, 2) AS production_kwh, CASE WHEN pays THEN round(npv, 2) END AS npv_usd, round(m01 * cap, 1) AS january_kwh, round(m07 * cap, 1) AS july_kwh,
  CAST((cap > area_m2 * 0.25 + 1e-9)::INT + (specific_yield NOT BETWEEN 500 AND 2600)::INT + (specific_yield / 8760 NOT BETWEEN 0.02 AND 0.4)::INT + (module_efficiency NOT BETWEEN 0.05 AND 0.27)::INT
    + (area_m2 NOT BETWEEN 1 AND 100000)::INT + (cap NOT BETWEEN 0.05 AND 2000)::INT + coalesce((pays AND net / sav NOT BETWEEN 0.5 AND 60)::INT, 0) + coalesce((install_cost_usd_per_w NOT BETWEEN 0.7 AND 12)::INT, 0) AS INTEGER) AS broken, 'battery and grid follow the policy ' || label AS policy_line,
  'values that the owner has yet to give: ' || nullif(concat_ws(', ', CASE WHEN install_cost_usd_per_w IS NULL THEN 'install_cost_usd_per_w' END, CASE WHEN retail_tariff IS NULL THEN 'retail_tariff_usd_per_kwh' END, CASE WHEN export_rate IS NULL THEN 'export_rate_usd_per_kwh' END,
    CASE WHEN incentive_usd IS NULL THEN 'incentive_usd' END, CASE WHEN om_usd_per_kw_yr IS NULL THEN 'om_cost_usd_per_kw_yr' END), '') AS missing_line FROM econ""",
)
def p33_rooftop_portfolio_located(spark, sf_dir):
    """The portfolio over modelled yields of five stations: yields, day shapes and months to economics, messages and ledger."""
    stats = weather(spark, sf_dir).groupBy("site_id").agg(F.avg("ghi").alias("e_y"), F.stddev("ghi").alias("sd_y"))
    made = location_production(weather(spark, sf_dir), ["site_id"], stats)
    df = portfolio(roofs(spark, sf_dir), made, ["site_id"])

    def line(start):
        return F.get(F.filter("assumptions", lambda text: text.startswith(start)), F.lit(0))

    return df.select(
        "roof_id", "site_id", "production_method", F.round("capacity_kwp", 4).alias("capacity_kwp"), F.round("production_kwh", 2).alias("production_kwh"),
        F.round("npv_usd", 2).alias("npv_usd"), F.get("monthly_kwh", F.lit(0)).alias("january_kwh"), F.get("monthly_kwh", F.lit(6)).alias("july_kwh"),
        F.size("sanity_messages").alias("broken"), line("battery").alias("policy_line"), line("values").alias("missing_line"),
    )


@query(
    "p35_interannual",
    """WITH s AS (SELECT user_id AS id, avg(value) - CASE WHEN user_id % 10 = 0 THEN 1e6 ELSE 0 END AS e, stddev_samp(value) AS sd FROM events GROUP BY user_id)
SELECT id, CASE WHEN e > 0 THEN round(sd / e, 8) END AS cv, CASE WHEN e > 0 THEN round(1500 * (1 - 1.2816 * (sd / e)), 5) END AS p90,
  CAST(CASE WHEN id % 361 - 180 > 180 THEN id % 361 - 540 ELSE id % 361 - 180 END AS DOUBLE) AS aspect FROM s""",
)
def p35_interannual(spark, sf_dir):
    shift = F.when(F.col("user_id") % 10 == 0, F.lit(1e6)).otherwise(F.lit(0.0))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("e"), F.stddev_samp("value").alias("sd"))
    cv = rooftop.interannual_cv(F.col("sd"), F.col("e") - shift)
    return s.select(
        F.col("user_id").alias("id"), F.round(cv, 8).alias("cv"), F.round(rooftop.p90(F.lit(1500.0), cv), 5).alias("p90"),
        rooftop.south_aspect((F.col("user_id") % 361).cast("double")).alias("aspect"),
    )


@query("p34_shading_override", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 20 AS DOUBLE) END, 3.0) AS shading_pct FROM customer")
def p34_shading_override(spark, sf_dir):
    given = F.expr("IF(c_custkey % 3 <> 0, CAST(c_custkey % 20 AS DOUBLE), NULL)")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), rooftop.effective_shading(given).alias("shading_pct"))


# ---- bounds ----------------------------------------------------------------------------

_METRICS_SQL = """m AS (SELECT c_custkey AS id, unnest(['specific_yield_kwh_kwp_yr', 'ac_capacity_factor', 'lcoe_usd_per_mwh', 'not_a_bound']) AS name,
  unnest([CAST(c_custkey % 3000 AS DOUBLE), CAST(c_custkey % 3000 AS DOUBLE) / 8760, CAST(c_custkey % 700 AS DOUBLE), 1.0]) AS value FROM customer)"""
_BOUNDS_SQL = "b(name, lo, hi, unit) AS (VALUES " + ", ".join(f"('{n}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, '{u}')" for n, (lo, hi, u, _) in quality.BOUNDS.items()) + ")"


def metrics(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        """inline(array(named_struct('name', 'specific_yield_kwh_kwp_yr', 'value', CAST(c_custkey % 3000 AS DOUBLE)),
             named_struct('name', 'ac_capacity_factor', 'value', CAST(c_custkey % 3000 AS DOUBLE) / 8760),
             named_struct('name', 'lcoe_usd_per_mwh', 'value', CAST(c_custkey % 700 AS DOUBLE)), named_struct('name', 'not_a_bound', 'value', 1.0D)))""",
    )


@query("p36_capacity_factor", "SELECT p_partkey AS id, round(p_retailprice / 8760, 9) AS cf FROM part")
def p36_capacity_factor(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(quality.capacity_factor(F.col("p_retailprice")), 9).alias("cf"))


@query(
    "p37_j14_bound_checks",
    f"""WITH {_METRICS_SQL}, {_BOUNDS_SQL} SELECT id, name, value BETWEEN lo AND hi AS ok, round(value, 9) AS value, lo, hi, unit FROM m JOIN b USING (name)""",
)
def p37_j14_bound_checks(spark, sf_dir):
    df = quality.check_many(metrics(spark, sf_dir), quality.bounds_table(spark))
    return df.select("id", "name", "ok", F.round("value", 9).alias("value"), "lo", "hi", "unit")


_TAILS_SQL = "tails(name, lo, hi, tail) AS (VALUES " + ", ".join(
    f"('{n}', {lo!r}::DOUBLE, {hi!r}::DOUBLE, ' {u} outside physical envelope [{lo:g}, {hi:g}] (source: {source})')" for n, (lo, hi, u, source) in quality.BOUNDS.items()
) + ")"


@query(
    "p37_bound_messages",
    f"""WITH {_METRICS_SQL}, {_TAILS_SQL} SELECT id, name, name || '=' || CASE WHEN value = 0 THEN '0' ELSE printf('%.4g', value) END || tail AS message
FROM m JOIN tails USING (name) WHERE value NOT BETWEEN lo AND hi""",
)
def p37_bound_messages(spark, sf_dir):
    df = quality.check_many(metrics(spark, sf_dir), quality.bounds_table(spark))
    return df.filter("NOT ok").select("id", "name", "message")


@query(
    "p38_assert_within",
    f"WITH {_METRICS_SQL}, {_BOUNDS_SQL} SELECT name, count(*) AS passed FROM m JOIN b USING (name) WHERE value BETWEEN lo AND hi GROUP BY 1",
)
def p38_assert_within(spark, sf_dir):
    """Good rows pass the assertion; that a bad row fails the job is tested separately."""
    good = quality.check_many(metrics(spark, sf_dir), quality.bounds_table(spark)).filter("ok")
    return quality.assert_within(good).groupBy("name").agg(F.count("*").alias("passed"))


@query(
    "p39_p40_roof_limits",
    f"""WITH {ROOFS_SQL} SELECT roof_id, area_m2 * usable_fraction * module_efficiency > area_m2 * 0.25 * (roof_id % 2) + 1e-9 AS over_ceiling,
  CAST((area_m2 > 2000)::INT + (area_m2 * usable_fraction * module_efficiency > 100)::INT AS INTEGER) AS warnings FROM roofs""",
)
def p39_p40_roof_limits(spark, sf_dir):
    """Even roofs are checked against no area at all, so both outcomes occur."""
    capacity = rooftop.roof_capacity(F.col("area_m2"), F.col("usable_fraction"), F.col("module_efficiency"))
    counted_area = F.col("area_m2") * (F.col("roof_id") % 2)
    return roofs(spark, sf_dir).select(
        "roof_id", quality.roof_ceiling_message(counted_area, capacity).isNotNull().alias("over_ceiling"),
        F.size(quality.size_warnings(F.col("area_m2"), capacity)).alias("warnings"),
    )


_SITE_SQL = """si AS (SELECT 's' || (p_partkey % 9) AS scene_id, CAST(p_partkey AS INTEGER) AS rank, CAST(p_partkey % 3000 AS DOUBLE) AS y, CAST(p_size % 7 AS DOUBLE) AS area, CAST(p_size % 7 AS DOUBLE) * (p_partkey % 130) AS cap, CAST(p_partkey % 800 AS DOUBLE) / 1000 AS lcoe FROM part),
mm AS (SELECT scene_id, rank, 'specific_yield_kwh_kwp_yr' AS name, y AS value FROM si UNION ALL SELECT scene_id, rank, 'ac_capacity_factor', y / 8760 FROM si
  UNION ALL SELECT scene_id, rank, 'power_density_mwp_per_km2', cap / area FROM si WHERE area > 0 AND cap > 0 UNION ALL SELECT scene_id, rank, 'lcoe_usd_per_mwh', lcoe * 1000 FROM si WHERE lcoe > 0)"""


def part_sites(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "concat('s', p_partkey % 9) AS scene_id", "CAST(p_partkey AS INT) AS rank", "CAST(p_partkey % 3000 AS DOUBLE) AS kwh_per_kwp_yr",
        "CAST(p_size % 7 AS DOUBLE) AS area_km2", "CAST(p_size % 7 AS DOUBLE) * (p_partkey % 130) AS capacity_mwp", "CAST(p_partkey % 800 AS DOUBLE) / 1000 AS lcoe",
    )


@query("p41_energy_checks", f"WITH {_SITE_SQL}, {_BOUNDS_SQL} SELECT name, count(*) AS checked, count(*) FILTER (WHERE value BETWEEN lo AND hi) AS ok FROM mm JOIN b USING (name) GROUP BY 1")
def p41_energy_checks(spark, sf_dir):
    sites = part_sites(spark, sf_dir)
    capacity = F.when(F.col("capacity_mwp") > 0, F.col("capacity_mwp"))
    lcoe = F.when(F.col("lcoe") > 0, F.col("lcoe") * 1000.0)
    long = quality.energy_metrics(sites, ["scene_id", "rank"], F.col("kwh_per_kwp_yr"), F.col("area_km2"), capacity, lcoe)
    return quality.check_many(long, quality.bounds_table(spark)).groupBy("name").agg(F.count("*").alias("checked"), F.count_if("ok").alias("ok"))


@query("p42_site_notes", f"WITH {_SITE_SQL}, {_BOUNDS_SQL} SELECT scene_id, rank, name FROM mm JOIN b USING (name) WHERE value NOT BETWEEN lo AND hi")
def p42_site_notes(spark, sf_dir):
    return quality.site_notes(part_sites(spark, sf_dir), quality.bounds_table(spark)).select("scene_id", "rank", "name")


@query(
    "p42_framing_note",
    f"""WITH {_SITE_SQL} SELECT scene_id, 'Candidate sites found: ' || count(*) || '; the largest covers about ' || CAST(round_even(max(area), 0) AS BIGINT) || ' km2. Each is a parcel of its own, kept under the 50 km2 cap where extraction splits larger areas, so rank them by figures per unit (specific yield, cost of energy) rather than by totals.' AS note FROM si GROUP BY 1""",
)
def p42_framing_note(spark, sf_dir):
    return quality.framing_note(part_sites(spark, sf_dir))


# ---- ranges ----------------------------------------------------------------------------

_CASES_SQL = """cs AS (SELECT c_custkey AS case_id, CAST(800 + c_custkey % 400 AS DOUBLE) AS cl, CAST(1000 + c_custkey % 400 AS DOUBLE) AS cb, CAST(1300 + c_custkey % 400 AS DOUBLE) AS ch,
  CAST(1200 + c_custkey % 300 AS DOUBLE) AS yl, CAST(1500 + c_custkey % 300 AS DOUBLE) AS yb, CAST(1700 + c_custkey % 300 AS DOUBLE) AS yh,
  CAST(10 + c_custkey % 5 AS DOUBLE) AS ol, CAST(17 + c_custkey % 5 AS DOUBLE) AS ob, CAST(30 + c_custkey % 5 AS DOUBLE) AS oh FROM customer)"""


def _cost(p):
    return (p["capex"] * 0.0858105 + p["opex"]) / p["yield"] * 1000.0


def _cost_sql(c, o, y):
    return f"(({c} * 0.0858105::DOUBLE + {o}) / {y} * 1000)"


def cases(spark, sf_dir):
    """Long inputs (case_id, name, low, base, high), widened per case."""
    long = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS case_id",
        """inline(array(
          named_struct('name', 'capex', 'low', CAST(800 + c_custkey % 400 AS DOUBLE), 'base', CAST(1000 + c_custkey % 400 AS DOUBLE), 'high', CAST(1300 + c_custkey % 400 AS DOUBLE)),
          named_struct('name', 'yield', 'low', CAST(1200 + c_custkey % 300 AS DOUBLE), 'base', CAST(1500 + c_custkey % 300 AS DOUBLE), 'high', CAST(1700 + c_custkey % 300 AS DOUBLE)),
          named_struct('name', 'opex', 'low', CAST(10 + c_custkey % 5 AS DOUBLE), 'base', CAST(17 + c_custkey % 5 AS DOUBLE), 'high', CAST(30 + c_custkey % 5 AS DOUBLE))))""",
    )
    return uncertainty.widen(long, ["capex", "opex", "yield"])


@query(
    "a15_j15_corner_band",
    f"WITH {_CASES_SQL}, k AS (SELECT *, unnest([cl, ch]) AS c FROM cs), k2 AS (SELECT *, unnest([ol, oh]) AS o FROM k), k3 AS (SELECT *, unnest([yl, yh]) AS y FROM k2) "
    f"SELECT case_id, round(min({_cost_sql('cb', 'ob', 'yb')}), 6) AS base, round(least(min({_cost_sql('c', 'o', 'y')}), min({_cost_sql('cb', 'ob', 'yb')})), 6) AS low, "
    f"round(greatest(max({_cost_sql('c', 'o', 'y')}), min({_cost_sql('cb', 'ob', 'yb')})), 6) AS high FROM k3 GROUP BY 1",
)
def a15_j15_corner_band(spark, sf_dir):
    df = uncertainty.propagate(cases(spark, sf_dir), _cost, ["capex", "opex", "yield"])
    return df.select("case_id", *(F.round(c, 6).alias(c) for c in ("base", "low", "high")))


@query(
    "w6_tornado",
    f"""WITH {_CASES_SQL}, r AS (SELECT case_id, 0 AS pos, 'capex' AS parameter, {_cost_sql('cl', 'ob', 'yb')} AS lo, {_cost_sql('ch', 'ob', 'yb')} AS hi FROM cs
  UNION ALL SELECT case_id, 1, 'opex', {_cost_sql('cb', 'ol', 'yb')}, {_cost_sql('cb', 'oh', 'yb')} FROM cs UNION ALL SELECT case_id, 2, 'yield', {_cost_sql('cb', 'ob', 'yl')}, {_cost_sql('cb', 'ob', 'yh')} FROM cs)
SELECT case_id, parameter, round(lo, 6) AS low_output, round(hi, 6) AS high_output, round(abs(hi - lo), 6) AS swing, CAST(row_number() OVER (PARTITION BY case_id ORDER BY abs(hi - lo) DESC, pos) AS INTEGER) AS position FROM r""",
)
def w6_tornado(spark, sf_dir):
    df = uncertainty.tornado(cases(spark, sf_dir), _cost, ["capex", "opex", "yield"])
    return df.select("case_id", "parameter", *(F.round(c, 6).alias(c) for c in ("low_output", "high_output", "swing")), "position")
