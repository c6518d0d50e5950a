"""Irradiation and energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.functions import finance
from terralux.functions.geodesy import effective_azimuth, effective_tilt
from terralux.functions.losses import dc_derate, loss_items
from terralux.functions.solar import with_ac_power, with_sun

# Column names of raw hourly weather, fallback irradiation, tilt sweep.
WEATHER_NAMES = {"G(h)": "ghi", "Gb(n)": "dni", "Gd(h)": "dhi", "T2m": "temp_air", "WS10m": "wind_speed"}
WEATHER_COLUMNS = ("ghi", "dni", "dhi", "temp_air", "wind_speed")
FALLBACK_GHI = 2000.0
TILT_SWEEP = (0, 60, 5)
ROUNDING = {"kwh_per_kwp_yr": 1, "gwh_per_yr": 3, "lcoe": 5, "capacity_mwp": 2}


def prepare_weather(df: DataFrame) -> DataFrame:
    """Raw names become standard ones; a missing column is an error."""
    renamed = df.withColumnsRenamed({k: v for k, v in WEATHER_NAMES.items() if k in df.columns})
    missing = [c for c in WEATHER_COLUMNS if c not in renamed.columns]
    if missing:
        raise ValueError(f"weather columns missing: {missing}")
    return renamed


def annual_irradiation(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """A1: mean over years of the yearly sums."""
    yearly = monthly.groupBy(*keys, "year").agg(F.sum("ghi").alias("ghi"))
    return yearly.groupBy(*keys).agg(F.avg("ghi").alias("ghi_annual"), F.count("*").alias("years"))


def monthly_normals(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """A2: long-term mean per calendar month."""
    return monthly.groupBy(*keys, "month").agg(F.avg("ghi").alias("ghi"))


def normals_on_cells(cells: DataFrame, normals: DataFrame) -> DataFrame:
    """A2 on the grid: twelve values per scene carried by one array, unfolded per cell.

    A cell of a scene without normals keeps one row with a NULL month.
    """
    by_month = normals.groupBy("scene_id").agg(
        F.array_sort(F.collect_list(F.struct("month", "ghi"))).alias("normals")
    )
    return cells.join(by_month, "scene_id", "left").select("scene_id", "row", "col", F.inline_outer("normals"))


def annual_means(hourly: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A3: means of the non-missing values and how many there were (0 marks an all-missing series)."""
    return hourly.groupBy(*keys).agg(
        *(F.avg(c).alias(c) for c in columns), *(F.count(c).alias(f"n_{c}") for c in columns)
    )


def hourly_power(weather: DataFrame, inverter_efficiency: float = 0.96) -> DataFrame:
    """P19 with C23: adds tilt, azimuth (defaults from latitude) and ac_w."""
    prepared = prepare_weather(weather)
    given = {c: F.col(c) if c in prepared.columns else F.lit(None).cast("double") for c in ("tilt", "azimuth")}
    shaped = prepared.withColumns(
        {
            "tilt": effective_tilt(given["tilt"], F.col("lat")),
            "azimuth": effective_azimuth(given["azimuth"], F.col("lat")),
        }
    )
    return with_ac_power(shaped, inverter_efficiency=inverter_efficiency)


def _kwh(derate: Column, power: Column | None = None) -> Column:
    """Hourly watts summed to derated kWh; the sum combines before the shuffle."""
    return F.sum(F.col("ac_w") if power is None else power) / 1000.0 * derate


def specific_yield(weather: DataFrame, keys: list[str], derate: Column | None = None) -> DataFrame:
    """A4: kWh per kWp and year."""
    kept = dc_derate(loss_items()) if derate is None else derate
    return hourly_power(weather).groupBy(*keys).agg(_kwh(kept).alias("specific_yield"))


def yield_profile(weather: DataFrame, keys: list[str], derate: Column | None = None) -> DataFrame:
    """A5: annual and twelve monthly values (m01..m12), all from one pass."""
    kept = dc_derate(loss_items()) if derate is None else derate
    powered = hourly_power(weather).withColumn("_m", F.month("ts"))
    months = {
        f"m{m:02d}": _kwh(kept, F.when(F.col("_m") == m, F.col("ac_w")).otherwise(F.lit(0.0))) for m in range(1, 13)
    }
    return powered.groupBy(*keys).agg(_kwh(kept).alias("specific_yield"), *(c.alias(n) for n, c in months.items()))


def diurnal_shape(weather: DataFrame, keys: list[str], utc_offset_h: int = 0) -> DataFrame:
    """Share of generation per hour of day as an array of 24; zeros for a dark year (T14 offset)."""
    hour = F.pmod(F.hour("ts") + F.lit(utc_offset_h), F.lit(24))
    powered = hourly_power(weather).withColumn("_h", hour)
    sums = powered.groupBy(*keys).agg(
        F.array(
            *(F.sum(F.when(F.col("_h") == h, F.col("ac_w")).otherwise(F.lit(0.0))) for h in range(24))
        ).alias("by_hour"),
        F.sum("ac_w").alias("total"),
    )
    share = F.transform(
        "by_hour", lambda w: F.when(F.col("total") > 0.0, w / F.col("total")).otherwise(F.lit(0.0))
    )
    return sums.select(*keys, share.alias("gen_shape"))


def best_tilt(weather: DataFrame, keys: list[str], derate: Column | None = None) -> DataFrame:
    """The lowest of the tilts 0..60 with the highest yield, equator-facing.

    The sun is computed once per hour, before the hour is taken at all thirteen tilts; their sums
    combine in the task, so that a key sends thirteen rows per task through the shuffle.
    """
    kept = dc_derate(loss_items()) if derate is None else derate
    lo, hi, step = TILT_SWEEP
    lit = with_sun(prepare_weather(weather.drop("tilt", "azimuth")))
    swept = lit.withColumns(
        {
            "tilt": F.explode(F.array(*(F.lit(float(t)) for t in range(lo, hi + 1, step)))),
            "azimuth": effective_azimuth(F.lit(None).cast("double"), F.col("lat")),
        }
    )
    yields = with_ac_power(swept, sun_known=True).groupBy(*keys, "tilt").agg(_kwh(kept).alias("y"))
    # Sums differ in the last bits between runs; equal yields are those equal to 9 decimals.
    best = F.min_by(F.struct("tilt", "y"), F.struct((-F.round("y", 9)).alias("y"), F.col("tilt").alias("t")))
    return yields.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.tilt").alias("optimal_tilt"), F.col("b.y").alias("optimal_yield")
    )


def site_energy(sites: DataFrame, yield_column: str = "specific_yield") -> DataFrame:
    """Capacity, yearly generation and cost of energy from area and yield."""
    capacity = F.col("area_km2") * finance.PACKING_MWP_PER_KM2
    return sites.withColumns(
        {
            "capacity_mwp": capacity,
            "annual_gwh": F.col(yield_column) * capacity / 1000.0,
            "lcoe_usd_per_mwh": finance.lcoe_usd_per_mwh(F.col(yield_column)),
        }
    )


def yield_from_ghi(ghi: Column) -> Column:
    """Offline estimate from annual irradiation; NULL where that is missing."""
    return F.when(ghi.isNotNull(), F.greatest(F.lit(0.0), ghi * finance.PERFORMANCE_RATIO))


def site_yields(sites: DataFrame, weather: DataFrame) -> DataFrame:
    """Each site with its scene's weather at the site's own position; one yield per site.

    Sites are the ranked few of a scene, so the join holds (sites x 8,760 hours) and the
    hours are reduced map-side.
    """
    places = sites.select(
        "scene_id", "site_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon")
    )
    hours = prepare_weather(weather).select("scene_id", "ts", *WEATHER_COLUMNS)
    return specific_yield(hours.join(places, "scene_id"), ["scene_id", "site_id"])


def site_irradiation(sites: DataFrame, cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Irradiation of the cell nearest to each centroid, else the scene mean, else 2,000.

    On a regular grid the nearest cell is arithmetic, so the lookup is an equi-join.
    """
    spec = grids.select("scene_id", "minx", "maxy", "resolution_m", "width", "height")

    def index(distance: Column, last: str) -> Column:
        cell = F.floor(distance / F.col("resolution_m")).cast("int")
        return F.greatest(F.lit(0), F.least(cell, F.col(last) - 1))

    placed = sites.join(spec, "scene_id").withColumns(
        {
            "row": index(F.col("maxy") - F.col("centroid_y"), "height"),
            "col": index(F.col("centroid_x") - F.col("minx"), "width"),
        }
    )
    mean = cells.groupBy("scene_id").agg(F.avg("ghi_annual").alias("_mean"))
    here = cells.select("scene_id", "row", "col", F.col("ghi_annual").alias("_ghi"))
    return (
        placed.join(here, ["scene_id", "row", "col"], "left")
        .join(mean, "scene_id", "left")
        .withColumn("ghi", F.coalesce("_ghi", "_mean", F.lit(FALLBACK_GHI)))
        .drop("row", "col", "_ghi", "_mean", "minx", "maxy", "resolution_m", "width", "height")
    )


def enrich_sites(sites: DataFrame, cells: DataFrame, grids: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Yield, generation, cost and capacity of each site, labelled by method and rounded."""
    located = site_irradiation(sites, cells, grids)
    if weather is None:
        modelled = located.withColumn("specific_yield", F.lit(None).cast("double"))
    else:
        modelled = located.join(site_yields(sites, weather), ["scene_id", "site_id"], "left")
    chosen = F.coalesce("specific_yield", yield_from_ghi(F.col("ghi")))
    method = F.when(F.col("specific_yield").isNotNull(), F.lit("pvlib_modelchain")).otherwise(F.lit("ghi_pr_offline"))
    priced = site_energy(modelled.withColumns({"energy_method": method, "_y": chosen}), "_y")
    d = ROUNDING
    return priced.withColumns(
        {
            "kwh_per_kwp_yr": F.round("_y", d["kwh_per_kwp_yr"]),
            "gwh_per_yr": F.round("annual_gwh", d["gwh_per_yr"]),
            "lcoe": F.round(F.col("lcoe_usd_per_mwh") / 1000.0, d["lcoe"]),
            "capacity_mwp": F.round("capacity_mwp", d["capacity_mwp"]),
        }
    ).drop("_y", "specific_yield", "annual_gwh", "lcoe_usd_per_mwh", "ghi")
