"""Location production for rooftops: yields per location joined to the portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralux.operators import energy, rooftop


def location_production(weather: DataFrame, keys: list[str], statistics: DataFrame | None = None) -> DataFrame:
    """Per location: yield, monthly profile, generation shape, best tilt, orientation ratio, P90.

    ``statistics`` (…keys, e_y, sd_y) supplies the year-to-year spread; without it P90 is NULL.
    """
    profile = energy.yield_profile(weather, keys)
    months = [f"m{m:02d}" for m in range(1, 13)]
    joined = (
        profile.withColumn("monthly_kwh_per_kwp", F.array(*months))
        .drop(*months)
        .join(energy.diurnal_shape(weather, keys), keys)
        .join(energy.best_tilt(weather, keys), keys)
    )
    if statistics is None:
        joined = joined.withColumn("cv", F.lit(None).cast("double"))
    else:
        spread = statistics.select(*keys, rooftop.interannual_cv(F.col("sd_y"), F.col("e_y")).alias("cv"))
        joined = joined.join(spread, keys, "left")
    return joined.withColumns(
        {
            "orientation_ratio": rooftop.orientation_ratio(F.col("specific_yield"), F.col("optimal_yield")),
            "p90_specific_yield": rooftop.p90(F.col("specific_yield"), F.col("cv")),
        }
    )


def portfolio(roofs: DataFrame, production: DataFrame | None, keys: list[str]) -> DataFrame:
    """P33 over a portfolio. A location's modelled yield wins over a supplied one; a roof with
    neither is returned with NULL results (``production_method`` is NULL)."""
    supplied = roofs.withColumnRenamed("specific_yield", "supplied_yield")
    if production is None:
        joined = supplied.withColumns(
            {"located": F.lit(None).cast("double"), "gen_shape": F.lit(None).cast("array<double>")}
        )
    else:
        located = production.select(
            *keys, F.col("specific_yield").alias("located"), "gen_shape", "monthly_kwh_per_kwp"
        )
        # One row per location: AQE broadcasts it when its measured size allows.
        joined = supplied.join(located, keys, "left")
    method = F.when(F.col("located").isNotNull(), F.lit("pvlib_modelchain")).when(
        F.col("supplied_yield").isNotNull(), F.lit("caller_supplied")
    )
    resolved = joined.withColumns(
        {"production_method": method, "specific_yield": F.coalesce("located", "supplied_yield")}
    ).drop("located", "supplied_yield")
    return rooftop.analyze_rooftops(resolved)
