"""Hourly output of a 1 kWp reference array, as one narrow chain of projections.

Published models: solar position (Michalsky 1988), plane-of-array transposition
(Hay and Davies), incidence modifier (De Soto 2006), cell temperature (King 2004),
DC and inverter (Dobos 2014). No join, no shuffle, no Python in the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Module, mounting, glass and inverter parameters of the reference array.
DC_RATING_W = 1000.0
TEMPERATURE_COEFFICIENT = -0.004
SAPM_A = -3.47
SAPM_B = -0.0594
SAPM_DELTA_T = 3.0
GLASS_INDEX = 1.526
GLASS_EXTINCTION = 4.0
GLASS_THICKNESS = 0.002
ALBEDO = 0.25
SOLAR_CONSTANT = 1366.1
MIN_COS_ZENITH = 0.01745
INVERTER_REFERENCE = 0.9637
INVERTER_CURVE = (-0.0162, -0.0059, 0.9858)

_J2000_UNIX_DAYS = 10957.5
_DEG = math.pi / 180.0


def with_sun(df: DataFrame, ts: str = "ts", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cosine of the zenith, azimuth (radians from north) and extraterrestrial irradiance."""
    seconds = F.unix_micros(F.col(ts)) / F.lit(1e6)
    keep = df.columns
    day_angle = F.lit(2.0 * math.pi / 365.0) * (F.dayofyear(ts) - 1)
    staged = (
        df.withColumns(
            {
                "_n": seconds / 86400.0 - _J2000_UNIX_DAYS,
                "_h": F.pmod(seconds, F.lit(86400.0)) / 3600.0,
                "_b": day_angle,
            }
        )
        .withColumns(
            {
                "_g": (357.528 + F.lit(0.9856003) * F.col("_n")) * _DEG,
                "_l": 280.460 + F.lit(0.9856474) * F.col("_n"),
                "_e": (23.439 - F.lit(4e-7) * F.col("_n")) * _DEG,
            }
        )
        .withColumn("_lm", (F.col("_l") + F.lit(1.915) * F.sin("_g") + F.lit(0.020) * F.sin(F.col("_g") * 2.0)) * _DEG)
        .withColumns(
            {
                "_ra": F.atan2(F.cos("_e") * F.sin("_lm"), F.cos("_lm")),
                "_dec": F.asin(F.sin("_e") * F.sin("_lm")),
            }
        )
        .withColumns(
            {
                "_ha": (
                    F.pmod(6.697375 + F.lit(0.0657098242) * F.col("_n") + F.col("_h"), F.lit(24.0)) * 15.0
                    + F.col(lon)
                )
                * _DEG
                - F.col("_ra"),
                "_phi": F.radians(lat),
            }
        )
        .withColumn(
            "cos_zenith",
            F.sin("_phi") * F.sin("_dec") + F.cos("_phi") * F.cos("_dec") * F.cos("_ha"),
        )
    )
    return staged.select(
        *keep,
        "cos_zenith",
        F.atan2(
            -F.sin("_ha") * F.cos("_dec"),
            F.sin("_dec") * F.cos("_phi") - F.cos("_dec") * F.sin("_phi") * F.cos("_ha"),
        ).alias("sun_azimuth"),
        (
            F.lit(SOLAR_CONSTANT)
            * (
                1.00011
                + F.lit(0.034221) * F.cos("_b")
                + F.lit(0.00128) * F.sin("_b")
                + F.lit(0.000719) * F.cos(F.col("_b") * 2.0)
                + F.lit(7.7e-5) * F.sin(F.col("_b") * 2.0)
            )
        ).alias("extra_radiation"),
    )


def _glass_transmittance(cos_in: Column, cos_out: Column) -> Column:
    """One air-glass surface with absorption, mean of both polarisations, from the two angles."""
    n = GLASS_INDEX
    perpendicular = ((cos_in - n * cos_out) / (cos_in + n * cos_out)) ** 2
    parallel = ((cos_out - n * cos_in) / (cos_out + n * cos_in)) ** 2
    return F.exp(F.lit(-GLASS_EXTINCTION * GLASS_THICKNESS) / cos_out) * (
        1.0 - (perpendicular + parallel) / 2.0
    )


_NORMAL_TRANSMITTANCE = math.exp(-GLASS_EXTINCTION * GLASS_THICKNESS) * (
    1.0 - ((GLASS_INDEX - 1.0) / (GLASS_INDEX + 1.0)) ** 2
)


def with_ac_power(
    df: DataFrame,
    tilt: str = "tilt",
    azimuth: str = "azimuth",
    ts: str = "ts",
    lat: str = "lat",
    lon: str = "lon",
    inverter_efficiency: float = 0.96,
    out: str = "ac_w",
    sun_known: bool = False,
) -> DataFrame:
    """Adds AC power in watts per kWp; negatives are clipped to 0.

    With ``sun_known`` the columns of :func:`with_sun` are there already.
    """
    keep = df.columns
    beta, gamma = F.radians(tilt), F.radians(azimuth)
    staged = (
        (df if sun_known else with_sun(df, ts, lat, lon))
        .withColumns({"_beta": beta, "_sin_z": F.sqrt(F.greatest(1.0 - F.col("cos_zenith") ** 2, F.lit(0.0)))})
        .withColumn(
            "_proj",
            F.col("cos_zenith") * F.cos("_beta")
            + F.col("_sin_z") * F.sin("_beta") * F.cos(F.col("sun_azimuth") - gamma),
        )
        .withColumns(
            {
                "_proj": F.greatest(F.least(F.col("_proj"), F.lit(1.0)), F.lit(-1.0)),
                "_ai": F.col("dni") / F.col("extra_radiation"),
            }
        )
        .withColumns(
            {
                "_beam": F.col("dni") * F.greatest(F.col("_proj"), F.lit(0.0)),
                "_rb": F.greatest(F.col("_proj"), F.lit(0.0))
                / F.greatest(F.col("cos_zenith"), F.lit(MIN_COS_ZENITH)),
                "_refr": F.sqrt(1.0 - (1.0 - F.col("_proj") ** 2) / (GLASS_INDEX**2)),
            }
        )
        .withColumns(
            {
                "_sky": F.greatest(
                    F.col("dhi")
                    * (
                        F.col("_ai") * F.col("_rb")
                        + (1.0 - F.col("_ai")) * (1.0 + F.cos("_beta")) / 2.0
                    ),
                    F.lit(0.0),
                )
                + F.col("ghi") * ALBEDO * (1.0 - F.cos("_beta")) / 2.0,
                "_iam": F.when(
                    F.col("_proj") > 0.0,
                    _glass_transmittance(F.col("_proj"), F.col("_refr")) / _NORMAL_TRANSMITTANCE,
                ).otherwise(F.lit(0.0)),
            }
        )
        .withColumns(
            {
                "_poa": F.col("_beam") + F.col("_sky"),
                "_eff": F.col("_beam") * F.col("_iam") + F.col("_sky"),
            }
        )
        .withColumn(
            "_cell",
            F.col("_poa") * F.exp(SAPM_A + F.lit(SAPM_B) * F.col("wind_speed"))
            + F.col("temp_air")
            + F.col("_poa") / 1000.0 * SAPM_DELTA_T,
        )
        .withColumn(
            "_zeta", F.col("_eff") / 1000.0 * (1.0 + F.lit(TEMPERATURE_COEFFICIENT) * (F.col("_cell") - 25.0))
        )
    )
    a, b, c = INVERTER_CURVE
    # eta(zeta) * zeta, multiplied out so that the efficiency needs no division by a small load
    converted = F.lit(inverter_efficiency / INVERTER_REFERENCE) * (
        a * F.col("_zeta") ** 2 + b + c * F.col("_zeta")
    )
    ac = F.when(
        F.col("_zeta") > 0.0,
        F.least(converted * DC_RATING_W, F.lit(inverter_efficiency * DC_RATING_W)),
    ).otherwise(F.lit(0.0))
    return staged.select(*keep, F.greatest(ac, F.lit(0.0)).alias(out))
