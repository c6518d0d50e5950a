"""Map projections and ring measures on the WGS-84 ellipsoid, as column arithmetic.

The transverse Mercator pair uses the Krueger series in the third flattening to fourth
order (Karney 2011). The multi-step transforms take and return DataFrames: staging the
steps as projections keeps every intermediate computed once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.functions.bind import let

# WGS-84 ellipsoid, UTM scale and false origin, equal-area standard parallel.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0
EQUAL_AREA_PARALLEL_DEG = 30.0

ECC2 = FLATTENING * (2.0 - FLATTENING)
ECC = math.sqrt(ECC2)
_N = FLATTENING / (2.0 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)

# Series coefficients (Karney 2011, eqs. 35 and 36, to n^4).
FORWARD_SERIES = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
INVERSE_SERIES = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)

_EA_PHI = math.radians(EQUAL_AREA_PARALLEL_DEG)
EQUAL_AREA_K0 = math.cos(_EA_PHI) / math.sqrt(1.0 - ECC2 * math.sin(_EA_PHI) ** 2)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone; the equator counts as north."""
    zone = ((lon + 180.0) / 6.0).cast("int") % 60 + 1
    return zone + F.when(lat >= 0.0, F.lit(32600)).otherwise(F.lit(32700))


def _zone_meridian(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6.0 - 183.0)


def _is_south(epsg: Column) -> Column:
    return epsg >= 32700


def _series(base: Column, terms: tuple[float, ...], first, second, xi: str, eta: str, sign: float) -> Column:
    total = base
    for j, coefficient in enumerate(terms, start=1):
        total = total + F.lit(sign * coefficient) * first(F.col(xi) * (2.0 * j)) * second(
            F.col(eta) * (2.0 * j)
        )
    return total


def with_utm(df: DataFrame, lon: str, lat: str, epsg: str, x: str = "x", y: str = "y") -> DataFrame:
    """C3 forward: longitude/latitude in degrees to metres in the given UTM zone."""
    keep = [c for c in df.columns if c not in (x, y)]
    phi = F.radians(F.col(lat))
    staged = (
        df.select(*keep, F.tan(phi).alias("_tau"), (F.radians(F.col(lon)) - _zone_meridian(F.col(epsg))).alias("_lam"))
        .withColumn(
            "_sig", F.sinh(F.lit(ECC) * F.atanh(F.lit(ECC) * F.col("_tau") / F.sqrt(1.0 + F.col("_tau") ** 2)))
        )
        .withColumn(
            "_tp",
            F.col("_tau") * F.sqrt(1.0 + F.col("_sig") ** 2) - F.col("_sig") * F.sqrt(1.0 + F.col("_tau") ** 2),
        )
        .withColumns(
            {
                "_xi": F.atan2(F.col("_tp"), F.cos("_lam")),
                "_eta": F.asinh(F.sin("_lam") / F.sqrt(F.col("_tp") ** 2 + F.cos("_lam") ** 2)),
            }
        )
    )
    east = _series(F.col("_eta"), FORWARD_SERIES, F.cos, F.sinh, "_xi", "_eta", 1.0)
    north = _series(F.col("_xi"), FORWARD_SERIES, F.sin, F.cosh, "_xi", "_eta", 1.0)
    scale = UTM_SCALE * RECTIFYING
    return staged.select(
        *keep,
        (F.lit(FALSE_EASTING) + F.lit(scale) * east).alias(x),
        (
            F.lit(scale) * north
            + F.when(_is_south(F.col(epsg)), F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
        ).alias(y),
    )


def with_lonlat(df: DataFrame, x: str, y: str, epsg: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """C3 inverse: UTM metres to degrees, with three Newton steps for the latitude."""
    keep = [c for c in df.columns if c not in (lon, lat)]
    scale = UTM_SCALE * RECTIFYING
    south = F.when(_is_south(F.col(epsg)), F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    staged = (
        df.select(
            *keep,
            ((F.col(y) - south) / F.lit(scale)).alias("_xi"),
            ((F.col(x) - FALSE_EASTING) / F.lit(scale)).alias("_eta"),
        )
        .withColumns(
            {
                "_xp": _series(F.col("_xi"), INVERSE_SERIES, F.sin, F.cosh, "_xi", "_eta", -1.0),
                "_ep": _series(F.col("_eta"), INVERSE_SERIES, F.cos, F.sinh, "_xi", "_eta", -1.0),
            }
        )
        .withColumn("_tp", F.sin("_xp") / F.sqrt(F.sinh("_ep") ** 2 + F.cos("_xp") ** 2))
        .withColumn("_tau", F.col("_tp"))
    )
    for _ in range(3):
        staged = (
            staged.withColumn(
                "_sig",
                F.sinh(F.lit(ECC) * F.atanh(F.lit(ECC) * F.col("_tau") / F.sqrt(1.0 + F.col("_tau") ** 2))),
            )
            .withColumn(
                "_ti",
                F.col("_tau") * F.sqrt(1.0 + F.col("_sig") ** 2)
                - F.col("_sig") * F.sqrt(1.0 + F.col("_tau") ** 2),
            )
            .withColumn(
                "_tau",
                F.col("_tau")
                + (F.col("_tp") - F.col("_ti"))
                / F.sqrt(1.0 + F.col("_ti") ** 2)
                * (1.0 + F.lit(1.0 - ECC2) * F.col("_tau") ** 2)
                / (F.lit(1.0 - ECC2) * F.sqrt(1.0 + F.col("_tau") ** 2)),
            )
        )
    return staged.select(
        *keep,
        F.degrees(_zone_meridian(F.col(epsg)) + F.atan2(F.sinh("_ep"), F.cos("_xp"))).alias(lon),
        F.degrees(F.atan(F.col("_tau"))).alias(lat),
    )


def equal_area_x(lon: Column) -> Column:
    """C4: easting of the cylindrical equal-area projection with standard parallel 30 degrees."""
    return F.lit(SEMI_MAJOR * EQUAL_AREA_K0) * F.radians(lon)


def equal_area_y(lat: Column) -> Column:
    """C4: northing of the same projection (authalic closed form)."""
    s = F.sin(F.radians(lat))
    q = F.lit(1.0 - ECC2) * (
        s / (1.0 - ECC2 * s * s) - F.lit(1.0 / (2.0 * ECC)) * F.log((1.0 - ECC * s) / (1.0 + ECC * s))
    )
    return F.lit(SEMI_MAJOR / (2.0 * EQUAL_AREA_K0)) * q


def _sides(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring."""
    n = F.size(ring)
    return F.arrays_zip(
        F.slice(ring, F.lit(1), n - 1).alias("a"), F.slice(ring, F.lit(2), n - 1).alias("b")
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring of (x, y) structs, positive when counter-clockwise."""


    def area(r: Column) -> Column:
        return _sum(F.transform(_sides(r), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / F.lit(2.0)

    return let(ring, area)


def centroid_moments(ring: Column) -> Column:
    """Signed area and its first moments; summed over rings they give a centroid."""

    def cross(s: Column) -> Column:
        return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]

    sides = _sides(ring)
    return F.struct(
        signed_area(ring).alias("area"),
        (_sum(F.transform(sides, lambda s: (s["a"]["x"] + s["b"]["x"]) * cross(s))) / 6.0).alias("mx"),
        (_sum(F.transform(sides, lambda s: (s["a"]["y"] + s["b"]["y"]) * cross(s))) / 6.0).alias("my"),
    )


def equal_area_ring(ring: Column) -> Column:
    return F.transform(
        ring, lambda v: F.struct(equal_area_x(v["x"]).alias("x"), equal_area_y(v["y"]).alias("y"))
    )


def roof_area_m2(ring: Column) -> Column:
    """C20: area of a small lon/lat ring on a local equirectangular plane.

    The ring may be open or closed; fewer than three corners have no area.
    """
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    corners = F.when((F.size(ring) > 1) & closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    mean_lat = _sum(F.transform(corners, lambda v: v["y"])) / F.size(corners)
    shut = F.concat(corners, F.slice(corners, 1, 1))
    # Radians from the first corner (a roof is tiny against its longitude, and the sum would
    # cancel); both axes are scaled after it: square radians times R^2 cos(lat0).
    radians = F.transform(
        shut,
        lambda v: F.struct(
            F.radians(v["x"] - ring[0]["x"]).alias("x"), F.radians(v["y"] - ring[0]["y"]).alias("y")
        ),
    )
    area = F.abs(signed_area(radians)) * F.lit(SEMI_MAJOR**2) * F.cos(F.radians(mean_lat))
    return F.when(F.size(corners) < 3, F.lit(0.0)).otherwise(area)


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against one closed ring."""
    crossings = F.filter(
        _sides(ring),
        lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y))
        & (
            x
            < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0))
            + s["a"]["x"]
        ),
    )
    return F.size(crossings) % 2 == 1


def effective_tilt(tilt: Column, lat: Column) -> Column:
    """A given tilt, else the absolute latitude."""
    return F.coalesce(tilt, F.abs(lat))


def effective_azimuth(azimuth: Column, lat: Column) -> Column:
    """A given azimuth, else facing the equator."""
    return F.coalesce(azimuth, F.when(lat >= 0.0, F.lit(180.0)).otherwise(F.lit(0.0)))
