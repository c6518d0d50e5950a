"""Slope and aspect from elevation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.operators.quantiles import quantiles
from terralux.operators.stencil import with_cross

# Below this slope a cell is flat; aspect sectors are 45 degrees wide.
FLAT_BELOW_DEG = 0.5


def fill_with_median(cells: DataFrame, keys: list[str], value: str = "elevation") -> DataFrame:
    """Missing elevations take the scene median (0 when all are missing) in ``filled``."""
    median = quantiles(cells, keys, value, [0.5]).select(*keys, F.col("threshold").alias("_median"))
    return (
        cells.join(median, keys, "left")
        .withColumn("filled", F.coalesce(F.col(value), F.col("_median"), F.lit(0.0)))
        .drop("_median")
    )


def _gradient(before: Column, here: Column, after: Column, step: Column) -> Column:
    """Central difference inside, one-sided at a border."""
    return (
        F.when(before.isNotNull() & after.isNotNull(), (after - before) / (step * 2.0))
        .when(after.isNotNull(), (after - here) / step)
        .when(before.isNotNull(), (here - before) / step)
        .otherwise(F.lit(0.0))
    )


def aspect_class(slope: Column, east: Column, north: Column) -> Column:
    """0 flat, 1..8 clockwise from north, by the bearing of steepest descent."""
    bearing = F.pmod(F.degrees(F.atan2(-east, -north)) + 360.0, F.lit(360.0))
    sector = F.floor(F.pmod(bearing + 22.5, F.lit(360.0)) / 45.0).cast("int") + 1
    return F.when(slope >= FLAT_BELOW_DEG, sector).otherwise(F.lit(0))


def slope_aspect(cells: DataFrame, keys: list[str], resolution: Column, value: str = "elevation") -> DataFrame:
    """Adds ``slope`` (degrees, missing where elevation is) and ``aspect_class``."""
    crossed = with_cross(fill_with_median(cells, keys, value), keys, "filled")
    graded = crossed.withColumns(
        {
            "_east": _gradient(F.col("v_w"), F.col("filled"), F.col("v_e"), resolution),
            # rows run southward
            "_north": -_gradient(F.col("v_n"), F.col("filled"), F.col("v_s"), resolution),
        }
    ).withColumn("_slope", F.degrees(F.atan(F.sqrt(F.col("_east") ** 2 + F.col("_north") ** 2))))
    missing = F.col(value).isNull()
    return graded.withColumns(
        {
            "slope": F.when(~missing, F.col("_slope")),
            "aspect_class": F.when(missing, F.lit(0)).otherwise(
                aspect_class(F.col("_slope"), F.col("_east"), F.col("_north"))
            ),
        }
    ).drop("v_w", "v_e", "v_n", "v_s", "filled", "_east", "_north", "_slope")
