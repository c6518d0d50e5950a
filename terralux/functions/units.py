"""Unit recognition and annual-to-daily conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that mark annual and daily quantities.
ANNUAL_ENDINGS = ("/yr", "/year", "yr", "year")
DAILY_ENDINGS = ("/day", "/d")

DAYS_PER_YEAR = 365.0


def _ends_with(unit: Column, endings: tuple[str, ...]) -> Column:
    text = F.lower(F.trim(unit))
    found = F.lit(False)
    for ending in endings:
        found = found | text.endswith(ending)
    return found


def is_annual(unit: Column) -> Column:
    return _ends_with(unit, ANNUAL_ENDINGS)


def is_daily(unit: Column) -> Column:
    return _ends_with(unit, DAILY_ENDINGS)


def needs_daily(data_unit: str, criterion_unit: str) -> bool:
    """Whether a layer in ``data_unit`` must be divided by 365 for a criterion per day."""
    data, wanted = data_unit.lower().strip(), criterion_unit.lower().strip()
    return wanted.endswith(DAILY_ENDINGS) and data.endswith(ANNUAL_ENDINGS)


def to_criterion_unit(value: Column, data_unit: Column, criterion_unit: Column) -> Column:
    """Annual data for a per-day criterion is divided by 365; anything else passes through."""
    annual = is_daily(criterion_unit) & is_annual(F.coalesce(data_unit, F.lit("")))
    return F.when(annual, value / F.lit(DAYS_PER_YEAR)).otherwise(value)


def unit_note(data_unit: Column, criterion_unit: Column) -> Column:
    """Why a per-day criterion was scored without conversion; NULL when there is nothing to say."""
    unit = F.coalesce(data_unit, F.lit(""))
    return F.when(
        is_daily(criterion_unit) & ~is_annual(unit) & ~is_daily(unit),
        F.when(unit == "", F.lit("no unit, assumed daily")).otherwise(
            F.concat(F.lit("unrecognised unit: "), unit)
        ),
    )


def wind_to_ms(speed: Column, unit: Column) -> Column:
    """P10: km/h becomes m/s; a missing unit counts as km/h."""
    text = F.lower(F.coalesce(unit, F.lit("km/h")))
    return F.when(text.contains("km/h") | text.contains("kph"), speed / F.lit(3.6)).otherwise(speed)
