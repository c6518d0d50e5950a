"""The itemised DC loss stack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default loss percentages and nominal inverter efficiency.
DC_LOSSES_PCT = {
    "soiling": 2.0,
    "shading": 3.0,
    "snow": 0.0,
    "mismatch": 2.0,
    "wiring": 2.0,
    "connections": 0.5,
    "lid": 1.5,
    "nameplate_rating": 1.0,
    "age": 0.0,
    "availability": 3.0,
}
INVERTER_EFFICIENCY = 0.96
INVERTER_RANGE = (0.80, 1.0)


def loss_items(**overrides: Column) -> Column:
    """The stack as ARRAY<STRUCT<name, pct>>; a NULL override keeps the default."""
    unknown = set(overrides) - set(DC_LOSSES_PCT)
    if unknown:
        raise ValueError(f"unknown losses: {sorted(unknown)}")
    return F.array(
        *(
            F.struct(
                F.lit(name).alias("name"),
                F.coalesce(overrides.get(name, F.lit(None).cast("double")), F.lit(pct)).alias("pct"),
            )
            for name, pct in DC_LOSSES_PCT.items()
        )
    )


def dc_derate(items: Column) -> Column:
    """Losses multiply: the product of (1 - pct/100)."""
    return F.aggregate(items, F.lit(1.0), lambda kept, item: kept * (1.0 - item["pct"] / 100.0))


def dc_loss_fraction(items: Column) -> Column:
    return 1.0 - dc_derate(items)


def total_derate(items: Column, inverter: Column | None = None) -> Column:
    return dc_derate(items) * (F.lit(INVERTER_EFFICIENCY) if inverter is None else inverter)


def loss_faults(items: Column, inverter: Column) -> Column:
    """Names of inputs outside their range, as an array."""
    lo, hi = INVERTER_RANGE
    return F.concat(
        F.transform(F.filter(items, lambda i: ~i["pct"].between(0.0, 100.0)), lambda i: i["name"]),
        F.when(~inverter.between(lo, hi), F.array(F.lit("inverter_nominal_efficiency"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
