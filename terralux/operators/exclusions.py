"""Hard exclusions (P12-P15, U2): boolean columns over the cell table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.registry import Exclusion, Registry

# Land-cover codes that are always excluded (built-up, water).
EXCLUDED_LAND_COVER = (50, 80)


def rule_column(rule: Exclusion) -> Column:
    """A rule as a predicate; a missing layer value does not exclude."""
    layer = F.col(rule.layer)
    predicate = {
        "lt": lambda: layer < F.lit(rule.value),
        "gt": lambda: layer > F.lit(rule.value),
        "eq": lambda: layer == F.lit(rule.value),
        "is_true": lambda: layer.cast("boolean"),
    }[rule.op]()
    return F.coalesce(predicate, F.lit(False))


def land_cover_excluded(code: Column) -> Column:
    """P12."""
    return F.coalesce(code.isin(*EXCLUDED_LAND_COVER), F.lit(False))


def rule_columns(columns: list[str], registry: Registry) -> dict[str, Column]:
    """One predicate per rule whose layer is present."""
    available = set(columns)
    return {r.key: rule_column(r) for r in registry.exclusions if r.layer in available}


def any_of(masks: dict[str, Column]) -> Column:
    """Union of masks. No mask at all is an error."""
    if not masks:
        raise ValueError("at least one exclusion mask is needed")
    return reduce(lambda a, b: a | b, masks.values())


def nonzero(mask: Column) -> Column:
    """A numeric mask excludes where it is not 0."""
    return F.coalesce(mask != 0, F.lit(False))


def unknown_masks(masks: dict[str, Column], registry: Registry) -> list[str]:
    """Names without a registry rule; they are used anyway and reported."""
    known = {r.key for r in registry.exclusions}
    return [m for m in masks if m not in known]


def with_excluded(cells: DataFrame, registry: Registry, extra: dict[str, Column] | None = None) -> DataFrame:
    masks = {**rule_columns(cells.columns, registry), **(extra or {})}
    return cells.withColumn("excluded", any_of(masks))


def apply_exclusions(lsi: Column, excluded: Column, fill: float | None = None) -> Column:
    """Excluded cells take ``fill`` (missing by default), others keep their value."""
    return F.when(excluded, F.lit(fill).cast("double")).otherwise(lsi)
