"""Weighted overlay, classification and class statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.operators.quantiles import quantiles
from terralux.operators.reclassify import present_criteria, score_name
from terralux.registry import Registry

# Class count, missing-class code at sinks, published comparison figures.
CLASS_COUNT = 5
NO_CLASS = -9999
PUBLISHED_TOP_PCT = 24.9

SNAP = 1e12


def overlay_text(columns: dict[str, str], weights: dict[str, float]) -> str:
    """P16 as SQL text over {criterion: score column}: weights renormalised over the given
    scores, then per cell over the non-missing ones.

    The index is snapped to 12 decimals: cells whose scores weigh the same then have the same
    index, whatever the last bits of the sum, and fall on the same side of a class bound.
    """
    known = {k: c for k, c in columns.items() if k in weights}
    if not known:
        raise ValueError("no criterion of the registry is present")
    total = sum(weights[k] for k in known)
    if total <= 0.0:
        raise ValueError("the weights of the present criteria sum to zero")
    shares = {k: weights[k] / total for k in known}
    weighted = " + ".join(f"{shares[k]!r}D * coalesce({c}, 0.0D)" for k, c in known.items())
    carried = " + ".join(f"IF({c} IS NULL, 0.0D, {shares[k]!r}D)" for k, c in known.items())
    return f"rint(({weighted}) / nullif({carried}, 0.0D) * {SNAP!r}D) / {SNAP!r}D"


def score_columns(columns: list[str], registry: Registry) -> dict[str, str]:
    return {c.key: score_name(c.key) for c in registry.criteria if score_name(c.key) in columns}


def with_lsi(scored: DataFrame, registry: Registry, weights: dict[str, float] | None = None) -> DataFrame:
    text = overlay_text(score_columns(scored.columns, registry), weights or registry.global_weights())
    return scored.selectExpr("*", f"{text} AS lsi")


def missing_criteria(columns: list[str], registry: Registry) -> list[str]:
    """Registry criteria without a layer."""
    present = {c.key for c in present_criteria(columns, registry)}
    return [c.key for c in registry.criteria if c.key not in present]


def equal_interval_bounds(df: DataFrame, keys: list[str], value: str = "lsi", classes: int = CLASS_COUNT) -> DataFrame:
    """The inner class bounds as an array, from minimum and maximum."""
    span = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(classes))
    return span.select(
        *keys, F.array(*(F.lit(float(i)) * step + F.col("lo") for i in range(1, classes))).alias("bounds")
    )


def quantile_bounds(df: DataFrame, keys: list[str], value: str = "lsi", classes: int = CLASS_COUNT) -> DataFrame:
    """The inner class bounds as an array, from exact quantiles of the non-missing values."""
    # The value is a whole scoring of the cells, so it is written before it is read twice.
    found = quantiles(df, keys, value, [i * (1.0 / classes) for i in range(1, classes)], stored=True)
    return found.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("q", "threshold"))), lambda s: s["threshold"]).alias("bounds")
    )


def class_of(value: Column, bounds: Column) -> Column:
    """1 + the number of inner bounds below the value; missing stays missing."""
    return F.when(value.isNotNull(), F.size(F.filter(bounds, lambda b: b < value)) + 1)


def classify(df: DataFrame, keys: list[str], method: str = "equal_interval", value: str = "lsi",
             out: str = "lsi_class", classes: int = CLASS_COUNT) -> DataFrame:
    """P17 over A7 / A8. The bounds have one row per scene; the join is left to AQE, which
    broadcasts them when their measured size allows and splits a hot scene when not."""
    makers = {"equal_interval": equal_interval_bounds, "quantile": quantile_bounds}
    if method not in makers:
        raise ValueError(f"unknown class method {method!r}")
    bounds = makers[method](df, keys, value, classes)
    return df.join(bounds, keys, "left").withColumn(out, class_of(F.col(value), F.col("bounds"))).drop("bounds")


def class_distribution(df: DataFrame, keys: list[str], registry: Registry, cls: str = "lsi_class") -> DataFrame:
    """Share of every class among valid cells, absent classes included, two decimals."""
    labels = F.create_map(*(F.lit(v) for pair in registry.classes.items() for v in pair))
    counts = F.map_from_entries(F.collect_list(F.struct(cls, "n")))
    per_scene = (
        df.filter(F.col(cls).isNotNull())
        .groupBy(*keys, cls)
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(counts.alias("counts"), F.sum("n").alias("valid"))
    )
    ids = F.array(*(F.lit(c) for c in sorted(registry.classes, reverse=True)))
    return (
        per_scene.select(*keys, "counts", "valid", F.explode(ids).alias("class_id"))
        .withColumn("cells", F.coalesce(F.try_element_at("counts", F.col("class_id")), F.lit(0)))
        .select(
            *keys,
            "class_id",
            F.element_at(labels, F.col("class_id")).alias("label"),
            "cells",
            F.round(F.lit(100.0) * F.col("cells") / F.col("valid"), 2).alias("pct"),
        )
    )


def with_class_areas(distribution: DataFrame, cell_area_km2: Column, scene_area_km2: Column) -> DataFrame:
    """Area by counted cells, and the share scaled to the whole area of interest."""
    return distribution.withColumns(
        {
            "area_km2_cells": F.col("cells") * cell_area_km2,
            "area_km2_scaled": F.round(F.col("pct") / 100.0 * scene_area_km2, 2),
        }
    )


def exclusion_summary(df: DataFrame, keys: list[str], value: str = "lsi") -> DataFrame:
    """A10: total, excluded and valid cells, excluded share to one decimal."""
    return (
        df.groupBy(*keys)
        .agg(
            F.count("*").alias("total_cells"),
            F.count_if("excluded").alias("excluded_cells"),
            F.count(value).alias("valid_cells"),
        )
        .withColumn("excluded_pct", F.round(100.0 * F.col("excluded_cells") / F.col("total_cells"), 1))
    )


def compare_with_published(distribution: DataFrame, keys: list[str], published: float = PUBLISHED_TOP_PCT) -> DataFrame:
    """Top-class and top-two shares against a published share."""

    def share(cls: int) -> Column:
        return F.sum(F.when(F.col("class_id") == cls, F.col("pct")).otherwise(F.lit(0.0)))

    return (
        distribution.groupBy(*keys)
        .agg(share(5).alias("top1_pct"), F.round(share(5) + share(4), 2).alias("top2_pct"))
        .withColumns(
            {
                "delta_top1": F.round(F.col("top1_pct") - published, 2),
                "delta_top2": F.round(F.col("top2_pct") - published, 2),
            }
        )
    )


def override_weights(registry_weights: Column, overrides: Column) -> Column:
    """Apply overrides one after another.

    ``registry_weights`` is ARRAY<STRUCT<key, group_key, w>>, ``overrides`` an ordered
    ARRAY<STRUCT<key, weight>>. Each override sets one local weight and takes the change
    from its siblings in proportion to their weights, not below 0. Unknown keys are ignored.
    """

    def apply(state: Column, change: Column) -> Column:
        target = F.filter(state, lambda s: s["key"] == change["key"])[0]
        siblings = F.aggregate(
            F.filter(state, lambda s: (s["group_key"] == target["group_key"]) & (s["key"] != target["key"])),
            F.lit(0.0),
            lambda total, s: total + s["w"],
        )
        delta = change["weight"] - target["w"]
        moved = F.transform(
            state,
            lambda s: F.struct(
                s["key"].alias("key"),
                s["group_key"].alias("group_key"),
                F.when(s["key"] == change["key"], change["weight"])
                .when(
                    (s["group_key"] == target["group_key"]) & (siblings > 1e-9),
                    F.greatest(F.lit(0.0), s["w"] - delta * s["w"] / siblings),
                )
                .otherwise(s["w"])
                .alias("w"),
            ),
        )
        return F.when(F.exists(state, lambda s: s["key"] == change["key"]), moved).otherwise(state)

    return F.aggregate(overrides, registry_weights, apply)


def registry_weight_array(registry: Registry) -> Column:
    return F.array(
        *(
            F.struct(F.lit(c.key).alias("key"), F.lit(c.group).alias("group_key"), F.lit(c.weight).alias("w"))
            for c in registry.criteria
        )
    )


def scenario_shares(scenarios: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Scenario rows (scene_id, scenario_id, key, weight) as one array of shares per scene and scenario.

    Shares are in the order of ``columns`` and sum to 1 over the criteria that have a score.
    """
    total = F.sum(F.when(F.col("key").isin(*columns), F.col("weight")))
    shares = F.array(
        *(F.coalesce(F.max(F.when(F.col("key") == k, F.col("weight"))), F.lit(0.0)) / F.nullif(total, F.lit(0.0)) for k in columns)
    )
    return scenarios.groupBy("scene_id", "scenario_id").agg(shares.alias("_shares"))


def overlay_scenarios(scored: DataFrame, registry: Registry, scenarios: DataFrame) -> DataFrame:
    """P16 for the weightings of a scenario table: (…, scenario_id, lsi).

    A scene's cells meet the scenarios of that scene by an equi-join, so there may be any number. A
    scenario whose weights for the scored criteria sum to zero has no index.
    """
    columns = score_columns(scored.columns, registry)
    weighted = " + ".join(f"_shares[{i}] * coalesce({c}, 0.0D)" for i, c in enumerate(columns.values()))
    carried = " + ".join(f"IF({c} IS NULL, 0.0D, _shares[{i}])" for i, c in enumerate(columns.values()))
    keep = [c for c in scored.columns if not c.startswith("s_")]
    return scored.join(scenario_shares(scenarios, columns), "scene_id").selectExpr(
        *keep, "scenario_id", f"rint(({weighted}) / nullif({carried}, 0.0D) * {SNAP!r}D) / {SNAP!r}D AS lsi"
    )
