"""Criteria registry: a YAML file on the driver, dimension tables on the cluster.

The registry is a few dozen rows by construction (13 criteria, at most seven bands
each), so its tables are the one thing that is broadcast without a runtime check.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DEFAULT_PATH = Path(__file__).parent / "data" / "criteria.yaml"

WEIGHT_TOLERANCE = 1e-6


@dataclass(frozen=True)
class Criterion:
    key: str
    group: str
    weight: float
    unit: str
    layer: str
    layer_unit: str | None = None
    to_unit: float = 1.0
    bands: tuple[tuple[float, float], ...] = ()
    codes: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Exclusion:
    key: str
    layer: str
    op: str
    value: float | None = None


@dataclass(frozen=True)
class Registry:
    groups: dict[str, float]
    criteria: tuple[Criterion, ...]
    exclusions: tuple[Exclusion, ...]
    classes: dict[int, str]

    def criterion(self, key: str) -> Criterion:
        for c in self.criteria:
            if c.key == key:
                return c
        raise KeyError(key)

    def global_weights(self) -> dict[str, float]:
        return {c.key: self.groups[c.group] * c.weight for c in self.criteria}


class RegistryError(ValueError):
    """The registry file cannot be used."""


def load_registry(path: str | Path = DEFAULT_PATH) -> Registry:
    doc = yaml.safe_load(Path(path).read_text())
    missing = {"groups", "criteria", "exclusions", "classes"} - set(doc or {})
    if missing:
        raise RegistryError(f"missing sections: {sorted(missing)}")
    groups = {k: float(v["weight"]) for k, v in doc["groups"].items()}
    criteria = []
    for row in doc["criteria"]:
        if row["group"] not in groups:
            raise RegistryError(f"{row['key']}: unknown group {row['group']}")
        if bool(row.get("bands")) == bool(row.get("codes")):
            raise RegistryError(f"{row['key']}: exactly one of bands and codes is needed")
        criteria.append(
            Criterion(
                key=row["key"],
                group=row["group"],
                weight=float(row["weight"]),
                unit=row["unit"],
                layer=row["layer"],
                layer_unit=row.get("layer_unit"),
                to_unit=float(row.get("to_unit", 1.0)),
                bands=tuple((float(hi), float(s)) for hi, s in row.get("bands", [])),
                codes={str(k): float(v) for k, v in row.get("codes", {}).items()},
            )
        )
    exclusions = tuple(
        Exclusion(r["key"], r["layer"], r["op"], r.get("value")) for r in doc["exclusions"]
    )
    return Registry(groups, tuple(criteria), exclusions, {int(k): v for k, v in doc["classes"].items()})


def registry_rows(registry: Registry) -> dict[str, tuple[str, list[tuple]]]:
    """Each registry table as (DDL schema, rows)."""
    bands = [
        (c.key, pos, lo, hi, score)
        for c in registry.criteria
        for pos, (lo, (hi, score)) in enumerate(
            zip((-math.inf, *(b[0] for b in c.bands)), c.bands, strict=False)
        )
    ]
    return {
        "groups": ("group_key STRING, group_weight DOUBLE", list(registry.groups.items())),
        "criteria": (
            "key STRING, group_key STRING, local_weight DOUBLE, unit STRING, layer STRING, kind STRING",
            [(c.key, c.group, c.weight, c.unit, c.layer, "bands" if c.bands else "codes") for c in registry.criteria],
        ),
        "breakpoints": ("key STRING, pos INT, lo DOUBLE, hi DOUBLE, score DOUBLE", bands),
        "class_scores": (
            "key STRING, code STRING, score DOUBLE",
            [(c.key, code, s) for c in registry.criteria for code, s in c.codes.items()],
        ),
        "exclusions": (
            "key STRING, layer STRING, op STRING, value DOUBLE",
            [(e.key, e.layer, e.op, None if e.value is None else float(e.value)) for e in registry.exclusions],
        ),
    }


def registry_tables(spark: SparkSession, registry: Registry) -> dict[str, DataFrame]:
    """Groups, criteria, bands, class codes and exclusion rules as tables."""
    return {name: spark.createDataFrame(rows, ddl) for name, (ddl, rows) in registry_rows(registry).items()}


def global_weights(criteria: DataFrame, groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Group weight x local weight. ``by`` adds a registry version to the key."""
    keys = [*(by or []), "group_key"]
    return criteria.join(groups, keys).withColumn(
        "global_weight", F.col("group_weight") * F.col("local_weight")
    )


def unknown_groups(criteria: DataFrame, groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Criteria whose group does not exist."""
    return criteria.join(groups, [*(by or []), "group_key"], "left_anti")


def weight_violations(criteria: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Group, local and global weight sums that miss 1 by more than 1e-6.

    One row per violated rule: (*by, rule, scope, total).
    """

    def off(total: str) -> F.Column:
        return F.abs(F.col(total) - 1.0) > WEIGHT_TOLERANCE

    of_groups = groups.groupBy(*by).agg(F.sum("group_weight").alias("total")).select(
        *by, F.lit("group_sum").alias("rule"), F.lit("all").alias("scope"), "total"
    )
    of_local = criteria.groupBy(*by, "group_key").agg(F.sum("local_weight").alias("total")).select(
        *by, F.lit("local_sum").alias("rule"), F.col("group_key").alias("scope"), "total"
    )
    of_global = (
        global_weights(criteria, groups, by)
        .groupBy(*by)
        .agg(F.sum("global_weight").alias("total"))
        .select(*by, F.lit("global_sum").alias("rule"), F.lit("all").alias("scope"), "total")
    )
    return of_groups.unionByName(of_local).unionByName(of_global).filter(off("total"))


def band_violations(breakpoints: DataFrame, by: list[str]) -> DataFrame:
    """Bounds that do not rise, and scores outside [0, 1]. At most seven bands per key."""
    order = W.partitionBy(*by, "key").orderBy("pos")
    checked = breakpoints.withColumn("before", F.lag("hi").over(order))
    return checked.select(
        *by,
        "key",
        "pos",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("hi") <= F.col("before"), F.lit("order")),
                    F.when(~F.col("score").between(0.0, 1.0), F.lit("score_range")),
                )
            )
        ).alias("rule"),
    )


def exclusion_weight_violations(criteria: DataFrame) -> DataFrame:
    """A hard-exclusion row must carry weight 0."""
    return criteria.filter((F.col("kind") == "hard_exclusion") & (F.col("local_weight") != 0.0))
