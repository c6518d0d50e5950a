"""Raw layers to suitability scores (P1, P2, P4, P5, J5, J6). All narrow except the table forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.functions.units import DAYS_PER_YEAR, needs_daily
from terralux.registry import Criterion, Registry

# Aspect codes 0..8.
ASPECT_LABELS = (
    "flat",
    "north",
    "northeast",
    "east",
    "southeast",
    "south",
    "southwest",
    "west",
    "northwest",
)


def band_score(value: Column, bands: tuple[tuple[float, float], ...]) -> Column:
    """The first band whose upper bound is not exceeded; above the last, 0; missing stays missing."""
    chain = F.when(value.isNull(), F.lit(None).cast("double"))
    for upper, score in bands:
        chain = chain.when(value <= F.lit(upper), F.lit(score))
    return chain.otherwise(F.lit(0.0))


def code_score(code: Column, scores: dict[str, float]) -> Column:
    """Score of a class code given as text; unknown codes score 0, missing stays missing."""
    lookup = F.create_map(*(F.lit(v) for pair in scores.items() for v in pair))
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(lookup, code), F.lit(0.0)))


def code_text(value: Column, numeric: bool) -> Column:
    """Numeric codes are looked up by their integer text."""
    return value.cast("int").cast("string") if numeric else value


def aspect_label(code: Column) -> Column:
    """T4: integer aspect codes become compass names; anything else counts as flat."""
    names = F.array(*(F.lit(n) for n in ASPECT_LABELS))
    return F.when(
        code.isNotNull(),
        F.when(code.between(0, len(ASPECT_LABELS) - 1), F.element_at(names, code.cast("int") + 1)).otherwise(
            F.lit("flat")
        ),
    )


def _double(value: float) -> str:
    return "CAST('Infinity' AS DOUBLE)" if value == float("inf") else f"{value!r}D"


def value_text(criterion: Criterion, layer: str, data_unit: str | None = None) -> str:
    """A banded layer in the criterion's unit, as SQL: metres to kilometres, annual to daily."""
    unit = criterion.layer_unit if data_unit is None else data_unit
    text = f"CAST({layer} AS DOUBLE)"
    if criterion.to_unit != 1.0:
        text = f"{text} / {_double(round(1.0 / criterion.to_unit, 9))}"
    if needs_daily(unit or "", criterion.unit):
        text = f"{text} / {_double(DAYS_PER_YEAR)}"
    return text


def score_text(criterion: Criterion, layer: str, numeric: bool = True, data_unit: str | None = None) -> str:
    """The score of one layer as SQL text: unit first (P3), then bands (P1) or codes.

    Text, because a registry makes a few hundred small expressions: parsing one string is
    much faster on the driver than building them column by column.
    """
    if criterion.bands:
        value = value_text(criterion, layer, data_unit)
        arms = " ".join(f"WHEN {value} <= {_double(hi)} THEN {_double(s)}" for hi, s in criterion.bands)
    elif criterion.key == "aspect":
        scores = [criterion.codes.get(name, 0.0) for name in ASPECT_LABELS]
        arms = " ".join(f"WHEN {layer} = {code} THEN {_double(s)}" for code, s in enumerate(scores))
        # codes outside the table count as flat
        arms += f" WHEN {layer} NOT BETWEEN 0 AND {len(scores) - 1} THEN {_double(scores[0])}"
    else:
        value = f"CAST({layer} AS INT)" if numeric else layer
        quote = "" if numeric else "'"
        arms = " ".join(f"WHEN {value} = {quote}{c}{quote} THEN {_double(s)}" for c, s in criterion.codes.items())
    return f"CASE WHEN {layer} IS NULL THEN CAST(NULL AS DOUBLE) {arms} ELSE 0.0D END"


def score_column(criterion: Criterion, layer: str, numeric: bool = True, data_unit: str | None = None) -> Column:
    """P4 as a column."""
    return F.expr(score_text(criterion, layer, numeric, data_unit))


def score_name(key: str) -> str:
    return f"s_{key}"


def present_criteria(columns: list[str], registry: Registry) -> list[Criterion]:
    """Criteria whose layer exists; others are left to the renormalisation."""
    available = set(columns)
    return [c for c in registry.criteria if c.layer in available]


def with_scores(cells: DataFrame, registry: Registry) -> DataFrame:
    """P5: one score column per criterion whose layer is present, in a single projection."""
    types = dict(cells.dtypes)
    texts = [
        f"{score_text(c, c.layer, types[c.layer] != 'string')} AS {score_name(c.key)}"
        for c in present_criteria(cells.columns, registry)
    ]
    return cells.selectExpr("*", *texts)


def long_layers(cells: DataFrame, registry: Registry, keys: list[str]) -> DataFrame:
    """Unpivot layers to (…keys, key, value, code) for table-driven scoring."""
    types = dict(cells.dtypes)
    entries = []
    for c in present_criteria(cells.columns, registry):
        if c.bands:
            entries.append(F.struct(F.lit(c.key).alias("key"), F.expr(value_text(c, c.layer)).alias("value"),
                                    F.lit(None).cast("string").alias("code")))
        else:
            text = types[c.layer] == "string"
            code = aspect_label(F.col(c.layer)) if c.key == "aspect" else code_text(F.col(c.layer), not text)
            entries.append(F.struct(F.lit(c.key).alias("key"), F.lit(None).cast("double").alias("value"), code.alias("code")))
    return cells.select(*keys, F.inline(F.array(*entries)))


def score_by_bands(values: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """Range join of values to registry bands (lo < value <= hi); 0 above the last bound.

    The registry table has a few dozen rows by construction and is broadcast; the equality
    on ``key`` makes this a hash join, so each value only meets the bands of its criterion.
    """
    bands = F.broadcast(breakpoints.select("key", "lo", "hi", "score"))
    return (
        values.filter(F.col("value").isNotNull())
        .withColumnRenamed("key", "_key")
        .join(bands, (F.col("_key") == F.col("key")) & (F.col("value") > F.col("lo")) & (F.col("value") <= F.col("hi")), "left")
        .drop("lo", "hi", "key")
        .withColumnRenamed("_key", "key")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    )


def score_by_codes(values: DataFrame, class_scores: DataFrame) -> DataFrame:
    """Left join of class codes to registry scores; unknown codes score 0."""
    scores = F.broadcast(class_scores)
    return (
        values.filter(F.col("code").isNotNull())
        .join(scores, ["key", "code"], "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    )
