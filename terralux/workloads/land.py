"""Scoring, exclusion, overlay and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralux import registry as rg
from terralux.functions import units
from terralux.operators import exclusions, overlay
from terralux.operators.quantiles import quantiles
from terralux.operators.reclassify import (
    aspect_label,
    band_score,
    code_score,
    long_layers,
    score_by_bands,
    score_by_codes,
    score_column,
    with_scores,
)
from terralux.plans.suitability import classified_cells, comparison, score_cells
from terralux.workloads.catalog import query
from terralux.workloads.inputs import BASE_SQL, cells, cells_sql, grids, table

REG = rg.load_registry()
CELL = ["scene_id", "row", "col"]


def num(value: float) -> str:
    return "1e308" if value == float("inf") else f"{value!r}e0"


def bands_sql(expr: str, key: str) -> str:
    arms = " ".join(f"WHEN {expr} <= {num(hi)} THEN {num(s)}" for hi, s in REG.criterion(key).bands)
    return f"CASE WHEN {expr} IS NULL THEN NULL {arms} ELSE 0e0 END"


def codes_sql(expr: str, key: str) -> str:
    arms = " ".join(f"WHEN {expr} = '{code}' THEN {num(s)}" for code, s in REG.criterion(key).codes.items())
    return f"CASE WHEN {expr} IS NULL THEN NULL {arms} ELSE 0e0 END"


ASPECT_SQL = (
    "(['flat','north','northeast','east','southeast','south','southwest','west','northwest'])[aspect_class + 1]"
)


def score_sql(key: str) -> str:
    layer = REG.criterion(key).layer
    if key.startswith("dist_"):
        return bands_sql(f"({layer} / 1000e0)", key)
    if key == "solar_radiation":
        return bands_sql("(ghi_annual / 365e0)", key)
    if key == "aspect":
        return codes_sql(ASPECT_SQL, key)
    if key == "lulc":
        return codes_sql("CAST(lulc AS VARCHAR)", key)
    if key == "land_capability":
        return codes_sql(layer, key)
    return bands_sql(layer, key)


def lsi_sql(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    shares = {k: w / total for k, w in weights.items()}
    top = " + ".join(f"{num(w)} * coalesce(s_{k}, 0e0)" for k, w in shares.items())
    low = " + ".join(f"CASE WHEN s_{k} IS NOT NULL THEN {num(w)} ELSE 0e0 END" for k, w in shares.items())
    return f"(round_even(({top}) / nullif({low}, 0e0) * 1e12, 0) / 1e12)"


WEIGHTS = REG.global_weights()

EXCLUDED_SQL = """(coalesce(protected, false) OR coalesce(lulc = 80, false) OR coalesce(lulc = 50, false)
    OR coalesce(dist_urban < 1500, false) OR coalesce(slope > 20, false) OR coalesce(dist_roads < 150, false)
    OR coalesce(dist_railway < 150, false) OR coalesce(dist_power < 4800, false))"""

SCORED_SQL = (
    cells_sql(keep_base=True)
    + ",\nscored AS (SELECT *, "
    + ", ".join(f"{score_sql(c.key)} AS s_{c.key}" for c in REG.criteria)
    + f", {EXCLUDED_SQL} AS excluded FROM cells)"
)
LSI_SQL = (
    SCORED_SQL
    + f",\nraw AS (SELECT *, {lsi_sql(WEIGHTS)} AS lsi_raw FROM scored)"
    + ",\nlsi AS (SELECT *, CASE WHEN excluded THEN NULL ELSE lsi_raw END AS lsi FROM raw)"
)
EQUAL_BOUNDS_SQL = """
bounds AS (SELECT scene_id, [1e0 * st + lo, 2e0 * st + lo, 3e0 * st + lo, 4e0 * st + lo] AS b
  FROM (SELECT scene_id, min(lsi) AS lo, (max(lsi) - min(lsi)) / 5e0 AS st FROM lsi GROUP BY scene_id))"""
QUANTILE_BOUNDS_SQL = """
bounds AS (SELECT scene_id, quantile_cont(lsi, [0.2, 0.4, 0.6, 0.8]) AS b FROM lsi WHERE lsi IS NOT NULL GROUP BY scene_id)"""
CLASS_SQL = """
classed AS (SELECT l.*, CASE WHEN lsi IS NULL THEN NULL ELSE
    CAST(1 + (b[1] < lsi)::INT + (b[2] < lsi)::INT + (b[3] < lsi)::INT + (b[4] < lsi)::INT AS INTEGER) END AS lsi_class
  FROM lsi l LEFT JOIN bounds USING (scene_id))"""
EQUAL_SQL = f"{LSI_SQL},{EQUAL_BOUNDS_SQL},{CLASS_SQL}"
QUANTILE_SQL = f"{LSI_SQL},{QUANTILE_BOUNDS_SQL},{CLASS_SQL}"
DIST_SQL = """
ids AS (SELECT unnest([5, 4, 3, 2, 1]) AS class_id),
valid AS (SELECT scene_id, count(lsi_class) AS n FROM classed GROUP BY scene_id HAVING count(lsi_class) > 0),
counted AS (SELECT scene_id, lsi_class AS class_id, count(*) AS n FROM classed WHERE lsi_class IS NOT NULL GROUP BY 1, 2),
dist AS (SELECT v.scene_id, i.class_id, coalesce(c.n, 0) AS cells, round(100e0 * coalesce(c.n, 0) / v.n, 2) AS pct
  FROM valid v CROSS JOIN ids i LEFT JOIN counted c ON c.scene_id = v.scene_id AND c.class_id = i.class_id)"""
LABEL_SQL = (
    "CASE class_id "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in sorted(REG.classes.items()))
    + " END"
)


# ---- registry over many versions: one registry per supplier ---------------------------

# Each supplier owns a copy of the registry; some copies carry faults on fixed moduli.
GROUP_VALUES = ", ".join(f"('{g}', {num(w)})" for g, w in REG.groups.items())
CRITERIA_VALUES = ", ".join(
    f"('{c.key}', '{c.group}', {num(c.weight)}, '{'bands' if c.bands else 'codes'}', '{c.layer}')" for c in REG.criteria
)
BAND_VALUES = ", ".join(
    f"('{c.key}', {pos}, {num(hi)}, {num(s)})" for c in REG.criteria for pos, (hi, s) in enumerate(c.bands)
)
VERSIONS_SQL = f"""
g0(group_key, group_weight) AS (VALUES {GROUP_VALUES}),
c0(key, group_key, local_weight, kind, layer) AS (VALUES {CRITERIA_VALUES}),
gs AS (SELECT s_suppkey AS version, group_key,
    group_weight + CASE WHEN s_suppkey % 10 = 3 AND group_key = 'economic' THEN 0.01e0 ELSE 0e0 END AS group_weight FROM supplier, g0),
cs AS (SELECT s_suppkey AS version, key,
    CASE WHEN s_suppkey % 10 = 4 AND key = 'lulc' THEN 'other' ELSE group_key END AS group_key,
    local_weight + CASE WHEN s_suppkey % 10 = 5 AND key = 'slope' THEN 0.05e0 ELSE 0e0 END AS local_weight FROM supplier, c0)"""


def versions(spark, sf_dir):
    tables = rg.registry_rows(REG)
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("version"))
    digit = F.col("version") % 10

    def each(table_rows):
        """Every registry row for every owner: the rows travel as one array literal, no join."""
        ddl, rows = table_rows
        names = [column.split(" ")[0] for column in ddl.split(", ")]
        items = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))
        return owners.select("version", F.inline(items))

    groups = each(tables["groups"]).withColumn(
        "group_weight",
        F.col("group_weight") + F.when((digit == 3) & (F.col("group_key") == "economic"), F.lit(0.01)).otherwise(F.lit(0.0)),
    )
    criteria = (
        each(tables["criteria"])
        .withColumn("group_key", F.when((digit == 4) & (F.col("key") == "lulc"), F.lit("other")).otherwise(F.col("group_key")))
        .withColumn(
            "local_weight",
            F.col("local_weight") + F.when((digit == 5) & (F.col("key") == "slope"), F.lit(0.05)).otherwise(F.lit(0.0)),
        )
    )
    breakpoints = each(tables["breakpoints"]).withColumns(
        {
            "hi": F.when((digit == 6) & (F.col("key") == "slope") & (F.col("pos") == 1), F.lit(4.0)).otherwise(F.col("hi")),
            "score": F.when((digit == 7) & (F.col("key") == "humidity") & (F.col("pos") == 0), F.lit(1.5)).otherwise(F.col("score")),
        }
    )
    return groups, criteria, breakpoints


@query(
    "s15_registry_tables",
    f"WITH {cells_sql()},\nc0(key, group_key, local_weight, kind, layer) AS (VALUES {CRITERIA_VALUES}),\nn AS ("
    + " UNION ALL ".join(f"SELECT '{c.key}' AS key, count({c.layer}) AS values_present FROM cells" for c in REG.criteria)
    + ") SELECT key, group_key, local_weight, kind, values_present FROM c0 JOIN n USING (key)",
)
def s15_registry_tables(spark, sf_dir):
    """Registry dimension joined to how many cells carry a value for each criterion."""
    counts = cells(spark, sf_dir, *(c.layer for c in REG.criteria)).agg(
        F.array(
            *(F.struct(F.lit(c.key).alias("key"), F.count(c.layer).alias("values_present")) for c in REG.criteria)
        ).alias("a")
    )
    criteria = rg.registry_tables(spark, REG)["criteria"].select("key", "group_key", "local_weight", "kind")
    return counts.select(F.inline("a")).join(F.broadcast(criteria), "key").select(
        "key", "group_key", "local_weight", "kind", "values_present"
    )


@query(
    "p43_global_weights",
    f"WITH {VERSIONS_SQL} SELECT version, key, group_key, group_weight * local_weight AS global_weight FROM cs JOIN gs USING (version, group_key)",
)
def p43_global_weights(spark, sf_dir):
    groups, criteria, _ = versions(spark, sf_dir)
    return rg.global_weights(criteria, groups, ["version"]).select("version", "key", "group_key", "global_weight")


@query(
    "j2_unknown_groups",
    f"WITH {VERSIONS_SQL} SELECT version, key, group_key FROM cs WHERE (version, group_key) NOT IN (SELECT (version, group_key) FROM gs)",
)
def j2_unknown_groups(spark, sf_dir):
    groups, criteria, _ = versions(spark, sf_dir)
    return rg.unknown_groups(criteria, groups, ["version"]).select("version", "key", "group_key")


@query(
    "a16_weight_sums",
    f"""WITH {VERSIONS_SQL}, t AS (
  SELECT version, 'group_sum' AS rule, 'all' AS scope, sum(group_weight) AS total FROM gs GROUP BY 1
  UNION ALL SELECT version, 'local_sum', group_key, sum(local_weight) FROM cs GROUP BY 1, 3
  UNION ALL SELECT version, 'global_sum', 'all', sum(group_weight * local_weight) FROM cs JOIN gs USING (version, group_key) GROUP BY 1)
SELECT version, rule, scope, round(total, 9) AS total FROM t WHERE abs(total - 1) > 1e-6""",
)
def a16_weight_sums(spark, sf_dir):
    groups, criteria, _ = versions(spark, sf_dir)
    return rg.weight_violations(criteria, groups, ["version"]).withColumn("total", F.round("total", 9))


@query(
    "a17_band_order",
    f"""WITH b0(key, pos, hi, score) AS (VALUES {BAND_VALUES}),
b AS (SELECT s_suppkey AS version, key, pos,
    CASE WHEN s_suppkey % 10 = 6 AND key = 'slope' AND pos = 1 THEN 4e0 ELSE hi END AS hi,
    CASE WHEN s_suppkey % 10 = 7 AND key = 'humidity' AND pos = 0 THEN 1.5e0 ELSE score END AS score FROM supplier, b0),
w AS (SELECT *, lag(hi) OVER (PARTITION BY version, key ORDER BY pos) AS prev FROM b)
SELECT version, key, CAST(pos AS INTEGER) AS pos, 'order' AS rule FROM w WHERE hi <= prev
UNION ALL SELECT version, key, CAST(pos AS INTEGER), 'score_range' FROM w WHERE score < 0 OR score > 1
UNION ALL SELECT s_suppkey, 'slope', NULL, 'exclusion_weight' FROM supplier WHERE s_suppkey % 10 = 8""",
)
def a17_band_order(spark, sf_dir):
    """Bands out of order or range, and a criterion that excludes: with a weight in one version of ten, without in another."""
    _, criteria, bands = versions(spark, sf_dir)
    digit, slope = F.col("version") % 10, F.col("key") == "slope"
    weighted = criteria.withColumns({
        "kind": F.when(slope & digit.isin(8, 9), F.lit("hard_exclusion")).otherwise(F.col("kind")),
        "local_weight": F.when(slope & (digit == 9), F.lit(0.0)).otherwise(F.col("local_weight")),
    })
    excluded = rg.exclusion_weight_violations(weighted).select("version", "key", F.lit(None).cast("int").alias("pos"), F.lit("exclusion_weight").alias("rule"))
    return rg.band_violations(bands, ["version"]).unionByName(excluded)


# ---- scoring ---------------------------------------------------------------------------


@query(
    "p1_breakpoint_reclassify",
    f"WITH {cells_sql('slope', 'temperature', 'humidity', 'wind_speed', 'shadow')} SELECT scene_id, row, col, "
    + ", ".join(f"{bands_sql(k, k)} AS s_{k}" for k in ("slope", "temperature", "humidity", "wind_speed", "shadow"))
    + " FROM cells",
)
def p1_breakpoint_reclassify(spark, sf_dir):
    keys = ("slope", "temperature", "humidity", "wind_speed", "shadow")
    return cells(spark, sf_dir, *keys).select(
        *CELL, *(band_score(F.col(k), REG.criterion(k).bands).alias(f"s_{k}") for k in keys)
    )


@query(
    "p2_class_score_reclassify",
    f"WITH {cells_sql('lulc', 'land_capability')} SELECT scene_id, row, col, {score_sql('lulc')} AS s_lulc, "
    f"{score_sql('land_capability')} AS s_land FROM cells",
)
def p2_class_score_reclassify(spark, sf_dir):
    df = cells(spark, sf_dir, "lulc", "land_capability")
    return df.select(
        *CELL,
        code_score(F.col("lulc").cast("string"), REG.criterion("lulc").codes).alias("s_lulc"),
        code_score(F.col("land_capability"), REG.criterion("land_capability").codes).alias("s_land"),
    )


UNIT_SQL = "(['kWh/m2/yr', 'kWh/m2/day', ' KWH/M2/Year ', '', 'MJ/m2'])[CAST(p_partkey % 5 AS INTEGER) + 1]"


@query(
    "p3_unit_conversion",
    f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 IN (0, 2) THEN p_retailprice / 365e0 ELSE p_retailprice END AS daily,
  CASE p_partkey % 5 WHEN 3 THEN 'no unit, assumed daily' WHEN 4 THEN 'unrecognised unit: MJ/m2' END AS note FROM part""",
)
def p3_unit_conversion(spark, sf_dir):
    names = F.array(*(F.lit(u) for u in ("kWh/m2/yr", "kWh/m2/day", " KWH/M2/Year ", "", "MJ/m2")))
    unit = F.element_at(names, (F.col("p_partkey") % 5).cast("int") + 1)
    daily = F.lit("kWh/m2/day")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        units.to_criterion_unit(F.col("p_retailprice"), unit, daily).alias("daily"),
        units.unit_note(unit, daily).alias("note"),
    )


@query(
    "p4_reclassify_layer",
    f"WITH {cells_sql('ghi_annual', 'dist_power')} SELECT scene_id, row, col, {score_sql('solar_radiation')} AS s_solar, "
    f"{score_sql('dist_ptl')} AS s_ptl FROM cells",
)
def p4_reclassify_layer(spark, sf_dir):
    df = cells(spark, sf_dir, "ghi_annual", "dist_power")
    return df.select(
        *CELL,
        score_column(REG.criterion("solar_radiation"), "ghi_annual").alias("s_solar"),
        score_column(REG.criterion("dist_ptl"), "dist_power").alias("s_ptl"),
    )


@query(
    "p5_reclassify_all",
    f"WITH {SCORED_SQL} SELECT scene_id, row, col, " + ", ".join(f"s_{c.key}" for c in REG.criteria) + " FROM scored",
)
def p5_reclassify_all(spark, sf_dir):
    return with_scores(cells(spark, sf_dir), REG).select(*CELL, *(f"s_{c.key}" for c in REG.criteria))


_BANDED = [c.key for c in REG.criteria if c.bands]


@query(
    "j5_value_to_band",
    f"WITH {SCORED_SQL} SELECT key, score, count(*) AS cells FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS key, s_{k} AS score FROM scored WHERE s_{k} IS NOT NULL" for k in _BANDED)
    + ") GROUP BY 1, 2",
)
def j5_value_to_band(spark, sf_dir):
    """Range join to the band table; agrees with the generated expression by the shared check SQL."""
    long = long_layers(cells(spark, sf_dir), REG, CELL)
    return score_by_bands(long, rg.registry_tables(spark, REG)["breakpoints"]).groupBy("key", "score").agg(
        F.count("*").alias("cells")
    )


_CODED = [c.key for c in REG.criteria if c.codes]


@query(
    "j6_code_to_score",
    f"WITH {SCORED_SQL} SELECT key, score, count(*) AS cells FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS key, s_{k} AS score FROM scored WHERE s_{k} IS NOT NULL" for k in _CODED)
    + ") GROUP BY 1, 2",
)
def j6_code_to_score(spark, sf_dir):
    long = long_layers(cells(spark, sf_dir), REG, CELL)
    return score_by_codes(long, rg.registry_tables(spark, REG)["class_scores"]).groupBy("key", "score").agg(
        F.count("*").alias("cells")
    )


# ---- exclusions ------------------------------------------------------------------------


@query(
    "p12_land_cover_exclusion",
    f"WITH {cells_sql('lulc', 'protected')} SELECT scene_id, row, col, (lulc IN (50, 80) OR protected) AS excluded FROM cells",
)
def p12_land_cover_exclusion(spark, sf_dir):
    df = cells(spark, sf_dir, "lulc", "protected")
    return df.select(*CELL, (exclusions.land_cover_excluded(F.col("lulc")) | F.col("protected")).alias("excluded"))


_RULES = {
    "excl_wdpa": "protected",
    "excl_water": "lulc = 80",
    "excl_urban_core": "lulc = 50",
    "excl_urban_buffer": "dist_urban < 1500",
    "excl_slope": "slope > 20",
    "excl_road_buffer": "dist_roads < 150",
    "excl_railway_buffer": "dist_railway < 150",
    "excl_ptl_buffer": "dist_power < 4800",
}


@query(
    "p13_distance_slope_exclusions",
    f"WITH {cells_sql()} SELECT scene_id, "
    + ", ".join(f"count(*) FILTER (WHERE {sql}) AS {k}" for k, sql in _RULES.items())
    + " FROM cells GROUP BY 1",
)
def p13_distance_slope_exclusions(spark, sf_dir):
    df = cells(spark, sf_dir)
    rules = exclusions.rule_columns(df.columns, REG)
    return df.groupBy("scene_id").agg(*(F.count_if(c).alias(k) for k, c in rules.items()))


@query(
    "p14_mask_union",
    f"WITH {cells_sql('slope', 'dist_roads', 'aspect_class')} SELECT scene_id, row, col, "
    "(coalesce(slope > 20, false) OR coalesce(dist_roads < 150, false) OR aspect_class <> 0) AS excluded FROM cells",
)
def p14_mask_union(spark, sf_dir):
    """Rule masks and a numeric mask of unknown name (non-zero excludes)."""
    df = cells(spark, sf_dir, "slope", "dist_roads", "aspect_class")
    masks = {**exclusions.rule_columns(df.columns, REG), "custom": exclusions.nonzero(F.col("aspect_class"))}
    assert exclusions.unknown_masks(masks, REG) == ["custom"]
    return df.select(*CELL, exclusions.any_of(masks).alias("excluded"))


@query(
    "p15_apply_exclusions",
    f"WITH {LSI_SQL} SELECT scene_id, row, col, round(lsi, 9) AS lsi, round(CASE WHEN excluded THEN 0e0 ELSE lsi_raw END, 9) AS lsi_zero FROM lsi",
)
def p15_apply_exclusions(spark, sf_dir):
    df = score_cells(cells(spark, sf_dir), REG)
    zero = exclusions.apply_exclusions(F.col("lsi_raw"), F.col("excluded"), 0.0)
    return df.select(*CELL, F.round("lsi", 9).alias("lsi"), F.round(zero, 9).alias("lsi_zero"))


@query(
    "u2_mask_union_counts",
    f"WITH {SCORED_SQL} SELECT scene_id, count(*) FILTER (WHERE excluded) AS excluded_cells FROM scored GROUP BY 1",
)
def u2_mask_union_counts(spark, sf_dir):
    return exclusions.with_excluded(cells(spark, sf_dir), REG).groupBy("scene_id").agg(
        F.count_if("excluded").alias("excluded_cells")
    )


# ---- overlay and classes ---------------------------------------------------------------


@query(
    "p16_weighted_overlay",
    f"WITH {LSI_SQL} SELECT scene_id, row, col, round(lsi_raw, 9) AS lsi FROM lsi",
)
def p16_weighted_overlay(spark, sf_dir):
    scored = with_scores(cells(spark, sf_dir), REG)
    return overlay.with_lsi(scored, REG).select(*CELL, F.round("lsi", 9).alias("lsi"))


_PARTIAL = ("slope", "solar_radiation", "lulc", "dist_roads")


@query(
    "j3_u3_partial_criteria",
    f"WITH {SCORED_SQL} SELECT scene_id, row, col, round({lsi_sql({c.key: WEIGHTS[c.key] for c in REG.criteria if c.key in _PARTIAL})}, 9) AS lsi, "
    f"{len(REG.criteria) - len(_PARTIAL)} AS missing_criteria FROM scored",
)
def j3_u3_partial_criteria(spark, sf_dir):
    """Only four layers present: weights are shared among them; the rest is reported."""
    df = cells(spark, sf_dir, *(REG.criterion(k).layer for k in _PARTIAL))
    missing = overlay.missing_criteria(df.columns, REG)
    return overlay.with_lsi(with_scores(df, REG), REG).select(
        *CELL, F.round("lsi", 9).alias("lsi"), F.lit(len(missing)).alias("missing_criteria")
    )


@query(
    "u3_missing_criteria",
    f"WITH {cells_sql('slope', 'lulc')}, c0(key, group_key, local_weight, kind, layer) AS (VALUES {CRITERIA_VALUES}),"
    " have AS (SELECT 'slope' AS layer, count(slope) AS n FROM cells UNION ALL SELECT 'lulc', count(lulc) FROM cells)"
    " SELECT key, group_key FROM c0 WHERE layer NOT IN (SELECT layer FROM have WHERE n > 0)",
)
def u3_missing_criteria(spark, sf_dir):
    """Registry minus the layers that hold at least one value."""
    df = cells(spark, sf_dir, "slope", "lulc")
    have = df.agg(
        F.array(*(F.struct(F.lit(c).alias("layer"), F.count(c).alias("n")) for c in ("slope", "lulc"))).alias("a")
    ).select(F.inline("a")).filter("n > 0")
    return rg.registry_tables(spark, REG)["criteria"].join(have, "layer", "left_anti").select("key", "group_key")


@query(
    "a8_equal_interval_bounds",
    f"WITH {LSI_SQL},{EQUAL_BOUNDS_SQL} SELECT scene_id, round(b[1], 9) AS b1, round(b[2], 9) AS b2, round(b[3], 9) AS b3, round(b[4], 9) AS b4 FROM bounds",
)
def a8_equal_interval_bounds(spark, sf_dir):
    return _bounds(overlay.equal_interval_bounds(score_cells(cells(spark, sf_dir), REG), ["scene_id"]))


def _bounds(df):
    return df.select("scene_id", *(F.round(F.col("bounds")[i], 9).alias(f"b{i + 1}") for i in range(4)))


@query(
    "a7_quantile_bounds",
    f"WITH {LSI_SQL},{QUANTILE_BOUNDS_SQL} SELECT scene_id, round(b[1], 9) AS b1, round(b[2], 9) AS b2, round(b[3], 9) AS b3, round(b[4], 9) AS b4 FROM bounds",
)
def a7_quantile_bounds(spark, sf_dir):
    return _bounds(overlay.quantile_bounds(score_cells(cells(spark, sf_dir), REG), ["scene_id"]))


@query(
    "a7_quantiles_continuous",
    """SELECT l_returnflag, q, round(v, 6) AS threshold FROM (
  SELECT l_returnflag, unnest([0, 1, 2, 3, 4]) AS q, unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.9, 1.0])) AS v
  FROM lineitem GROUP BY 1)""",
)
def a7_quantiles_continuous(spark, sf_dir):
    """Exact quantiles of a column with mostly distinct values, three large groups."""
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return quantiles(df, ["l_returnflag"], "l_extendedprice", [0.0, 0.25, 0.5, 0.9, 1.0]).withColumn(
        "threshold", F.round("threshold", 6)
    )


@query("p17_classify_equal_interval", f"WITH {EQUAL_SQL} SELECT scene_id, row, col, lsi_class FROM classed")
def p17_classify_equal_interval(spark, sf_dir):
    return classified_cells(cells(spark, sf_dir), REG).select(*CELL, "lsi_class")


@query("p17_classify_quantile", f"WITH {QUANTILE_SQL} SELECT scene_id, row, col, lsi_class FROM classed")
def p17_classify_quantile(spark, sf_dir):
    return classified_cells(cells(spark, sf_dir), REG, "quantile").select(*CELL, "lsi_class")


@query(
    "a9_class_distribution",
    f"WITH {EQUAL_SQL},{DIST_SQL} SELECT d.scene_id, class_id, {LABEL_SQL} AS label, cells, pct, "
    "cells * 0.25e0 AS area_km2_cells, round(pct / 100e0 * (n.total * 0.25e0), 2) AS area_km2_scaled "
    "FROM dist d JOIN (SELECT scene_id, count(*) AS total FROM classed GROUP BY 1) n USING (scene_id)",
)
def a9_class_distribution(spark, sf_dir):
    classified = classified_cells(cells(spark, sf_dir), REG)
    dist = overlay.class_distribution(classified, ["scene_id"], REG)
    area = classified.groupBy("scene_id").agg((F.count("*") * 0.25).alias("scene_area"))
    return overlay.with_class_areas(dist.join(area, "scene_id"), F.lit(0.25), F.col("scene_area")).drop("scene_area")


@query(
    "a10_exclusion_summary",
    f"WITH {LSI_SQL} SELECT scene_id, count(*) AS total_cells, count(*) FILTER (WHERE excluded) AS excluded_cells, count(lsi) AS valid_cells, "
    "round(100e0 * count(*) FILTER (WHERE excluded) / count(*), 1) AS excluded_pct FROM lsi GROUP BY 1",
)
def a10_exclusion_summary(spark, sf_dir):
    return overlay.exclusion_summary(score_cells(cells(spark, sf_dir), REG), ["scene_id"])


@query(
    "a11_published_comparison",
    f"""WITH {EQUAL_SQL},{DIST_SQL}, t AS (SELECT scene_id, sum(CASE WHEN class_id = 5 THEN pct ELSE 0 END) AS t1,
  sum(CASE WHEN class_id = 4 THEN pct ELSE 0 END) AS t4 FROM dist GROUP BY 1)
SELECT scene_id, t1 AS top1_pct, round(t1 + t4, 2) AS top2_pct, round(t1 - 24.9e0, 2) AS delta_top1, round(round(t1 + t4, 2) - 24.9e0, 2) AS delta_top2 FROM t""",
)
def a11_published_comparison(spark, sf_dir):
    return comparison(cells(spark, sf_dir), REG)["comparison"]


# ---- weight scenarios ------------------------------------------------------------------

_OVERRIDES_SQL = f"""
c0(key, group_key, local_weight, kind, layer) AS (VALUES {CRITERIA_VALUES}),
ov AS (SELECT s_suppkey AS scenario_id, CAST(s_suppkey % 60 AS DOUBLE) / 100e0 AS w_slope, CAST(s_suppkey % 45 AS DOUBLE) / 50e0 AS w_aspect FROM supplier),
st0 AS (SELECT scenario_id, key, group_key, local_weight AS w, w_slope, w_aspect FROM ov, c0),
st1 AS (SELECT *, CASE WHEN key = 'slope' THEN w_slope WHEN group_key = 'technical'
    THEN greatest(0e0, w - (w_slope - 0.25e0) * w / sum(CASE WHEN group_key = 'technical' AND key <> 'slope' THEN w ELSE 0 END) OVER (PARTITION BY scenario_id)) ELSE w END AS w1 FROM st0),
tot AS (SELECT *, max(CASE WHEN key = 'aspect' THEN w1 END) OVER (PARTITION BY scenario_id) AS old,
    sum(CASE WHEN group_key = 'technical' AND key <> 'aspect' THEN w1 ELSE 0 END) OVER (PARTITION BY scenario_id) AS others FROM st1),
st2 AS (SELECT *, CASE WHEN key = 'aspect' THEN w_aspect WHEN group_key = 'technical' AND others > 1e-9
    THEN greatest(0e0, w1 - (w_aspect - old) * w1 / others) ELSE w1 END AS w2 FROM tot)"""


@query(
    "p44_weight_overrides",
    f"WITH {_OVERRIDES_SQL} SELECT scenario_id, key, round(w2, 9) AS local_weight FROM st2",
)
def p44_weight_overrides(spark, sf_dir):
    """A scenario per supplier: slope, then an unknown key, then aspect are overridden in turn."""
    k = F.col("s_suppkey")
    changes = F.array(
        F.struct(F.lit("slope").alias("key"), ((k % 60).cast("double") / 100.0).alias("weight")),
        F.struct(F.lit("not_a_criterion").alias("key"), F.lit(0.5).alias("weight")),
        F.struct(F.lit("aspect").alias("key"), ((k % 45).cast("double") / 50.0).alias("weight")),
    )
    weights = overlay.override_weights(overlay.registry_weight_array(REG), changes)
    return table(spark, sf_dir, "supplier").select(k.alias("scenario_id"), F.inline(weights)).select(
        "scenario_id", "key", F.round("w", 9).alias("local_weight")
    )


_SCENARIOS = {
    "base": WEIGHTS,
    "flat": {k: 1.0 for k in WEIGHTS},
    "sun": {k: (5.0 if k == "solar_radiation" else 1.0) for k in WEIGHTS},
}


@query(
    "p44_scenario_overlay",
    f"WITH {SCORED_SQL} "
    + " UNION ALL ".join(
        f"SELECT scene_id, '{n}' AS scenario_id, count(lsi) AS cells, round(avg(lsi), 8) AS mean_lsi, round(max(lsi), 8) AS max_lsi "
        f"FROM (SELECT scene_id, {lsi_sql(w)} AS lsi FROM scored) GROUP BY 1"
        for n, w in _SCENARIOS.items()
    ),
)
def p44_scenario_overlay(spark, sf_dir):
    scored = with_scores(cells(spark, sf_dir), REG)
    rows = F.array(
        *(F.struct(F.lit(n).alias("scenario_id"), F.lit(k).alias("key"), F.lit(w).alias("weight")) for n, ws in _SCENARIOS.items() for k, w in ws.items())
    )
    scenarios = grids(spark, sf_dir).select("scene_id", F.inline(rows))
    return (
        overlay.overlay_scenarios(scored, REG, scenarios)
        .groupBy("scene_id", "scenario_id")
        .agg(
            F.count("lsi").alias("cells"),
            F.round(F.avg("lsi"), 8).alias("mean_lsi"),
            F.round(F.max("lsi"), 8).alias("max_lsi"),
        )
    )


@query(
    "p7_aspect_labels",
    f"WITH {cells_sql('aspect_class')} SELECT scene_id, {ASPECT_SQL} AS label, {score_sql('aspect')} AS score, count(*) AS cells FROM cells GROUP BY 1, 2, 3",
)
def p7_aspect_labels(spark, sf_dir):
    """T4: codes are named before they are scored."""
    df = cells(spark, sf_dir, "aspect_class")
    label = aspect_label(F.col("aspect_class"))
    return (
        df.select("scene_id", label.alias("label"), code_score(label, REG.criterion("aspect").codes).alias("score"))
        .groupBy("scene_id", "label", "score")
        .agg(F.count("*").alias("cells"))
    )
