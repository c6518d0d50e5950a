"""R9 from sources to sites: layers committed one by one, scenes computed again only where their inputs changed.

    layers of sources -> cells (S17, S14) -> optional mask by areas -> classes, sites, energy -> outlines

Scenes do not depend on each other: bounds of classes, regions and ranks are all per scene.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terralux.operators import quality, sites
from terralux.operators.vectors import protected_cells
from terralux.plans.suitability import select_sites
from terralux.registry import Registry
from terralux.session import cut, path_exists
from terralux.sources.rasters import assemble


def within_areas(cells: DataFrame, areas: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells whose centre lies in an area (scene_id, area_id, rings) of their scene; a scene without an area keeps none."""
    return cells.join(protected_cells(areas, grids), ["scene_id", "row", "col"], "left_semi")


def scene_keys(inputs: list[DataFrame], version: str) -> DataFrame:
    """(scene_id, key): a digest of all rows of a scene in all ``inputs``, in any order, and of ``version``.

    One combining aggregate per input: two sums of row hashes and a count, nothing is sorted or gathered.
    """
    parts = []
    for number, rows in enumerate(inputs):
        # A hash skips what is missing, so where a value is missing is hashed too.
        columns = [c for name in sorted(rows.columns) for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
        sums = [F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")).cast("string") for salt in (1, 2)]
        digest = F.concat_ws("|", F.lit(str(number)), F.count("*").cast("string"), *sums)
        parts.append(rows.groupBy("scene_id").agg(digest.alias("part")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("scene_id").agg(F.sha2(F.concat_ws(";", F.lit(version), F.array_sort(F.collect_list("part"))), 256).alias("key"))


def _stored(spark, path: str, schema: StructType) -> DataFrame:
    """All runs of a stored table, with the ``run`` that wrote each row."""
    named = StructType([*schema.fields, StructField("run", StringType())])
    return spark.read.schema(named).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], named)


def refresh_scenes(keys: DataFrame, store: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of all scenes of ``keys`` (scene_id, key): stored ones where the key is known, computed ones elsewhere.

    ``compute`` gets the (scene_id) to compute and returns rows with ``scene_id``. A run adds one folder of rows and then one of
    keys, each of as many files as it has tasks, however many scenes there are. A run that breaks off in between computes those
    scenes again, and rows of former keys or of broken runs are never read. They stay until the store is deleted.
    """
    spark = keys.sparkSession
    keys = cut(keys, "scene-keys").select("scene_id", "key")

    def known() -> DataFrame:
        # Two runs at the same time may both know a key; their rows are the same.
        return _stored(spark, f"{store}/keys", keys.schema).groupBy("scene_id", "key").agg(F.max("run").alias("run"))

    stale = cut(keys.join(known(), ["scene_id", "key"], "left_anti"), "stale-scenes")
    computed = compute(stale.select("scene_id")).join(stale, "scene_id")
    if not stale.isEmpty():
        run = f"run=r{uuid.uuid4().hex}"
        computed.write.parquet(f"{store}/rows/{run}")
        stale.write.parquet(f"{store}/keys/{run}")
    current = cut(keys.join(known(), ["scene_id", "key"]), "current-scenes")
    runs = [r.run for r in current.select("run").distinct().collect()]
    rows = _stored(spark, f"{store}/rows", computed.schema).filter(F.col("run").isin(runs))
    return rows.join(current, ["scene_id", "key", "run"]).drop("key", "run")


def sites_from_sources(
    base: DataFrame,
    grids: DataFrame,
    providers: dict[str, Callable[[], DataFrame] | list[Callable[[], DataFrame]]],
    registry: Registry,
    store: str,
    areas: DataFrame | None = None,
    method: str = "quantile",
    top_k: int | None = sites.TOP_K,
    simplify_tolerance_m: float = 0.0,
) -> dict[str, DataFrame]:
    """Ranked sites with energy and polygons, their notes, the framing of each scene and failed sources.

    ``base`` is (scene_id, row, col, x, y); providers give layers on these cells. ``areas`` keeps the cells inside them.
    Results live below ``store``; a call over the same store computes only scenes whose cells, grid, registry or options changed.
    """
    made, failed = assemble(base, providers)
    cells = made if areas is None else within_areas(made, areas, grids)
    cells = cut(cells, "cells")
    keys = scene_keys([cells, grids.join(cells.select("scene_id").distinct(), "scene_id", "left_semi")], f"{registry!r}|{method}|{top_k}|{simplify_tolerance_m}")

    def compute(stale: DataFrame) -> DataFrame:
        mine = [df.join(stale, "scene_id", "left_semi") for df in (cells, grids)]
        result = select_sites(*mine, registry, method, top_k=top_k)
        return sites.with_outlines(result["sites"], result["members"], mine[1], simplify_tolerance_m)

    found = refresh_scenes(keys, store, compute)
    return {
        "sites": found,
        "notes": quality.site_notes(found, quality.bounds_table(base.sparkSession)),
        "framing": quality.framing_note(found),
        "failed": failed,
    }
