"""Results to storage (K1-K4, K6)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralux.functions.geodesy import with_lonlat
from terralux.operators.overlay import NO_CLASS
from terralux.session import spread

#: Features of a scene that a task writes at most, by their rank.
FILE_FEATURES = 10_000


def write_layer(cells: DataFrame, path: str, name: str, epsg: int | None = None) -> None:
    """K1: one layer as Parquet partitioned by scene, with its EPSG code; classes use -9999 for missing."""
    value = F.coalesce(F.col(name), F.lit(NO_CLASS)) if name == "lsi_class" else F.col(name)
    columns = [c for c in ("scene_id", "row", "col", "x", "y") if c in cells.columns]
    code = F.col("epsg") if epsg is None and "epsg" in cells.columns else F.lit(epsg).cast("int")
    # Rebalanced: small scenes are gathered into few files, a hot one is split over several.
    cells.select(*columns, value.alias(name), code.alias("crs_epsg")).hint("rebalance", "scene_id").write.mode("overwrite").partitionBy(
        "scene_id"
    ).parquet(path)


def layer_bounds(cells: DataFrame) -> DataFrame:
    """K2: west, south, east, north of a layer from its cell centres' two extreme corners."""
    box = cells.groupBy("scene_id", "epsg").agg(
        F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy")
    )
    low = with_lonlat(box, "minx", "miny", "epsg", "west", "south")
    return with_lonlat(low, "maxx", "maxy", "epsg", "east", "north").select(
        "scene_id", "west", "south", "east", "north"
    )


def site_features(sites: DataFrame, polygons: DataFrame | None = None) -> DataFrame:
    """K3: one feature document per site; (scene_id, rank, feature)."""
    properties = F.struct(*(c for c in sites.columns if c not in ("epsg", "polygons")))
    if polygons is None:
        geometry = F.struct(
            F.lit("Point").alias("type"), F.array("centroid_lon", "centroid_lat").alias("coordinates")
        )
        joined = sites
    else:
        joined = sites.join(polygons, ["scene_id", "site_id"])
        coordinates = F.transform(
            "polygons", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
        )
        geometry = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))
    return joined.select("scene_id", "rank", F.to_json(feature).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """K3: features as text lines per scene; no site, no line. Files are few bytes but take time, so many tasks write them."""
    placed = features.withColumn("_file", F.expr(f"rank div {FILE_FEATURES}"))
    spread(placed, "scene_id", "_file").select("scene_id", "feature").write.mode("overwrite").partitionBy("scene_id").text(path)


def write_class_csv(distribution: DataFrame, path: str) -> None:
    """K4: class distribution from class 5 to 1 with a header; at most five rows per scene."""
    columns = ["scene_id", "class_id", "label", F.col("pct").alias("pct_of_valid_area"), F.col("area_km2_scaled").alias("area_km2")]
    distribution.select(*columns).sortWithinPartitions("scene_id", F.desc("class_id")).write.mode("overwrite").csv(
        path, header=True
    )


def content_key(source: str, area_hash: str, params: dict[str, object]) -> str:
    """K6: first 16 hex digits of a digest over source, area and sorted parameters."""
    text = f"{source}|{area_hash}|{json.dumps(params, sort_keys=True, separators=(',', ':'))}"
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class ResultStore:
    """K6: results under a path that follows from what they depend on."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, source: str, area_hash: str, params: dict[str, object]) -> str:
        return f"{self.root}/{source}/{content_key(source, area_hash, params)}"

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, source: str, area_hash: str, params: dict[str, object]) -> bool:
        fs, target = self._fs(self.path(source, area_hash, params) + "/_SUCCESS")
        return fs.exists(target)

    def get_or_compute(
        self, source: str, area_hash: str, params: dict[str, object], compute: Callable[[], DataFrame]
    ) -> DataFrame:
        """The stored table, computed and written first when there is none (or only a partial write)."""
        path = self.path(source, area_hash, params)
        if not self.exists(source, area_hash, params):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def invalidate(self, source: str, area_hash: str, params: dict[str, object]) -> None:
        fs, target = self._fs(self.path(source, area_hash, params))
        fs.delete(target, True)
