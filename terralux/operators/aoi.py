"""Areas of interest: polygons in one row each (C2, C4-C8, S1 rules)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.functions import geodesy as g
from terralux.functions.bind import bind
from terralux.operators.validity import topology_faults

# Fixed value: largest area of interest.
MAX_AREA_KM2 = 10000.0


def _rings(polygons: Column) -> Column:
    return F.flatten(polygons)


def _vertices(polygons: Column) -> Column:
    return F.flatten(_rings(polygons))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _net(polygons: Column, measure) -> Column:
    """Sum of a ring measure with outer rings counted up and holes down, whatever their winding."""

    def of_polygon(rings: Column) -> Column:
        return _sum(
            F.transform(rings, lambda ring, i: measure(ring) * F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
        )

    return _sum(F.transform(polygons, of_polygon))


def area_km2(polygons: Column) -> Column:
    """C4."""
    return _net(polygons, lambda ring: F.abs(g.signed_area(g.equal_area_ring(ring)))) / F.lit(1e6)


def _moment(name: str):
    def measure(ring: Column) -> Column:
        m = g.centroid_moments(ring)
        return m[name] * F.signum(m["area"])

    return measure


def with_measures(aois: DataFrame) -> DataFrame:
    """Adds bounds (C6), area (C4), centroid and working zone (C2), and the outline hash.

    Everything happens inside the row: an outline is never exploded or shuffled.
    """
    p = F.col("polygons")
    xs = F.transform(_vertices(p), lambda v: v["x"])
    ys = F.transform(_vertices(p), lambda v: v["y"])
    total = _net(p, _moment("area"))
    return (
        bind(
            aois,
            {
                "minx": F.array_min(xs),
                "miny": F.array_min(ys),
                "maxx": F.array_max(xs),
                "maxy": F.array_max(ys),
                "area_km2": area_km2(p),
                "centroid_lon": _net(p, _moment("mx")) / F.nullif(total, F.lit(0.0)),
                "centroid_lat": _net(p, _moment("my")) / F.nullif(total, F.lit(0.0)),
                "hash": F.sha2(F.to_json(F.struct(p.alias("coordinates"))), 256),
            },
        )
        .withColumn("epsg", g.utm_epsg(F.col("centroid_lon"), F.col("centroid_lat")))
    )


def with_faults(aois: DataFrame) -> DataFrame:
    """Adds ``faults``, the names of the rules an area breaks (empty when valid).

    Expects the columns of :func:`with_measures` plus ``doc_fault`` from the parser. Outlines are
    searched by their sides; only the areas at fault come back to be joined.
    """
    broken = topology_faults(aois.select("aoi_id", "polygons")).groupBy("aoi_id").agg(F.array_sort(F.collect_set("fault")).alias("_broken"))
    rules = F.concat(
        F.array(F.col("doc_fault")),
        F.coalesce("_broken", F.array().cast("array<string>")),
        F.array(F.when(F.col("area_km2") > MAX_AREA_KM2, F.lit("too_large"))),
    )
    return bind(aois.join(broken, "aoi_id", "left"), {"faults": F.array_compact(rules)}).drop("_broken")


def project_extent(aois: DataFrame) -> DataFrame:
    """C9 input: extent of the outline's vertices in its working zone.

    Vertices are exploded here because the projection runs in several steps; the regroup
    combines on the map side, so one area with very many vertices is no hot spot.
    """
    points = aois.select("aoi_id", "epsg", F.explode(_vertices(F.col("polygons"))).alias("v")).select(
        "aoi_id", "epsg", F.col("v.x").alias("lon"), F.col("v.y").alias("lat")
    )
    return (
        g.with_utm(points, "lon", "lat", "epsg")
        .groupBy("aoi_id", "epsg")
        .agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    )
