"""Samples on a regular lattice to grid cells, linear inside, nearest outside.

A cell knows its lattice quad by arithmetic, so one equi-join brings it the four corners.
Each quad is split by the diagonal from its (0,0) to its (1,1) corner; linear fields do not
depend on that choice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralux.session import cut

MIN_SAMPLES = 3


def too_few_samples(samples: DataFrame) -> DataFrame:
    """Scenes with fewer than three samples cannot be interpolated."""
    return samples.groupBy("scene_id").agg(F.count("value").alias("samples")).filter(F.col("samples") < MIN_SAMPLES)


def _quads(samples: DataFrame) -> DataFrame:
    """Lattice samples (scene_id, i, j, x, y, value) to quads with four corners."""
    corner = F.explode(
        F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for dj in (0, 1) for di in (0, 1)))
    )
    spread = samples.select("*", corner.alias("d")).select(
        "scene_id",
        (F.col("i") - F.col("d.di")).alias("qi"),
        (F.col("j") - F.col("d.dj")).alias("qj"),
        (F.col("d.di") + F.col("d.dj") * 2).alias("corner"),
        F.struct("x", "y", F.col("value").alias("v")).alias("p"),
    )
    return spread.groupBy("scene_id", "qi", "qj").agg(
        *(F.max(F.when(F.col("corner") == k, F.col("p"))).alias(f"p{k}") for k in range(4))
    )


def _plane(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    """Barycentric value of (x, y) in the triangle a, b, c."""
    det = (b["y"] - c["y"]) * (a["x"] - c["x"]) + (c["x"] - b["x"]) * (a["y"] - c["y"])
    wa = ((b["y"] - c["y"]) * (x - c["x"]) + (c["x"] - b["x"]) * (y - c["y"])) / det
    wb = ((c["y"] - a["y"]) * (x - c["x"]) + (a["x"] - c["x"]) * (y - c["y"])) / det
    return wa * a["v"] + wb * b["v"] + (1.0 - wa - wb) * c["v"]


def interpolate(cells: DataFrame, samples: DataFrame, lattice: DataFrame) -> DataFrame:
    """``cells`` (scene_id, row, col, x, y, u, v): u, v are lattice coordinates of the centre
    (for example lon, lat); ``lattice`` (scene_id, u0, v0, du, dv, side_i, side_j) describes the
    samples' regular arrangement. Adds ``value``; it is NULL in scenes without a lattice or a sample.
    Where a hole is wider than a quad, the nearest of all samples counts.
    """
    fi, fj = (F.col("u") - F.col("u0")) / F.col("du"), (F.col("v") - F.col("v0")) / F.col("dv")

    def clamp(f: Column, side: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(f).cast("int"), F.col(side) - 2))

    placed = cells.join(lattice, "scene_id", "left").withColumns({"fi": fi, "fj": fj}).withColumns(
        {
            "qi": clamp(F.col("fi"), "side_i"),
            "qj": clamp(F.col("fj"), "side_j"),
            "inside": F.col("fi").between(0, F.col("side_i") - 1) & F.col("fj").between(0, F.col("side_j") - 1),
        }
    )
    joined = placed.join(_quads(samples), ["scene_id", "qi", "qj"], "left")
    x, y = F.col("x"), F.col("y")
    p0, p1, p2, p3 = (F.col(f"p{k}") for k in range(4))
    # Which side of the diagonal p0-p3 the cell is on decides its triangle.
    side = (p3["x"] - p0["x"]) * (y - p0["y"]) - (p3["y"] - p0["y"]) * (x - p0["x"])
    linear = F.when(side <= 0, _plane(x, y, p0, p1, p3)).otherwise(_plane(x, y, p0, p2, p3))

    def reach(p: Column) -> Column:
        return F.when(
            p["v"].isNotNull(), F.struct(((p["x"] - x) ** 2 + (p["y"] - y) ** 2).alias("d"), p["v"].alias("v"))
        )

    nearest = F.array_min(F.array_compact(F.array(*(reach(F.col(f"p{k}")) for k in range(4)))))
    whole = p0["v"].isNotNull() & p1["v"].isNotNull() & p2["v"].isNotNull() & p3["v"].isNotNull()
    keep = [c for c in cells.columns]
    near = joined.withColumn(
        "value", F.when(F.col("inside") & whole, linear).otherwise(nearest["v"])
    ).select(*keep, "value")
    lost = near.filter("value IS NULL").join(samples.filter("value IS NOT NULL").select("scene_id").distinct(), "scene_id", "left_semi")
    far = nearest_samples(lost.select("scene_id", "row", "col", "x", "y").distinct(), samples)
    if far is None:
        return near
    found = far.withColumnRenamed("value", "_far")
    return near.join(found, ["scene_id", "row", "col"], "left").withColumn("value", F.coalesce("value", "_far")).select(*keep, "value")


def nearest_samples(places: DataFrame, samples: DataFrame) -> DataFrame | None:
    """Value of the sample nearest to each place (scene_id, row, col, x, y), for lattices and holes of any size; of equally
    near ones the smallest value. Every place's scene needs a sample with a value. None if there is no place.

    Places look into the squares around their own, whose side starts at the samples' mean spacing. A sample nearer than
    a side cannot lie elsewhere, so a place is settled when its best is that near; the others go on with twice the side.
    """
    known = samples.filter("value IS NOT NULL").select("scene_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("value").alias("v"))
    width, height = F.max("sx") - F.min("sx"), F.max("sy") - F.min("sy")
    spacing = F.greatest(F.sqrt(width * height / F.count("*")), F.greatest(width, height) / F.count("*"))
    sides = cut(known.groupBy("scene_id").agg(F.when(spacing > 0.0, spacing).otherwise(F.lit(1.0)).alias("side")), "spacing")
    known = known.join(sides, "scene_id")
    open_ = cut(places.join(sides, "scene_id"), "holes")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    settled, scale = [], 1.0
    while not open_.isEmpty():

        def square(at: str) -> Column:
            return F.floor(F.col(at) / (F.col("side") * scale))

        asked = open_.select("*", around.alias("d")).withColumns({"qx": square("x") + F.col("d.i"), "qy": square("y") + F.col("d.j")}).drop("d", "side")
        held = known.withColumns({"qx": square("sx"), "qy": square("sy")}).drop("side")
        reach = F.struct(((F.col("sx") - F.col("x")) ** 2 + (F.col("sy") - F.col("y")) ** 2).alias("d"), F.col("v"))
        best = asked.join(held, ["scene_id", "qx", "qy"]).groupBy("scene_id", "row", "col").agg(F.min(reach).alias("best"))
        near_enough = F.sqrt("best.d") <= F.col("side") * (scale * (1.0 - 1e-9))
        tried = cut(open_.join(best, ["scene_id", "row", "col"], "left").withColumn("done", F.coalesce(near_enough, F.lit(False))), "nearest")
        settled.append(tried.filter("done").select("scene_id", "row", "col", F.col("best.v").alias("value")))
        open_ = tried.filter("NOT done").drop("best", "done")
        scale *= 2.0
    return reduce(DataFrame.unionByName, settled) if settled else None
