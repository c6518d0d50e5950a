"""Hand-sized cases with known results, and brute-force twins of the spatial operators."""

from __future__ import annotations

import json
import math
import subprocess
import sys
from collections import deque
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from terralux import registry as rg
from terralux.functions import finance, geodesy, losses, text
from terralux.operators import aoi, components, energy, interpolate, numbering, overlay, pairwise, polygons
from terralux.operators import proximity, quality, quantiles, reclassify, rooftop, sites, terrain, uncertainty, vectors
from terralux.operators import grids
from terralux.operators.grids import snap_grid
from terralux.session import cut, scratch_path
from terralux.sources import documents as doc
from terralux.sources import rasters

REG = rg.load_registry()


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def one(df):
    return df.first().asDict()


def cells_of(spark, grid, **layers):
    r, c = np.indices(grid).reshape(2, -1)
    pdf = pd.DataFrame({"scene_id": "a", "row": r.astype("int32"), "col": c.astype("int32"), **{k: v.ravel() for k, v in layers.items()}})
    return spark.createDataFrame(pdf).withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")})


def grid_row(spark, height, width, resolution=1000):
    return frame(
        spark, [("a", 500000.0, 3500000.0, resolution, 32636, height, width)],
        "scene_id STRING, minx DOUBLE, maxy DOUBLE, resolution_m INT, epsg INT, height INT, width INT",
    )


# ---- registry, scoring -----------------------------------------------------------------


def test_registry_weights():
    weights = REG.global_weights()
    assert len(weights) == 13
    assert math.isclose(sum(weights.values()), 1.0)
    assert math.isclose(weights["shadow"] + weights["land_capability"], 0.1125)


def test_registry_errors(tmp_path):
    bad = tmp_path / "bad.yaml"
    bad.write_text("groups: {a: {weight: 1}}\ncriteria: [{key: k, group: b, weight: 1, unit: x, layer: l, bands: [[1, 1]]}]\nexclusions: []\nclasses: {}\n")
    with pytest.raises(rg.RegistryError, match="unknown group"):
        rg.load_registry(bad)
    bad.write_text("groups: {}\n")
    with pytest.raises(rg.RegistryError, match="missing sections"):
        rg.load_registry(bad)


def test_band_edges(spark):
    df = frame(spark, [(None,), (5.0,), (5.0001,), (20.0,), (99.0,)], "v DOUBLE")
    got = [r.s for r in df.select(reclassify.band_score(F.col("v"), REG.criterion("slope").bands).alias("s")).collect()]
    assert got == [None, 1.0, 0.75, 0.1, 0.0]
    open_ended = [r.s for r in df.select(reclassify.band_score(F.col("v"), ((5.0, 1.0),)).alias("s")).collect()]
    assert open_ended == [None, 1.0, 0.0, 0.0, 0.0]


def test_aspect_codes_are_named_first(spark):
    df = frame(spark, [(0,), (1,), (5,), (180,), (None,)], "aspect_class INT")
    score = reclassify.score_column(REG.criterion("aspect"), "aspect_class")
    assert [r.s for r in df.select(score.alias("s")).collect()] == [1.0, 0.0, 1.0, 1.0, None]
    raw = reclassify.code_score(F.col("aspect_class").cast("string"), REG.criterion("aspect").codes)
    assert [r.s for r in df.select(raw.alias("s")).collect()] == [0.0, 0.0, 0.0, 0.0, None]


def test_overlay_shares_weights_of_missing_scores(spark):
    df = frame(spark, [(1.0, 0.0), (1.0, None), (None, None)], "s_slope DOUBLE, s_lulc DOUBLE")
    got = [r.lsi for r in df.selectExpr(overlay.overlay_text({"slope": "s_slope", "lulc": "s_lulc"}, {"slope": 0.3, "lulc": 0.2}) + " AS lsi").collect()]
    assert got == [0.6, 1.0, None]
    with pytest.raises(ValueError, match="no criterion"):
        overlay.overlay_text({"other": "s_other"}, {"slope": 0.3})


@pytest.mark.parametrize("method", ["equal_interval", "quantile"])
def test_constant_field_is_class_one(spark, method):
    df = frame(spark, [("a", 0.5)] * 9 + [("a", None)], "scene_id STRING, lsi DOUBLE")
    got = [r.lsi_class for r in overlay.classify(df, ["scene_id"], method).collect()]
    assert sorted(got, key=str) == [1] * 9 + [None]


def test_unknown_class_method(spark):
    with pytest.raises(ValueError, match="unknown class method"):
        overlay.classify(frame(spark, [("a", 0.1)], "scene_id STRING, lsi DOUBLE"), ["scene_id"], "other")


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(2.0, size=4001), 2)
    keys = rng.choice(["a", "b", "c"], p=[0.7, 0.29, 0.01], size=4001)
    df = spark.createDataFrame(pd.DataFrame({"k": keys, "v": values}))
    at = [0.0, 0.2, 0.4, 0.5, 0.8, 1.0]
    for r in quantiles.quantiles(df, ["k"], "v", at).collect():
        assert math.isclose(r.threshold, np.quantile(values[keys == r.k], at[r.q]), abs_tol=1e-12)


def test_quantiles_of_any_magnitude(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([np.zeros(40), -np.zeros(5), 2.0 ** rng.integers(-80, 80, 300), -(2.0 ** rng.integers(-80, 80, 200)), [1e-320, -1e-310, 1.7e308, -1.7e308], np.nextafter(8.0, 0.0) * np.ones(9)])
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(1, None), (2, None), (3, 5.0)], "k INT, v DOUBLE")
    at = [0.0, 0.07, 0.35, 0.5, 0.77, 0.93, 1.0]
    got = {(r.k, r.q): r.threshold for r in quantiles.quantiles(df, ["k"], "v", at, stored=True).collect()}
    assert {k for k, _ in got} == {1, 3} and all(got[3, q] == 5.0 for q in range(7))
    assert all(math.isclose(got[1, q], np.quantile(values, at[q]), rel_tol=1e-12, abs_tol=1e-300) for q in range(1, 6))


# ---- geometry --------------------------------------------------------------------------

RING = [[27.0, 31.0], [28.0, 31.0], [28.0, 31.5], [27.0, 31.5], [27.0, 31.0]]


def area_docs(spark, *documents):
    return frame(spark, [(i, json.dumps(d)) for i, d in enumerate(documents)], "aoi_id INT, text STRING")


def test_demo_area(spark):
    parsed = doc.parse_areas(area_docs(spark, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [RING]}}))
    measured = aoi.with_faults(aoi.with_measures(parsed))
    row = one(measured)
    assert row["faults"] == [] and row["epsg"] == 32635
    assert math.isclose(row["area_km2"], 5280.58, abs_tol=0.01)
    grid = one(snap_grid(aoi.project_extent(measured), F.lit(500)))
    assert (grid["width"], grid["height"]) == (191, 112)


def test_area_with_hole_and_parts(spark):
    hole = [[27.4, 31.2], [27.4, 31.3], [27.6, 31.3], [27.6, 31.2], [27.4, 31.2]]
    far = [[x + 2.0, y] for x, y in RING]
    docs = area_docs(
        spark,
        {"type": "Polygon", "coordinates": [RING]},
        {"type": "Polygon", "coordinates": [RING, hole]},
        {"type": "MultiPolygon", "coordinates": [[RING], [far]]},
    )
    a = {r.aoi_id: r.area_km2 for r in aoi.with_measures(doc.parse_areas(docs)).collect()}
    assert a[1] < a[0] and math.isclose(a[2], 2 * a[0], rel_tol=1e-9)


def test_rejected_documents(spark):
    bow = [RING[0], RING[2], RING[1], RING[3], RING[0]]
    docs = area_docs(
        spark,
        {"type": "Polygon", "coordinates": [bow]},
        {"type": "Point", "coordinates": [1, 2]},
        {"type": "FeatureCollection", "features": []},
        {"type": "Feature", "geometry": None},
        {"type": "Polygon", "coordinates": [[[0, 0], [5, 0], [5, 5], [0, 5], [0, 0]]]},
    )
    got = {r.aoi_id: r.faults for r in aoi.with_faults(aoi.with_measures(doc.parse_areas(docs))).collect()}
    assert got == {0: ["self_intersection"], 1: ["unsupported_type"], 2: ["not_one_feature"], 3: ["null_geometry"], 4: ["too_large"]}


def test_projection_known_points(spark):
    df = frame(spark, [(27.0, 31.0, 32635), (18.4, -33.9, 32734)], "lon DOUBLE, lat DOUBLE, epsg INT")
    rows = geodesy.with_utm(df, "lon", "lat", "epsg").collect()
    assert math.isclose(rows[0].x, 500000.0, abs_tol=1e-6)
    back = geodesy.with_lonlat(geodesy.with_utm(df, "lon", "lat", "epsg"), "x", "y", "epsg", "lon2", "lat2").collect()
    for r in back:
        assert math.isclose(r.lon, r.lon2, abs_tol=1e-9) and math.isclose(r.lat, r.lat2, abs_tol=1e-9)


# ---- terrain, distance, regions --------------------------------------------------------


@pytest.mark.parametrize(
    ("plane", "aspect"),
    [((0, 1), 7), ((0, -1), 3), ((1, 0), 1), ((-1, 0), 5), ((0, 0), 0), ((-1, -1), 4), ((1, 1), 8)],
)
def test_planes(spark, plane, aspect):
    r, c = np.indices((6, 7))
    z = (plane[0] * r + plane[1] * c) * 10.0
    df = terrain.slope_aspect(cells_of(spark, (6, 7), elevation=z), ["scene_id"], F.lit(100.0)).toPandas()
    assert set(df.aspect_class) == {aspect}
    assert np.allclose(df.slope, math.degrees(math.atan(math.hypot(*plane) * 0.1)))


def test_slope_across_blocks_matches_numpy(spark, monkeypatch):
    monkeypatch.setattr("terralux.operators.stencil.BLOCK", 5)
    z = np.random.default_rng(5).normal(size=(17, 23)) * 50
    df = terrain.slope_aspect(cells_of(spark, z.shape, elevation=z), ["scene_id"], F.lit(100.0)).toPandas()
    gy, gx = np.gradient(z, 100.0)
    want = np.degrees(np.arctan(np.hypot(gx, gy)))
    assert len(df) == z.size
    assert np.allclose(df.slope, want[df.row, df.col])


def test_distance_single_feature_and_none(spark):
    flag = np.zeros((5, 5), dtype=bool)
    flag[0, 0] = True
    df = proximity.distances(cells_of(spark, (5, 5), is_a=flag, is_b=np.zeros((5, 5), dtype=bool)), ["is_a", "is_b"], F.lit(100)).toPandas()
    at = {(r.row, r.col): r.dist_a for r in df.itertuples()}
    assert (at[0, 0], at[0, 1], at[0, 2]) == (0.0, 100.0, 200.0)
    assert math.isclose(at[1, 1], 100 * math.sqrt(2))
    assert df.dist_b.isna().all()


def test_distance_brute_force(spark):
    rng = np.random.default_rng(7)
    for density in (0.001, 0.02, 0.3):
        flag = rng.random((70, 90)) < density
        flag[3, 4] = True
        df = proximity.distances(cells_of(spark, flag.shape, is_a=flag), ["is_a"], F.lit(10)).toPandas()
        fr, fc = np.nonzero(flag)
        want = np.sqrt(((df.row.to_numpy()[:, None] - fr) ** 2 + (df.col.to_numpy()[:, None] - fc) ** 2).min(axis=1)) * 10
        assert np.abs(want - df.dist_a).max() == 0.0


def flood(mask):
    label = {}
    for r, c in zip(*np.nonzero(mask), strict=True):
        if (r, c) in label:
            continue
        root, todo = (int(r) << 24) + int(c), deque([(r, c)])
        label[r, c] = root
        while todo:
            a, b = todo.popleft()
            for n in [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in label:
                    label[n] = root
                    todo.append(n)
    return label


@pytest.mark.parametrize("density", [0.42, 0.6])
def test_regions_match_flood_fill(spark, monkeypatch, density):
    monkeypatch.setattr(components, "BLOCK", 16)
    mask = np.random.default_rng(11).random((60, 75)) < density
    df = components.region_cells(cells_of(spark, mask.shape, m=mask).filter("m").drop("m")).toPandas()
    want = flood(mask)
    assert len(df) == len(want)
    assert all(want[r.row, r.col] == r.region for r in df.itertuples())


def classified(spark, shape, where):
    cls = np.ones(shape, dtype="int32")
    for rows, cols in where:
        cls[rows, cols] = 5
    df = cells_of(spark, shape, lsi_class=cls, lsi=np.where(cls == 5, 0.9, 0.1))
    return df.withColumns({"x": 500500.0 + F.col("col") * 1000.0, "y": 3499500.0 - F.col("row") * 1000.0})


def test_two_blobs(spark):
    df = classified(spark, (5, 10), [(slice(0, 2), slice(0, 2)), (slice(3, 5), slice(7, 10))])
    got = sites.extract_sites(df, grid_row(spark, 5, 10)).orderBy("rank").collect()
    assert [(r.site_id, r.area_km2) for r in got] == [(2, 6.0), (1, 4.0)]
    assert [r.area_km2 for r in sites.extract_sites(df, grid_row(spark, 5, 10), min_area_km2=5).collect()] == [6.0]


def test_cap_split_keeps_area(spark):
    df = classified(spark, (30, 30), [(slice(0, 30), slice(0, 30))])
    got = sites.extract_sites(df, grid_row(spark, 30, 30), max_site_area_km2=50.0, top_k=None).collect()
    assert len(got) > 1 and sum(r.area_km2 for r in got) == 900.0
    assert max(r.area_km2 for r in got) <= 50.0
    assert sorted(r.site_id for r in got) == list(range(1, len(got) + 1))


def test_tile_side_rounding(spark):
    df = spark.range(1)
    side = {s: one(df.select(sites.tile_side(7.0, F.lit(1.0), s).alias("s")))["s"] for s in (False, True)}
    assert side == {False: 3, True: 2}


def test_small_region_is_not_split(spark):
    df = classified(spark, (5, 5), [(slice(0, 5), slice(0, 5))])
    assert [r.area_km2 for r in sites.extract_sites(df, grid_row(spark, 5, 5), max_site_area_km2=50.0).collect()] == [25.0]


def test_numbering_by_levels(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.integers(0, 9, (400, 3)), columns=["a", "b", "c"]).drop_duplicates()
    pdf.insert(0, "k", np.where(pdf.a % 2 == 0, "x", "y"))
    got = numbering.hierarchical_row_number(spark.createDataFrame(pdf), ["k"], ["a", "b", "c"], "n").toPandas()
    for _, part in got.groupby("k"):
        assert list(part.sort_values(["a", "b", "c"]).n) == list(range(1, len(part) + 1))


def test_polygon_with_hole_and_diagonal(spark):
    mask = np.zeros((6, 6), dtype=bool)
    mask[0:3, 0:3] = True
    mask[1, 1] = False
    mask[3, 3] = True
    member = cells_of(spark, mask.shape, m=mask).filter("m").drop("m").withColumn("site_id", F.lit(1).cast("bigint"))
    rings = polygons.site_rings(member, grid_row(spark, 6, 6, 1))
    got = polygons.ring_measures(rings).orderBy("part", "ring").collect()
    assert [(r.part, r.ring, r.is_hole, r.area_m2) for r in got] == [(0, 0, False, 9.0), (0, 1, True, -1.0), (1, 0, False, 1.0)]
    shapes = one(polygons.site_polygons(rings))["polygons"]
    assert [len(part) for part in shapes] == [2, 1]


def test_simplified_ring_stays_close(spark):
    n = 20
    r, c = np.indices((n, n))
    member = cells_of(spark, (n, n), m=(c <= r)).filter("m").drop("m").withColumn("site_id", F.lit(1).cast("bigint"))
    exact = one(polygons.ring_measures(polygons.site_rings(member, grid_row(spark, n, n, 1))))
    simple = one(polygons.ring_measures(polygons.site_rings(member, grid_row(spark, n, n, 1), 1.0)))
    assert simple["corners"] < exact["corners"] / 4
    assert math.isclose(simple["area_m2"], exact["area_m2"], rel_tol=0.1)


LATTICE = "scene_id STRING, u0 DOUBLE, v0 DOUBLE, du DOUBLE, dv DOUBLE, side_i INT, side_j INT"


def lattice_cells(spark, width, height):
    u, v = np.indices((width, height)).reshape(2, -1)
    return spark.createDataFrame(pd.DataFrame({"scene_id": "a", "row": v, "col": u, "u": u * 1.0, "v": v * 1.0, "x": u * 1.0, "y": v * 1.0}))


def test_oblong_lattice_with_a_wide_hole(spark):
    """Three by seven samples, of which a block of two by three quads has no value; scene b has no lattice."""
    i, j = np.indices((3, 7)).reshape(2, -1)
    value = np.where((j >= 2) & (j <= 5), np.nan, 2.0 * i * 10 - 3.0 * j * 10)
    pdf = pd.DataFrame({"scene_id": "a", "i": i, "j": j, "x": i * 10.0, "y": j * 10.0, "value": value})
    samples = spark.createDataFrame(pdf).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    lattice = frame(spark, [("a", 0.0, 0.0, 10.0, 10.0, 3, 7)], LATTICE)
    cells = lattice_cells(spark, 25, 65)
    got = interpolate.interpolate(cells.unionByName(cells.limit(5).withColumn("scene_id", F.lit("b"))), samples, lattice).toPandas()
    assert len(got) == 25 * 65 + 5 and got[got.scene_id == "b"].value.isna().all()
    known = pdf.dropna()
    for r in got[got.scene_id == "a"].itertuples():
        if r.x <= 20 and r.y < 10:
            assert math.isclose(r.value, 2.0 * r.x - 3.0 * r.y, abs_tol=1e-9)
        elif 20 <= r.y <= 50:
            near = (known.x - r.x) ** 2 + (known.y - r.y) ** 2
            assert r.value in set(known[near == near.min()].value)


def test_linear_field_survives_reprojection(spark):
    """A field linear in degrees, tiled over a seam, on cells of a UTM grid: exact between pixel centres."""
    grid = frame(spark, [("a", 500000.0, 3500000.0, 500.0, 20, 30, 32635)], "scene_id STRING, minx DOUBLE, maxy DOUBLE, resolution_m DOUBLE, width INT, height INT, epsg INT")
    r, c = np.indices((30, 20)).reshape(2, -1)
    cells = spark.createDataFrame(pd.DataFrame({"scene_id": "a", "row": r, "col": c, "x": 500000.0 + (c + 0.5) * 500, "y": 3500000.0 - (r + 0.5) * 500}))
    west, north, step = 26.9, 31.7, 0.004
    i, j = np.indices((80, 80)).reshape(2, -1)
    lon, lat = west + (j + 0.5) * step, north - (i + 0.5) * step
    source = spark.createDataFrame(pd.DataFrame({"scene_id": "a", "row": i, "col": j, "value": 3.0 * lon - 2.0 * lat}))
    affine = frame(spark, [("a", west, north, step, step, 80, 80)], "scene_id STRING, west DOUBLE, north DOUBLE, dlon DOUBLE, dlat DOUBLE, width INT, height INT")
    want = geodesy.with_lonlat(cells.join(grid.select("scene_id", "epsg"), "scene_id"), "x", "y", "epsg", "lon", "lat").select("row", "col", "lon", "lat").toPandas()
    for method, tolerance in (("bilinear", 1e-6), ("cubic", 1e-6), ("nearest", 0.011), ("average", 0.011)):
        got = grids.warp(cells, grid, source, affine, method).toPandas().merge(want, on=["row", "col"])
        assert len(got) == 600 and np.allclose(got.value, 3.0 * got.lon - 2.0 * got.lat, atol=tolerance), method


def test_value_above_the_last_bound_scores_zero(spark):
    bands = frame(spark, [("k", float("-inf"), 5.0, 1.0)], "key STRING, lo DOUBLE, hi DOUBLE, score DOUBLE")
    values = frame(spark, [("k", 3.0), ("k", 99.0), ("k", None)], "key STRING, value DOUBLE")
    got = {r.value: r.score for r in reclassify.score_by_bands(values, bands).collect()}
    assert got == {3.0: 1.0, 99.0: 0.0}


def test_cells_without_normals_stay(spark):
    cells = frame(spark, [("a", 0, 0), ("b", 0, 1)], "scene_id STRING, row INT, col INT")
    normals = frame(spark, [("a", 1, 2.0), ("a", 2, 3.0)], "scene_id STRING, month INT, ghi DOUBLE")
    got = [(r.scene_id, r.month, r.ghi) for r in energy.normals_on_cells(cells, normals).orderBy("scene_id", "month").collect()]
    assert got == [("a", 1, 2.0), ("a", 2, 3.0), ("b", None, None)]


def test_hard_exclusions_carry_no_weight(spark):
    rows = frame(spark, [("a", "hard_exclusion", 0.0), ("b", "hard_exclusion", 0.1), ("c", "scored", 0.4)], "key STRING, kind STRING, local_weight DOUBLE")
    assert [r.key for r in rg.exclusion_weight_violations(rows).collect()] == ["b"]


def test_linear_field_is_interpolated_exactly(spark):
    i, j = np.indices((5, 5)).reshape(2, -1)
    plane = lambda x, y: 3.0 + 0.25 * x - 0.5 * y
    samples = spark.createDataFrame(
        pd.DataFrame({"scene_id": "a", "i": i, "j": j, "x": i * 10.0 + j, "y": j * 10.0, "value": plane(i * 10.0 + j, j * 10.0)})
    )
    lattice = frame(spark, [("a", 0.0, 0.0, 10.0, 10.0, 5, 5)], LATTICE)
    u, v = np.indices((41, 41)).reshape(2, -1)
    cells = spark.createDataFrame(
        pd.DataFrame({"scene_id": "a", "row": v, "col": u, "u": u * 1.0, "v": v * 1.0, "x": u + v / 10.0, "y": v * 1.0})
    )
    df = interpolate.interpolate(cells, samples, lattice).toPandas()
    assert len(df) == 41 * 41 and np.allclose(df.value, plane(df.x, df.y))
    holed = samples.withColumn("value", F.when((F.col("i") != 2) | (F.col("j") != 2), F.col("value")))
    assert interpolate.interpolate(cells, holed, lattice).filter("value IS NULL").count() == 0
    assert interpolate.too_few_samples(samples.limit(2)).count() == 1


def test_holes_of_large_lattices_take_the_nearest_sample(spark):
    i, j = np.indices((40, 60)).reshape(2, -1)
    x, y = i * 10.0 + j * 3.0, j * 10.0 - i * 1.5
    value = np.where((np.abs(i - 20) <= 4) & (np.abs(j - 30) <= 4) | (i < 12) & (j < 12), np.nan, (i * 31 + j * 17) % 97)
    known = ~np.isnan(value)
    samples = frame(
        spark,
        [(s, int(a), int(b), float(p), float(q), None if np.isnan(v) else float(v)) for s in ("a", "c") for a, b, p, q, v in zip(i, j, x, y, value)]
        + [("b", 0, 0, 5.0, 5.0, 4.0)] + [("d", k % 2, k // 2, float(k % 2), float(k // 2), None) for k in range(4)],
        "scene_id STRING, i INT, j INT, x DOUBLE, y DOUBLE, value DOUBLE",
    )
    lattice = frame(spark, [(s, 0.0, 0.0, 1.0, 1.0, 40, 60) for s in "abcd"], LATTICE)
    u, v = (a.reshape(-1) for a in np.meshgrid(np.arange(0.25, 39, 1.9), np.arange(0.25, 59, 1.9)))
    places = pd.DataFrame({"row": np.arange(len(u)), "col": 0, "u": u, "v": v, "x": u * 10.0 + v * 3.0, "y": v * 10.0 - u * 1.5})
    cells = spark.createDataFrame(pd.concat([places.assign(scene_id=s) for s in "abd"])[["scene_id", *places.columns]])
    got = interpolate.interpolate(cells, samples, lattice).toPandas().set_index(["scene_id", "row"])["value"]
    assert len(got) == 3 * len(u) and got.loc["d"].isna().all() and set(got.loc["b"]) == {4.0}
    lost = 0
    for r in places.itertuples():
        corners = [(int(r.u) + a) * 60 + int(r.v) + b for a in (0, 1) for b in (0, 1)]
        if known[corners].any():
            continue
        lost += 1
        d = np.where(known, (x - r.x) ** 2 + (y - r.y) ** 2, np.inf)
        assert got.loc[("a", r.row)] in set(value[d <= d.min() + 1e-6])
    assert lost > 40


def test_duplicate_geometries(spark):
    rows = [("a", i, "Point", [(1.0, 2.0)]) for i in range(5)] + [("a", 9, "Point", [(1.0, 3.0)]), ("b", 7, "Point", [(1.0, 2.0)])]
    df = frame(spark, rows, "scene_id STRING, feature_id BIGINT, geom_type STRING, coords ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    assert sorted(r.feature_id for r in vectors.drop_duplicate_geometries(df).collect()) == [0, 7, 9]


# ---- energy ----------------------------------------------------------------------------


def test_loss_stack(spark):
    row = one(spark.range(1).select(losses.dc_loss_fraction(losses.loss_items()).alias("loss"), F.size(losses.loss_items()).alias("n")))
    assert math.isclose(row["loss"], 0.140757, abs_tol=1e-6) and row["n"] == 10
    with pytest.raises(ValueError, match="unknown losses"):
        losses.loss_items(dust=F.lit(1.0))


def test_cost_of_energy(spark):
    df = frame(spark, [(1.0, 1800.0), (1.0, 0.0)], "area_km2 DOUBLE, specific_yield DOUBLE")
    rows = energy.site_energy(df).collect()
    assert (rows[0].capacity_mwp, rows[0].annual_gwh) == (45.0, 81.0)
    assert math.isclose(rows[0].lcoe_usd_per_mwh, 57.117, abs_tol=1e-3) and rows[1].lcoe_usd_per_mwh is None
    crf = one(spark.range(1).select(finance.capital_recovery_factor(F.lit(0.07), F.lit(25)).alias("c")))["c"]
    assert math.isclose(crf, 0.08581, abs_tol=1e-5)


def year(spark):
    """A synthetic clear year: half-sine days."""
    ts = pd.date_range("2005-01-01", periods=8760, freq="h")
    sun = np.clip(np.sin((ts.hour - 6) / 12 * np.pi), 0, None)
    pdf = pd.DataFrame({"site_id": 1, "ts": ts, "G(h)": 900 * sun, "Gb(n)": 765 * sun, "Gd(h)": 135 * sun, "T2m": 20 + 5 * sun, "WS10m": 4.0, "lat": 31.0, "lon": 0.0})
    return spark.createDataFrame(pdf)


def test_months_add_up_and_shape_is_normal(spark):
    weather = energy.prepare_weather(year(spark))
    row = one(energy.yield_profile(weather, ["site_id"]))
    months = [row[f"m{m:02d}"] for m in range(1, 13)]
    assert row["specific_yield"] > 1000 and math.isclose(sum(months), row["specific_yield"], rel_tol=1e-9)
    shape = one(energy.diurnal_shape(weather, ["site_id"]))["gen_shape"]
    assert math.isclose(sum(shape), 1.0) and shape[0] == 0.0
    dark = weather.withColumns({c: F.lit(0.0) for c in ("ghi", "dni", "dhi")})
    assert one(energy.diurnal_shape(dark, ["site_id"]))["gen_shape"] == [0.0] * 24
    best = one(energy.best_tilt(weather, ["site_id"]))
    assert best["optimal_tilt"] % 5 == 0 and best["optimal_yield"] >= row["specific_yield"] * 0.98


def test_missing_weather_column(spark):
    with pytest.raises(ValueError, match="weather columns missing"):
        energy.prepare_weather(year(spark).drop("T2m"))


def test_irr(spark):
    flows = frame(spark, [([-1000.0] + [150.0] * 25,), ([-1000.0, 1.0],), (None,)], "f ARRAY<DOUBLE>")
    got = [r.r for r in flows.select(finance.irr(F.col("f")).alias("r")).collect()]
    assert math.isclose(got[0], 0.1449, abs_tol=1e-4) and got[2] is None
    level = frame(spark, [(1000.0, 150.0, 0.0, 25), (1000.0, -1.0, 0.0, 25)], "c DOUBLE, s DOUBLE, d DOUBLE, n INT")
    both = [r.r for r in level.select(finance.level_irr(F.col("c"), F.col("s"), F.col("d"), F.col("n")).alias("r")).collect()]
    assert math.isclose(both[0], got[0], abs_tol=1e-8) and both[1] is None


def split(spark, gen, load, policy, shape):
    df = frame(spark, [(gen, load, policy, shape)], "g DOUBLE, l DOUBLE, p STRING, s ARRAY<DOUBLE>")
    return one(df.select(rooftop.dispatch_split(F.col("g"), F.col("l"), F.col("p"), F.col("s"), F.lit("evening")).alias("r")).select("r.*"))


def test_dispatch(spark):
    noon = [0.0] * 24
    noon[12] = 1.0
    net = split(spark, 5000.0, 4000.0, "net_metering", noon)
    assert (net["self_consumed"], net["exported"], net["grid_import"]) == (4000.0, 1000.0, 0.0)
    own = split(spark, 5000.0, 4000.0, "self_consumption", noon)
    none = split(spark, 5000.0, 4000.0, "no_export", noon)
    assert own["self_consumed"] < 200 and own["exported"] > 4800 and none["exported"] == 0.0
    # without a shape the annual balance still reports its surplus
    assert split(spark, 5000.0, 4000.0, "no_export", None)["exported"] == 1000.0


# ---- bounds, ranges, matrices ----------------------------------------------------------


def test_general_number_format(spark):
    values = [0.0, 0.5, 123.456, 12345.6, 99999.0, 0.00012345, 1e-7, -2600.4]
    df = frame(spark, [(v,) for v in values], "v DOUBLE")
    assert [r.t for r in df.select(text.general(F.col("v"), 4).alias("t")).collect()] == [f"{v:.4g}" for v in values]


def test_assertion_fails_the_job(spark):
    checked = quality.check_many(frame(spark, [("payback_years", 99.0)], "name STRING, value DOUBLE"), quality.bounds_table(spark))
    assert "payback_years=99 years outside physical envelope [0.5, 60]" in one(checked)["message"]
    with pytest.raises(PySparkException, match="payback_years"):
        quality.assert_within(checked).collect()


def test_band_and_tornado(spark):
    wide = frame(spark, [(1, 1.0, 2.0, 3.0, 10.0, 20.0, 40.0)], "case_id INT, a_low DOUBLE, a_base DOUBLE, a_high DOUBLE, b_low DOUBLE, b_base DOUBLE, b_high DOUBLE")
    band = one(uncertainty.propagate(wide, lambda p: p["a"] * p["b"], ["a", "b"]))
    assert (band["low"], band["base"], band["high"]) == (10.0, 40.0, 120.0)
    order = [r.parameter for r in uncertainty.tornado(wide, lambda p: p["a"] * p["b"], ["a", "b"]).orderBy("position").collect()]
    assert order == ["b", "a"]
    with pytest.raises(ValueError, match="too many"):
        uncertainty.propagate(wide, lambda p: p["a"], [str(i) for i in range(13)])


def entries(spark, *matrices):
    rows = [(k, i, j, float(v)) for k, m in enumerate(matrices) for i, line in enumerate(m) for j, v in enumerate(line)]
    return frame(spark, rows, "matrix_id INT, i INT, j INT, a DOUBLE")


def test_published_matrices(spark):
    saaty = [[1, 3, 5, 7], [1 / 3, 1, 3, 5], [1 / 5, 1 / 3, 1, 3], [1 / 7, 1 / 5, 1 / 3, 1]]
    even = [[1, 2, 4], [1 / 2, 1, 2], [1 / 4, 1 / 2, 1]]
    uneven = [[1, 9, 1], [1 / 9, 1, 9], [1, 1 / 9, 1]]
    df = entries(spark, saaty, even, uneven)
    got = {r.matrix_id: r for r in pairwise.analyze(df).collect()}
    assert np.allclose(got[0].weights, [0.565, 0.262, 0.113, 0.060], atol=0.01) and math.isclose(got[0].cr, 0.043, abs_tol=0.01)
    assert np.allclose(got[1].weights, [4 / 7, 2 / 7, 1 / 7]) and math.isclose(got[1].lambda_max, 3.0) and abs(got[1].cr) < 1e-9
    assert got[2].cr > 0.10 and got[2].worst_i is not None
    assert sorted(r.matrix_id for r in pairwise.strict(df).collect()) == [0, 1]
    assert [(r.matrix_id, r.rule) for r in pairwise.rejected(df).collect()] == [(2, "inconsistent")]


def test_weights_settle_or_are_marked(spark):
    def two_groups(link):
        # Two consistent halves that disagree in every pair across, so that the two largest eigenvalues lie close.
        m = np.ones((4, 4))
        m[:2, 2:] = [[link, 1 / link], [1 / link, link]]
        m[2:, :2] = 1 / m[:2, 2:].T
        m[0, 1], m[1, 0] = 3.0, 1 / 3
        return m

    slow = np.ones((5, 5))
    for i in range(4):
        slow[i, i + 1], slow[i + 1, i] = 1e4, 1e-4
    slow[0, 4], slow[4, 0] = 1e-4, 1e4
    # A cycle of huge preferences: all eigenvalues of the largest size but one differ only in their angle.
    endless = np.ones((3, 3))
    endless[0, 1] = endless[1, 2] = endless[2, 0] = 1e12
    endless[1, 0] = endless[2, 1] = endless[0, 2] = 1e-12
    endless[0, 1] *= 2
    endless[1, 0] /= 2
    cases = [two_groups(1.0), two_groups(9.0), slow, endless]
    got = {r.matrix_id: r for r in pairwise.analyze(entries(spark, *cases)).collect()}
    for k, m in enumerate(cases):
        values, vectors = np.linalg.eig(m)
        w = np.abs(np.real(vectors[:, np.argmax(np.real(values))]))
        assert not got[k].settled or np.allclose(got[k].weights, w / w.sum(), atol=1e-8)
        assert all(np.isfinite(got[k].weights)) and abs(sum(got[k].weights) - 1.0) < 1e-12
    assert [got[k].settled for k in range(3)] == [True] * 3
    assert {r.rule for r in pairwise.rejected(entries(spark, np.array([[1.0, 2.0], [0.5, 1.0]]), slow)).collect()} == {"inconsistent"}


@pytest.mark.parametrize("squarings, settled", [(0, False), (24, True)])
def test_few_squarings_leave_weights_unsettled(squarings, settled, monkeypatch):
    monkeypatch.setattr(pairwise, "SQUARINGS", squarings)
    m = pd.Series([np.array([1, 9, 1, 1 / 9, 1, 9, 1, 1 / 9, 1])])
    out = pairwise._power_weights.func(m, pd.Series([3]))
    assert bool(out["settled"].iloc[0]) is settled


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(0.2, 5.0), min_size=2, max_size=8), min_size=5, max_size=20))
def test_consistent_matrices_return_their_weights(spark, weight_lists):
    df = entries(spark, *[[[a / b for b in w] for a in w] for w in weight_lists])
    for r in pairwise.analyze(df).collect():
        w = np.array(weight_lists[r.matrix_id])
        assert np.allclose(r.weights, w / w.sum(), atol=1e-6) and abs(r.cr) < 1e-6


# ---- sources ---------------------------------------------------------------------------


def test_files_are_read_as_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "Polygon", "coordinates": [RING]}, indent=1))
    parsed = doc.parse_areas(doc.read_text(spark, str(tmp_path)), "doc_id")
    assert one(parsed)["doc_fault"] is None


def test_hourly_stamp(spark):
    text_ = json.dumps({"outputs": {"tmy_hourly": [{"time(UTC)": "20050101:1300", "T2m": 1.5, "G(h)": 7.0, "Gb(n)": 1.0, "Gd(h)": 2.0, "WS10m": 3.0}]}})
    row = one(doc.parse_hourly(frame(spark, [(1, text_)], "k INT, text STRING"), ["k"]))
    assert row["ts"].strftime("%Y-%m-%d %H:%M") == "2005-01-01 13:00" and row["ghi"] == 7.0


def test_tiles_are_pruned(spark):
    path = scratch_path(spark, "tiles")
    pixels = frame(spark, [(lat, lon, 0, 0, float(lat)) for lat in range(5) for lon in range(5)], "tile_lat BIGINT, tile_lon BIGINT, row INT, col INT, value DOUBLE")
    pixels.write.partitionBy("tile_lat", "tile_lon").parquet(path)
    covering = frame(spark, [("a", 1, 2), ("a", 1, 3), ("b", 1, 2), ("b", 1, 2)], "scene_id STRING, tile_lat BIGINT, tile_lon BIGINT")
    read = rasters.read_tiles(spark, path, covering)
    assert sorted((r.scene_id, r.tile_lat, r.tile_lon) for r in read.collect()) == [("a", 1, 2), ("a", 1, 3), ("b", 1, 2)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan


def test_failed_sources_are_skipped_and_committed_ones_kept(spark, tmp_path):
    base = frame(spark, [("a", 0, k) for k in range(4)], "scene_id STRING, row INT, col INT")
    layer = base.withColumn("v", F.col("col") * 2.0)
    breaks = F.udf(lambda c: 1 / (c - 2), "double")
    calls = []

    def counted():
        calls.append(1)
        return layer

    sources = {"v": [lambda: layer.withColumn("v", breaks("col")), counted], "w": lambda: spark.read.parquet(str(tmp_path / "absent"))}
    store = str(tmp_path / "layers")
    for _ in range(2):
        made, report = rasters.assemble(base, sources, store)
        assert sorted((r.col, r.v) for r in made.collect()) == [(0, 0.0), (1, 2.0), (2, 4.0), (3, 6.0)]
    assert [(r.layer, r.source) for r in report.collect()] == [("w", 0)] and len(calls) == 1
    with pytest.raises(NameError):
        rasters.assemble(base, {"v": lambda: undefined_name})  # noqa: F821


@pytest.mark.parametrize("crowded", [3, 40, 10_000])
def test_areas_and_boxes_of_any_density(spark, monkeypatch, crowded):
    """A third of all extents in one small square, some over the whole plane, some equal: all pairs, each once."""
    monkeypatch.setattr(vectors, "CROWDED", crowded)
    rng = np.random.default_rng(3)

    def extents(n):
        hot = n // 3
        corner = np.concatenate([rng.uniform(-0.02, 0.05, (hot, 2)), rng.uniform(-8, 8, (n - hot, 2))])
        side = np.concatenate([rng.uniform(0, 0.01, (hot, 2)), rng.uniform(0, 2, (n - hot, 2))])
        side[-2:] = 16
        corner[:4] = corner[0]
        return [(k, *map(float, (*c, *(c + s)))) for k, (c, s) in enumerate(zip(corner, side, strict=True))]

    areas, boxes = extents(150), extents(120)
    ring = "array(array(named_struct('x', minx, 'y', miny), named_struct('x', maxx, 'y', miny), named_struct('x', maxx, 'y', maxy), named_struct('x', minx, 'y', maxy), named_struct('x', minx, 'y', miny))) AS rings"
    names = "k long, minx double, miny double, maxx double, maxy double"
    a = spark.createDataFrame([*areas, (900, None, 0.0, 1.0, 1.0)], names).selectExpr("k AS area_id", "minx", "miny", "maxx", "maxy", ring)
    b = spark.createDataFrame(boxes, names).selectExpr("CAST(k AS STRING) AS scene_id", "minx", "miny", "maxx", "maxy")
    got = [(r.scene_id, r.area_id) for r in vectors.areas_meeting_boxes(a, b).select("scene_id", "area_id").collect()]
    want = {(str(q[0]), p[0]) for p in areas for q in boxes if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got))
    assert set(got) == want


def test_no_leaf_holds_a_dense_square(spark, monkeypatch):
    """Boxes of which a third lie in one tile: its leaves hold a few of them each."""
    monkeypatch.setattr(vectors, "CROWDED", 30)
    rng = np.random.default_rng(4)
    corner = np.concatenate([rng.uniform(0, 0.9, (1000, 2)), rng.uniform(-40, 40, (2000, 2))])
    rows = [tuple(map(float, (*c, *(c + 0.001)))) for c in corner]
    df = vectors._finest(spark.createDataFrame(rows, "minx double, miny double, maxx double, maxy double"), 1.0)
    dealt = vectors.leaf_squares(df, vectors.crowded_squares(df))
    held = [r["count"] for r in dealt.groupBy("_level", "_tx", "_ty").count().collect()]
    assert sum(held) >= 3000
    assert max(held) <= 30


# ---- sizes of written tables -----------------------------------------------------------


def _estimated_bytes(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _repetitive_cells(spark):
    """Rows that compress to nearly nothing: 1,200,000 cells of one value."""
    return spark.range(0, 1_200_000, 1, 4).selectExpr("'a' AS scene_id", "CAST(id div 1000 AS INT) AS row", "CAST(id % 1000 AS INT) AS col", "1.0D AS v")


def test_written_cells_are_not_broadcast(spark):
    stored = cut(_repetitive_cells(spark))
    assert _estimated_bytes(stored) > 10 * 2**20
    joined = stored.join(stored.withColumnRenamed("v", "w"), ["scene_id", "row", "col"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_assembled_layers_are_not_broadcast(spark):
    base = _repetitive_cells(spark).drop("v")
    made, report = rasters.assemble(base, {"v": lambda: _repetitive_cells(spark)})
    assert report.count() == 0
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.filter("v = 1").count() == 1_200_000


# ---- equal outlines --------------------------------------------------------------------


def _square(area_id, x, y, side, scene="a"):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]
    return (scene, area_id, x, y, x + side, y + side, [ring])


AREAS = "scene_id STRING, area_id BIGINT, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE, rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"


def test_equal_outlines_are_filled_once(spark):
    spec = grid_row(spark, 10, 10)
    one_, other = (500000.0, 3497000.0, 3000.0), (502000.0, 3495000.0, 3000.0)
    copies = frame(spark, [_square(i, *(one_ if i % 2 else other)) for i in range(1000)], AREAS)
    kept = vectors.distinct_outlines(copies)
    assert sorted(r[0] for r in kept.select("area_id").collect()) == [0, 1]
    assert set(kept.columns) == set(copies.columns)
    single = frame(spark, [_square(1, *one_), _square(2, *other)], AREAS)
    # A repeated row once more: its crossings used to pair up with their own copies and fill nothing.
    repeated = single.unionByName(single)
    want = {(r["row"], r["col"]) for r in vectors.protected_cells(single, spec).collect()}
    assert len(want) == 9 + 9 - 1
    for areas in (copies, repeated):
        got = vectors.protected_cells(areas, spec).collect()
        assert len(got) == len(want) and {(r["row"], r["col"]) for r in got} == want


# ---- tiles shared by scenes ------------------------------------------------------------


def test_scenes_share_the_pixels_of_a_tile(spark):
    """A long scene over a diagonal of tiles and two scenes at one place; no scene has a raster of its own box."""
    path = scratch_path(spark, "shared-tiles")
    pixels = spark.range(4).selectExpr("CAST(id AS INT) + 30 AS tile_lat", "CAST(id AS INT) + 26 AS tile_lon").selectExpr(
        "*", "explode(sequence(0, 59)) AS pixel_row"
    ).selectExpr("*", "explode(sequence(0, 59)) AS pixel_col", "CAST(tile_lat * 100 + pixel_row AS DOUBLE) AS value")
    rasters.write_tiles(pixels, path)
    places = [("long", i, 30.5 + i, 26.5 + i) for i in range(4)] + [("b", 0, 30.5, 26.5), ("c", 0, 30.5, 26.5)]
    at = geodesy.with_utm(
        frame(spark, places, "scene_id STRING, row INT, lat DOUBLE, lon DOUBLE").withColumns({"col": F.lit(0), "epsg": F.lit(32635)}), "lon", "lat", "epsg", "x", "y"
    )
    spec = frame(spark, [(s, 32635) for s in ("long", "b", "c")], "scene_id STRING, epsg INT")
    for method in ("nearest", "bilinear"):
        df = rasters.tiles_to_cells(spark, path, at, spec, 1, 60, method)
        assert df.columns == ["scene_id", "row", "col", "x", "y", "value"]
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "width" not in plan and "strategy=merge" in plan
        got = {(r["scene_id"], r["row"]): r["value"] for r in df.collect()}
        assert len(got) == 6 and got["b", 0] == got["c", 0] == got["long", 0]
        for i in range(4):
            assert abs(got["long", i] - ((30 + i) * 100 + 29.5)) <= 0.5 + 1e-6


PLANNED_TILES = """
from pyspark.sql import functions as F
from terralux.session import local_session, scratch_path
from terralux.sources import rasters

spark = local_session(2, memory="500m")
path = scratch_path(spark, "planned-tiles")
pixels = spark.range(9).selectExpr("30L AS tile_lat", "24 + id DIV 3 AS tile_lon", "CAST(id % 3 AS INT) AS pixel_row", "0 AS pixel_col", "1D AS value")
rasters.write_tiles(pixels, path)
at = spark.range(4).selectExpr("id DIV 100 AS gr", "id % 100 AS gc").selectExpr("'a' AS scene_id", "CAST(IF(gc < 34, gr, gr % 50) AS INT) AS row", "CAST(IF(gc < 34, gc, gc - 34) AS INT) AS col")
at = at.selectExpr("*", "300000D + (col + 0.5D) * 500 AS x", "3400000D - (row + 0.5D) * 500 AS y")
# One projection for all scenes: a constant, with which the positions are computed from the cells alone.
spec = spark.range(1).selectExpr("'a' AS scene_id", "32635 AS epsg")
for method in ("nearest", "bilinear", "cubic"):
    df = rasters.tiles_to_cells(spark, path, at, spec, 1, 60, method)
    assert "Join" in df._jdf.queryExecution().optimizedPlan().toString()
    print("planned", method)
"""


def test_tiles_to_cells_is_planned_by_a_small_driver():
    """Join keys that are computed from latitudes are not written out while Spark looks for a scan to prune."""
    root = Path(__file__).resolve().parents[1]
    run = subprocess.run([sys.executable, "-c", PLANNED_TILES], cwd=root, capture_output=True, text=True, timeout=600)
    assert run.stdout.split() == ["planned", "nearest", "planned", "bilinear", "planned", "cubic"], run.stderr[-2000:]
