"""Outlines of sites across blocks against a walk over the whole grid."""

from __future__ import annotations

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralux.operators import components, polygons, stencil
from terralux.plans.sources import refresh_scenes, scene_keys
from terralux.sinks.tables import write_features


def grid_of(spark, height, width, size=1):
    return spark.createDataFrame(
        [("a", 0.0, 0.0, float(width * size), float(height * size), size, 32635, width, height)],
        "scene_id STRING, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE, resolution_m INT, epsg INT, width INT, height INT",
    )


def members(spark, sites):
    rows = [("a", int(sites[r, c]), int(r), int(c)) for r, c in zip(*np.nonzero(sites), strict=True)]
    return spark.createDataFrame(rows, "scene_id STRING, site_id BIGINT, row INT, col INT").repartition(3)


def whole_walk(sites):
    """(site, part by its first cell) -> sorted rings as corner lists from their first corner, side by side."""
    h, w = sites.shape
    at = lambda r, c: sites[r, c] if 0 <= r < h and 0 <= c < w else 0
    step = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    left = [(-1, 1), (1, 1), (1, -1), (-1, -1)]
    outside = [(-1, 0), (0, 1), (1, 0), (0, -1)]
    end = [(0, 1), (1, 1), (1, 0), (0, 0)]
    part = {}
    for r, c in zip(*np.nonzero(sites), strict=True):
        if (r, c) not in part:
            todo, part[r, c] = [(r, c)], (int(r), int(c))
            while todo:
                a, b = todo.pop()
                for dr, dc in step:
                    n = (a + dr, b + dc)
                    if at(*n) == sites[r, c] and n not in part:
                        part[n] = part[r, c]
                        todo.append(n)
    sides = {(int(r), int(c), d) for (r, c) in part for d in range(4) if at(r + outside[d][0], c + outside[d][1]) != sites[r, c]}
    rings = {}
    while sides:
        first = r, c, d = min(sides)
        corners = []
        key = (int(sites[r, c]), part[r, c])
        while True:
            sides.discard((r, c, d))
            ahead, diagonal = (r + step[d][0], c + step[d][1]), (r + left[d][0], c + left[d][1])
            corner = (r + end[d][0], c + end[d][1])
            if at(*ahead) != sites[r, c]:
                d = (d + 1) % 4
                corners.append(corner)
            elif at(*diagonal) == sites[r, c]:
                (r, c), d = diagonal, (d + 3) % 4
                corners.append(corner)
            else:
                r, c = ahead
            if (r, c, d) == first:
                break
        k = corners.index(min(corners))
        rings.setdefault(key, []).append(tuple(corners[k:] + corners[:k]))
    return sorted((site, tuple(sorted(rs))) for (site, _), rs in rings.items())


def built(rings, height):
    found = {}
    for r in rings.collect():
        corners = [(int(height - y), int(x)) for x, y in zip(r.xs, r.ys, strict=True)]
        assert corners[0] == corners[-1] and r.is_hole == (r.ring > 0)
        found.setdefault((r.site_id, r.part), {})[r.ring] = tuple(corners[:-1])
    for part in found.values():
        assert sorted(part) == list(range(len(part))) and part[0] == min(part.values())
    return sorted((site, tuple(sorted(part.values()))) for (site, _), part in found.items())


@pytest.mark.parametrize(("block", "density", "kinds"), [(4, 0.6, 1), (5, 0.75, 2), (128, 0.7, 2)])
def test_random_sites_match_a_whole_walk(spark, monkeypatch, block, density, kinds):
    monkeypatch.setattr(stencil, "BLOCK", block)
    rng = np.random.default_rng(block)
    sites = (rng.random((23, 31)) < density) * rng.integers(1, kinds + 1, (23, 31))
    got = built(polygons.site_rings(members(spark, sites), grid_of(spark, *sites.shape)), sites.shape[0])
    assert got == whole_walk(sites)


def test_nested_rings_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(stencil, "BLOCK", 4)
    sites = np.zeros((25, 25), dtype=int)
    for k in range(0, 12, 2):
        sites[k : 25 - k, k : 25 - k] = 1 if k % 4 == 0 else 0
    sites[0:25, 12] = 1
    got = built(polygons.site_rings(members(spark, sites), grid_of(spark, 25, 25)), 25)
    assert got == whole_walk(sites)


def test_a_large_region_stays_in_blocks(spark):
    n = 600
    cells = spark.range(n * n, numPartitions=8).select(F.lit("a").alias("scene_id"), F.lit(1).cast("bigint").alias("site_id"), (F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    holed = cells.filter("NOT (row BETWEEN 100 AND 499 AND col BETWEEN 120 AND 130) AND NOT (row = 5 AND col = 5)")
    blocked = polygons.block_chains(holed)
    assert blocked.agg(F.max(F.size("corners"))).first()[0] <= 8
    got = polygons.ring_measures(polygons.site_rings(holed, grid_of(spark, n, n))).orderBy("ring").collect()
    assert [(r.is_hole, r.area_m2, r.perimeter_m, r.corners) for r in got] == [
        (False, 360_000.0, 2400.0, 4), (True, -1.0, 4.0, 4), (True, -4400.0, 822.0, 4),
    ]


@pytest.mark.parametrize("tolerance", [1.5, 4.0])
def test_simplified_outlines_keep_their_distance(spark, monkeypatch, tolerance):
    monkeypatch.setattr(stencil, "BLOCK", 16)
    r, c = np.indices((60, 70))
    sites = ((r - 30) ** 2 / 800 + (c - 35) ** 2 / 1100 < 1).astype(int) * ((r - 28) ** 2 + (c - 30) ** 2 > 60)
    cells, spec = members(spark, sites), grid_of(spark, *sites.shape)
    exact, simple = (polygons.site_rings(cells, spec, t).orderBy("ring").collect() for t in (0.0, tolerance))
    assert len(exact) == len(simple) == 2
    for e, s in zip(exact, simple, strict=True):
        corners, kept = np.column_stack([e.xs, e.ys]), np.column_stack([s.xs, s.ys])
        assert {tuple(p) for p in kept} <= {tuple(p) for p in corners} and 4 <= len(kept) < 0.6 * len(corners)
        a, b = kept[:-1], kept[1:]
        t = np.clip(((corners[:, None] - a) * (b - a)).sum(axis=2) / ((b - a) ** 2).sum(axis=1), 0, 1)
        off = np.hypot(*np.moveaxis(corners[:, None] - a - t[..., None] * (b - a), 2, 0)).min(axis=1)
        assert off.max() <= tolerance + 1e-9


def test_no_cells(spark):
    assert polygons.site_rings(members(spark, np.zeros((2, 2), dtype=int)), grid_of(spark, 2, 2)).count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 3.0])
def test_centroids_come_from_the_corners_that_stay(spark, tolerance):
    rng = np.random.default_rng(5)
    sites = np.where(rng.random((30, 40)) < 0.75, 1, 0)
    grid, cells = grid_of(spark, *sites.shape), members(spark, sites)
    rings = polygons.site_rings(cells, grid, tolerance)
    doubled, mx, my = 0.0, 0.0, 0.0
    for ring in rings.collect():
        x, y = np.array(ring.xs), np.array(ring.ys)
        cross = x[:-1] * y[1:] - x[1:] * y[:-1]
        doubled, mx, my = doubled + cross.sum(), mx + ((x[:-1] + x[1:]) * cross).sum(), my + ((y[:-1] + y[1:]) * cross).sum()
    got = polygons.polygon_centroids(rings).first()
    assert np.allclose([got.x, got.y], [mx / doubled / 3, my / doubled / 3])
    if not tolerance:
        r, c = np.nonzero(sites)
        assert np.allclose([got.x, got.y], [c.mean() + 0.5, sites.shape[0] - r.mean() - 0.5])


def test_polygons_without_an_inside_have_no_centroid(spark):
    rings = spark.createDataFrame([("a", 1, [0.0, 5.0, 0.0], [0.0, 0.0, 0.0])], "scene_id STRING, site_id INT, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>")
    assert polygons.polygon_centroids(rings).first()[2:] == (None, None)


def test_only_changed_scenes_are_computed_again(spark, tmp_path):
    rows = [(s, k, None if k == 2 else float(k)) for s in ("a", "b", "7") for k in range(3)]
    asked = []

    def refreshed(table, version="v"):
        df = spark.createDataFrame(table, "scene_id STRING, k INT, value DOUBLE")

        def compute(stale):
            asked.append(sorted(r.scene_id for r in stale.collect()))
            return df.filter("value > 0").join(stale, "scene_id", "left_semi").groupBy("scene_id").agg(F.sum("value").alias("total"))

        got = refresh_scenes(scene_keys([df], version), str(tmp_path / "store"), compute)
        return {r.scene_id: r.total for r in got.collect()}

    assert refreshed(rows) == {"a": 1.0, "b": 1.0, "7": 1.0}
    assert refreshed(rows[::-1]) == {"a": 1.0, "b": 1.0, "7": 1.0}
    # A value moves from one row to the missing one; a scene loses all its result rows; a scene goes.
    changed = [("a", 1, None) if r[:2] == ("a", 1) else ("a", 2, 1.0) if r[:2] == ("a", 2) else r for r in rows]
    changed = [(s, k, None) if s == "b" else (s, k, v) for s, k, v in changed if s != "7"]
    assert refreshed(changed) == {"a": 1.0}
    assert refreshed(changed, "w") == {"a": 1.0}
    assert asked == [["7", "a", "b"], [], ["a", "b"], ["a", "b"]]


def small_scenes(spark, n):
    return spark.range(n * 4, numPartitions=2).selectExpr("concat('s', id div 4) AS scene_id", "1L AS site_id", "CAST(id % 4 div 2 AS INT) AS row", "CAST(id % 2 AS INT) AS col")


@pytest.mark.parametrize("step", [polygons.block_chains, lambda cells: components.block_labels(cells.drop("site_id"))])
def test_small_blocks_are_spread_over_tasks(spark, step):
    found = step(small_scenes(spark, 40)).select("scene_id", F.spark_partition_id().alias("task")).distinct()
    assert found.select("scene_id").distinct().count() == 40
    assert found.select("task").distinct().count() > 1


def test_a_store_takes_few_files_and_skips_broken_runs(spark, tmp_path):
    store, cells = tmp_path / "store", small_scenes(spark, 60)

    def refreshed():
        found = refresh_scenes(scene_keys([cells], "v"), str(store), lambda stale: cells.join(stale, "scene_id", "left_semi"))
        return sorted(tuple(r) for r in found.select(*cells.columns).collect())

    want = sorted(tuple(r) for r in cells.collect())
    assert refreshed() == want
    assert len(list(store.rglob("*.parquet"))) <= 16
    whole = next((store / "rows").iterdir())
    shutil.copytree(whole, store / "rows" / "run=rzz")  # rows of a run that broke off before its keys
    assert refreshed() == want
    assert len(list((store / "keys").iterdir())) == 1


def test_features_are_written_by_many_tasks(spark, tmp_path):
    features = spark.range(40, numPartitions=2).selectExpr("concat('s', id) AS scene_id", "1 AS rank", "concat('{\"id\":', id, '}') AS feature")
    write_features(features.repartition("scene_id"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 40
    assert len({f.name.split("-")[1] for f in (tmp_path / "out").rglob("part-*")}) > 1
