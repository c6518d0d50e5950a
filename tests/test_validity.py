"""Validity of areas: named cases, random rings against all pairs, and one long ring."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from terralux import schema
from terralux.sources import rasters
from terralux.operators import validity

AREA = "aoi_id STRING, polygons ARRAY<ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>"


def box(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


BIG = box(0, 0, 10)
CASES = {
    "square": ([[BIG]], set()),
    "open ring": ([[BIG[:-1]]], set()),
    "repeated corners": ([[[(0, 0), (0, 0), (5, 0), (5, 0), (5, 5), (0, 0), (0, 0)]]], set()),
    "bow tie": ([[[(0, 0), (5, 5), (5, 0), (0, 5), (0, 0)]]], {"self_intersection"}),
    "corner visited twice": ([[[(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0)]]], {"self_intersection"}),
    "corner on a side of its ring": ([[[(0, 0), (6, 0), (6, 6), (3, 0), (0, 6), (0, 0)]]], {"self_intersection"}),
    "spike": ([[[(0, 0), (6, 0), (9, 0), (6, 0), (6, 6), (0, 0)]]], {"self_intersection"}),
    "flat ring": ([[[(0, 0), (4, 0), (8, 0), (0, 0)]]], {"self_intersection"}),
    "point ring": ([[[(1, 1), (1, 1), (1, 1), (1, 1)]]], {"degenerate_ring"}),
    "hole": ([[BIG, box(2, 2, 3)]], set()),
    "hole touching the shell in a point": ([[BIG, [(0, 5), (3, 4), (3, 6), (0, 5)]]], set()),
    "hole touching a corner of the shell": ([[BIG, [(0, 0), (3, 1), (1, 3), (0, 0)]]], set()),
    "hole touching the shell twice": ([[BIG, [(0, 5), (5, 3), (10, 5), (5, 7), (0, 5)]]], {"disconnected_interior"}),
    "hole sharing a side": ([[BIG, box(0, 3, 3)]], {"rings_cross"}),
    "hole crossing the shell": ([[BIG, box(8, 8, 5)]], {"rings_cross"}),
    "hole leaving through a corner": ([[[(0, 0), (10, 0), (10, 10), (5, 5), (0, 10), (0, 0)], [(4, 2), (6, 2), (5, 5), (5, 9), (4, 2)]]], {"rings_cross"}),
    "hole outside its shell": ([[BIG, box(20, 20, 3)]], {"hole_outside"}),
    "hole around its shell": ([[box(3, 3, 2), BIG]], {"hole_outside"}),
    "hole outside, touching": ([[BIG, [(10, 5), (12, 4), (12, 6), (10, 5)]]], {"hole_outside"}),
    "nested holes": ([[BIG, box(1, 1, 6), box(2, 2, 2)]], {"nested_holes"}),
    "two holes touching once": ([[BIG, box(1, 1, 2), box(3, 3, 2)]], set()),
    "three holes in a cycle": ([[BIG, [(2, 2), (5, 2), (2, 5), (2, 2)], [(5, 2), (8, 2), (8, 5), (5, 2)], [(2, 5), (8, 5), (5, 8), (2, 5)]]], {"disconnected_interior"}),
    "chain of holes from side to side": ([[BIG, [(0, 5), (3, 4), (5, 5), (3, 6), (0, 5)], [(5, 5), (7, 4), (10, 5), (7, 6), (5, 5)]]], {"disconnected_interior"}),
    "two parts": ([[BIG], [box(20, 0, 3)]], set()),
    "parts touching in a corner": ([[BIG], [box(10, 10, 3)]], set()),
    "parts touching twice": ([[BIG], [[(10, 2), (15, 5), (10, 8), (13, 5), (10, 2)]]], set()),
    "parts sharing a side": ([[BIG], [box(10, 0, 3)]], {"parts_overlap"}),
    "overlapping parts": ([[BIG], [box(8, 8, 5)]], {"parts_overlap"}),
    "part inside a part": ([[BIG], [box(2, 2, 3)]], {"parts_overlap"}),
    "part around a part": ([[box(2, 2, 3)], [BIG]], {"parts_overlap"}),
    "equal parts": ([[BIG], [BIG]], {"parts_overlap"}),
    "part in a hole": ([[BIG, box(2, 2, 6)], [box(3, 3, 2)]], set()),
    "part in a hole, touching": ([[BIG, box(2, 2, 6)], [[(2, 2), (5, 3), (5, 5), (2, 2)]]], set()),
    "part crossing through a corner": ([[[(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (0, 0)]], [[(4, 5), (5, 5), (8, 4.9), (8, 5.1), (4, 5)]]], {"parts_overlap"}),
}


def frame(spark, cases):
    rows = [(name, [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts]) for name, parts in cases]
    return spark.createDataFrame(rows, AREA)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.aoi_id, set()).add(r.fault)
    return out


@pytest.mark.parametrize("shift", [0.0, 1e6 + 0.1])
def test_named_cases(spark, shift):
    cases = [(n, [[[(x + shift, y + shift / 3) for x, y in ring] for ring in part] for part in parts]) for n, (parts, _) in CASES.items()]
    got = found(validity.topology_faults(frame(spark, cases)))
    if shift:
        # Shifted corners are rounded, so only what does not hang on exact touching is the same.
        exact = {n for n in CASES if "touching" not in n and n not in ("corner on a side of its ring", "three holes in a cycle", "hole leaving through a corner", "part crossing through a corner")}
    else:
        exact = set(CASES)
    assert {n: got.get(n, set()) for n in exact} == {n: CASES[n][1] for n in exact}


def meets(a, b, c, d):
    """Whether two closed sides share a point, with fractions."""
    a, b, c, d = ((Fraction(p[0]), Fraction(p[1])) for p in (a, b, c, d))

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def on(p, q, r):
        return turn(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    if on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
        return True
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def simple(ring):
    sides = list(zip(ring[:-1], ring[1:], strict=True))
    n = len(sides)
    for i in range(n):
        for j in range(i + 1, n):
            (a, b), (c, d) = sides[i], sides[j]
            if j == i + 1 or (i == 0 and j == n - 1):
                far = d if j == i + 1 else c
                near = a if j == i + 1 else b
                joint = b if j == i + 1 else a
                # Neighbours may share their corner only.
                cross = (near[0] - joint[0]) * (far[1] - joint[1]) - (near[1] - joint[1]) * (far[0] - joint[0])
                dot = (near[0] - joint[0]) * (far[0] - joint[0]) + (near[1] - joint[1]) * (far[1] - joint[1])
                if cross == 0 and dot > 0:
                    return False
            elif meets(a, b, c, d):
                return False
    return True


@pytest.mark.parametrize("crowded", [32, 2])
def test_random_rings_against_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(validity, "CROWDED", crowded)
    rng = random.Random(crowded)
    rings = {}
    for k in range(160):
        n = rng.randint(3, 9)
        if k % 2:
            # Around a centre: simple unless corners coincide or line up.
            angles = sorted(rng.sample(range(40), n))
            ring = [(round(9 * rng.random() * math.cos(a / 40 * 6.2832), 1), round(9 * rng.random() * math.sin(a / 40 * 6.2832), 1)) for a in angles]
        else:
            ring = [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(n)]
        ring = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
        if ring[0] == ring[-1]:
            ring = ring[:-1]
        if len(ring) >= 3:
            rings[str(k)] = [*ring, ring[0]]
    got = found(validity.topology_faults(frame(spark, [(k, [[r]]) for k, r in rings.items()])))
    assert {k for k in rings if k in got} == {k for k, r in rings.items() if not simple(r)}
    assert 20 < len(got) < len(rings) - 20


def test_long_ring_meets_few_pairs(spark):
    n = 100_000
    corner = F.struct((F.cos(F.col("id") * (2 * math.pi / n)) * (1 + 0.2 * F.sin(F.col("id") * 0.01))).alias("x"), (F.sin(F.col("id") * (2 * math.pi / n)) * (1 + 0.2 * F.sin(F.col("id") * 0.01))).alias("y"))
    ring = spark.range(n).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", corner.alias("p")))), lambda v: v["p"]).alias("r"))
    areas = ring.select(F.lit("long").alias("aoi_id"), F.array(F.array("r")).alias("polygons"))
    dealt = validity.squared(validity.with_grid(validity.ring_sides(areas)))
    per_square = dealt.groupBy("_ix", "_iy", "_jx", "_jy").count().agg(F.sum(F.col("count") * F.col("count")), F.max("count")).first()
    assert per_square[0] < 60 * n and per_square[1] < 300
    assert validity.topology_faults(areas).count() == 0


def test_far_protected_areas_are_not_read(spark, tmp_path):
    rows = [(k, x, y, x + 2.0, y + 2.0, [[(x, y), (x + 2.0, y), (x, y + 2.0), (x, y)]]) for k, (x, y) in enumerate((float(k % 50) * 10, float(k // 50) * 10) for k in range(2500))]
    areas = spark.createDataFrame(rows, schema.PROTECTED)
    path = str(tmp_path / "areas")
    rasters.write_protected(areas.repartition(7), path)
    near, available = rasters.read_protected(spark, path, (95.0, 95.0, 112.0, 112.0))
    assert available and {r.area_id for r in near.collect()} == {r[0] for r in rows if r[3] >= 95 and r[1] <= 112 and r[4] >= 95 and r[2] <= 112}
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    pushed = near.filter("true")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{f}(" in pushed.split("PushedFilters")[1] for f in ("GreaterThanOrEqual", "LessThanOrEqual"))
    # Neighbours lie together: no file spans more than a part of the whole extent.
    spans = [(f.maxx - f.minx) * (f.maxy - f.miny) for f in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("minx").alias("minx"), F.max("maxx").alias("maxx"), F.min("miny").alias("miny"), F.max("maxy").alias("maxy")).collect()]
    assert len(spans) == 1 or max(spans) < 0.8 * 492 * 492
    rasters.write_protected(areas.limit(0), str(tmp_path / "none"))
    assert rasters.read_protected(spark, str(tmp_path / "none"), (0, 0, 1, 1))[0].count() == 0
    assert rasters.read_protected(spark, str(tmp_path / "absent"))[1] is False
