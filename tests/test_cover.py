"""Polygons in cells against point tests of every cell and point."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landlens.functions import geo as G
from landlens.operators import cover as V

SHAPE = "zone string, ord int, rings array<array<struct<x:double,y:double>>>"


def star(rng, x, y, r, n):
    turn = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(x + r * (0.3 + 0.7 * rng.random()) * math.cos(t), y + r * (0.3 + 0.7 * rng.random()) * math.sin(t)) for t in turn]


@pytest.fixture(scope="module")
def shapes(spark):
    """Stars of many corners, whole-numbered shapes with edges along the cells' sides, crossing edges, holes, odd rings."""
    rng = random.Random(5)
    rows = [(f"s{i}", i % 5, [star(rng, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(3, 40), rng.choice([3, 7, 60]))]) for i in range(25)]
    rows.append(("box", 7, [[(-30.0, -30.0), (30.0, -30.0), (30.0, 30.0), (-30.0, 30.0)], [(-10.0, -10.0), (20.0, -10.0), (20.0, 10.0), (-10.0, 10.0)], [(0.0, 0.0), (25.0, 0.0), (25.0, 25.0)]]))
    rows.append(("diamond", 8, [[(0.0, -20.0), (20.0, 0.0), (0.0, 20.0), (-20.0, 0.0)]]))
    rows.append(("bow", 9, [[(-20.0, -20.0), (20.0, 20.0), (20.0, -20.0), (-20.0, 20.0)]]))
    rows += [("line", 10, [[(0.0, 0.0), (9.0, 9.0)]]), ("none", 11, []), ("null", 12, None)]
    return spark.createDataFrame(rows, SHAPE).cache()


def in_any(shapes, points):
    return shapes.where("zone not in ('line', 'none', 'null')").crossJoin(points).where(G.in_polygon(F.col("x"), F.col("y"), F.col("rings")))


@pytest.mark.parametrize("size", [10.0, 3.7])
def test_points_in_zones_equal_the_test_of_each_ring(spark, shapes, size):
    rng = random.Random(6)
    rows = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(2000)]
    rows += [(5000 + 100 * i + j, float(i - 40), float(j - 40)) for i in range(0, 80, 2) for j in range(0, 80, 2)]  # corners and sides
    rows += [(90001, None, 1.0), (90002, float("nan"), 1.0), (90003, 1.0, float("inf"))]
    points = spark.createDataFrame(rows, "id long, x double, y double").cache()
    got = {r.id: r.zone for r in V.points_in_zones(points, shapes, size).collect()}
    best = in_any(shapes, points.where("id < 90000")).groupBy("id").agg(F.min(F.struct("ord", "zone")).alias("f"))
    want = {r.id: r.f.zone for r in best.collect()}
    assert set(got) == {r[0] for r in rows} and len(set(want.values())) > 10
    assert {k: v for k, v in got.items() if v} == want


def test_burn_union_difference(spark, shapes, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    centres = spark.range(-90, 90).select(F.col("id").alias("cx")).crossJoin(spark.range(-90, 90).select(F.col("id").alias("cy"))).select("cx", "cy", (F.col("cx") + 0.5).alias("x"), (F.col("cy") + 0.5).alias("y"))
    hit = {(r.zone, r.ord, r.cx, r.cy) for r in in_any(shapes, centres).select("zone", "ord", "cx", "cy").collect()}
    runs = V.burn(shapes, ["zone", "ord"], 1.0)
    got = [tuple(r) for r in V.run_cells(runs).collect()]
    assert len(got) == len(set(got)) and set(got) == hit
    union = [tuple(r) for r in V.run_cells(V.cells_union(shapes, ["zone", "ord"], ["ord"], 1.0)).collect()]
    assert len(union) == len(set(union)) and set(union) == {(o, x, y) for _, o, x, y in hit}
    parts = V.cells_union(shapes.where("ord < 3"), ["zone", "ord"], [], 1.0)
    left = V.cells_difference(runs.where("zone = 'box'"), parts)
    assert {tuple(r) for r in V.run_cells(left).collect()} == {(x, y) for z, _, x, y in hit if z == "box"} - {(x, y) for _, o, x, y in hit if o < 3}
    assert {r.ord: r.area for r in V.run_area(V.cells_union(shapes, ["zone", "ord"], ["ord"], 1.0), ["ord"], 1.0).collect()}[8] == sum(o == 8 for _, o, _, _ in hit)


def test_building_mask_equals_the_test_of_each_cell(spark, shapes):
    b = shapes.where("zone like 's%' or zone = 'diamond'").select(F.col("zone").alias("building"), F.col("rings")[0].alias("ring"))
    centres = spark.range(-90, 90).select(F.col("id").alias("cx")).crossJoin(spark.range(-90, 90).select(F.col("id").alias("cy")))
    x, y = F.col("cx") + 0.5, F.col("cy") + 0.5
    want = b.crossJoin(centres).where(G.in_ring(x, y, F.col("ring")) | (G.distance_to_ring(x, y, F.col("ring")) <= 1.5))
    got = [tuple(r) for r in V.run_cells(V.building_mask(b)).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in want.select("building", "cx", "cy").collect()}


def test_empty_tables(spark, shapes):
    none, points = shapes.limit(0), spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert [r.zone for r in V.points_in_zones(points, none, 5.0).collect()] == [None]
    assert V.burn(none, ["zone"], 1.0).count() == 0 and V.points_in_zones(points.limit(0), shapes, 5.0).count() == 0
