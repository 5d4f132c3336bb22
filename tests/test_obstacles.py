"""Obstacles over points against the test of each ring, and many of them over one place."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from landlens.functions import geo as G
from landlens.operators import spatial as S

SHAPE = "obstacle long, ox double, oy double, ring array<struct<x:double,y:double>>"


def square(k, x, y, r):
    return (k, x, y, [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)])


@pytest.mark.parametrize("size", [10.0, 7.3])
def test_obstacles_equal_the_test_of_each_ring(spark, size):
    rng = random.Random(4)
    rows = [square(k, float(rng.randint(-60, 60)), float(rng.randint(-60, 60)), float(rng.randint(1, 50))) for k in range(100, 160)]
    for k in range(40):  # stars, some far from their stated centre
        x, y, r, n = rng.uniform(-60, 60), rng.uniform(-60, 60), rng.uniform(2, 90), rng.choice([3, 8, 40])
        turn = sorted(rng.random() * 2 * math.pi for _ in range(n))
        ring = [(x + r * (0.3 + 0.7 * rng.random()) * math.cos(t), y + r * (0.3 + 0.7 * rng.random()) * math.sin(t)) for t in turn]
        rows.append((k, x + rng.choice([0.0, 30.0, 90.0]), y, ring))
    rows += [square(5, 0.0, 0.0, 500.0), (3, 0.0, 0.0, [(-60.0, -60.0), (60.0, 60.0), (60.0, -60.0), (-60.0, 60.0)]), rows[0], (900, 1.0, 1.0, []), (901, 1.0, 1.0, None), (902, None, 1.0, rows[0][3])]
    rows += [(1, 10.0, 10.0, [(0.0, 0.0), (None, 5.0), (30.0, 30.0), (0.0, 30.0)]), (2, float("inf"), 10.0, rows[0][3]), (4, 20.0, 20.0, [(0.0, 0.0), (float("inf"), 0.0), (30.0, 30.0)])]
    o = spark.createDataFrame(rows, SHAPE)
    points = [(i, rng.uniform(-130, 130), rng.uniform(-130, 130)) for i in range(1500)] + [(5000 + 60 * i + j, 4.0 * i - 120, 4.0 * j - 120) for i in range(60) for j in range(60)]
    points += [(90001, None, 1.0), (90002, float("nan"), 1.0)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    hit = p.crossJoin(F.broadcast(o)).where((F.abs(F.col("x") - F.col("ox")) <= 40) & (F.abs(F.col("y") - F.col("oy")) <= 40) & G.in_ring(F.col("x"), F.col("y"), F.col("ring")))
    want = {r.id: r.obstacle for r in hit.groupBy("id").agg(F.min("obstacle").alias("obstacle")).collect()}
    got = {r.id: r.obstacle for r in S.obstacle_at_point(p, o, 40.0, size).collect()}
    assert set(got) == {r[0] for r in points} and len(set(want.values())) > 10
    assert {k: v for k, v in got.items() if v is not None} == want


def test_obstacles_over_one_place_do_not_multiply_the_points(spark):
    k = F.col("id")
    at = lambda i, j: F.struct((k % 50 / 7 + i * (25 + k % 15 + k / 1e6)).alias("x"), (j * (25 + k % 15 + k / 1e6)).alias("y"))
    o = spark.range(3_000).select(k.alias("obstacle"), (k % 50 / 7).alias("ox"), F.lit(0.0).alias("oy"), F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)).alias("ring"))
    p = spark.range(60_000).select("id", (k % 39 - 19).cast("double").alias("x"), (k % 37 - 18).cast("double").alias("y"))
    began = time.time()
    assert S.obstacle_at_point(p, o).where("obstacle is not null").count() > 50_000
    assert time.time() - began < 60
