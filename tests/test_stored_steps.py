"""Steps that are stored or dealt anew, so that nothing is made twice or by one task."""

from pyspark.sql import functions as F

from landlens.operators import cover as V
from landlens.plans import incremental


def test_buildings_are_dealt_to_tasks_before_they_are_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(V, "BUILDINGS", 10)
    k = F.col("id")
    at = lambda i, j: F.struct((k + i * (5 + k % 3)).cast("double").alias("x"), (j * (5 + k % 3)).cast("double").alias("y"))
    b = spark.range(0, 100, 1, 1).select(k.alias("building"), F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)).alias("ring"))
    mask = V.building_mask(b)
    assert mask.rdd.getNumPartitions() == 11
    assert {r.building for r in mask.collect()} == set(range(100))
    edges = V.near_edges(b.select("building", F.array("ring").alias("rings")), ["building"], 1.0, 1.5)
    assert edges.where("building = 0 and c1 > c0").count() > 0 and edges.where("building = 0").count() < 4 * 16


def test_an_archive_tags_each_item_once(spark, sf_dir):
    plan = incremental.inc_news(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "Join" not in plan
