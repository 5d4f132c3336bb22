"""Levels of a raster, each from the stored one before."""

from pyspark.sql import functions as F

from landlens.operators import spatial as S


def test_levels_are_stored_and_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "PYRAMID_CELLS", 100)
    k = F.col("id")
    cells = spark.range(2 * 37 * 23).select((k % 2).alias("raster_id"), F.floor(k / 2 / 23).alias("row"), (F.floor(k / 2) % 23).alias("col"), F.when(k % 7 > 0, (k % 13).cast("double")).alias("v"))
    got = S.pyramid(cells)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    have, rows, cols, cur = got.collect(), 37, 23, cells
    assert len({(r.level, r.raster_id, r.row, r.col) for r in have}) == len(have)
    for level in (1, 2):
        cur, rows, cols = S.halve(cur, rows, cols), rows // 2, cols // 2
        assert sorted((r.raster_id, r.row, r.col, r.v is None, round(r.v or 0, 9)) for r in have if r.level == level) == sorted((r.raster_id, r.row, r.col, r.v is None, round(r.v or 0, 9)) for r in cur.collect())
    assert {r.level for r in have} == {1, 2}
