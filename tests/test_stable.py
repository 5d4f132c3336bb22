"""Numbering of whole tables."""

from pyspark.sql import functions as F

from landlens.operators.stable import number_rows


def test_number_rows_equals_the_sorted_order(spark):
    rows = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(3))).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("v"), "id")
    got = number_rows(rows, [F.desc_nulls_last("v"), F.asc("k"), F.desc("id")], "at").collect()
    want = sorted(rows.collect(), key=lambda r: (r.v is None, -(r.v or 0), r.k, -r.id))
    assert [(r.id, i + 1) for i, r in enumerate(want)] == [(r.id, r["at"]) for r in sorted(got, key=lambda r: r["at"])]
    assert number_rows(rows.limit(0), ["id"]).count() == 0


def test_one_value_in_all_rows(spark):
    rows = spark.range(300).select(F.lit("same").alias("k"))
    assert sorted(r.place for r in number_rows(rows, ["k"]).collect()) == list(range(1, 301))
