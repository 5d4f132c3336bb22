"""The comparison of opinions with documents: nothing of a document but its best matches leaves the task that reads it."""

from pyspark.sql import functions as F

from landlens.operators import evidence as E


def test_documents_give_their_best_matches_only(spark):
    k = F.col("id")
    text = lambda n: F.concat(F.lit("the same words "), (k % n).cast("string"), F.lit(" and more of them "), k.cast("string"))
    d = spark.range(0, 4000, 1, 4).select(k.alias("doc_id"), text(70).alias("norm"))
    o = spark.range(30).select(k.alias("opinion_id"), text(70).alias("norm"))
    found = E._best(E.grams(o, [], "opinion_id"), d, [])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert 30 <= found.count() <= 4 * 30
    got = {r.opinion_id: (r.doc_id, r.score) for r in E.coverage(o, d).collect()}
    assert got == {i: (i, 1.0) for i in range(30)}
