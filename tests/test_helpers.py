"""Longest common runs against all pairs of starts, and the cells of a page against every cell."""

import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landlens.functions import helpers as H
from landlens.operators import layout as Y


def every_start(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("ab가", max_size=24), st.text("ab가", max_size=24))
def test_longest_run_equals_all_pairs_of_starts(a, b):
    assert H.longest_run(a, b) == every_start(a, b)


def test_longest_run_of_repetitive_texts_is_linear():
    n = 100_000
    began = time.time()
    assert H.longest_run("a" * n + "b", "b" + "a" * n) == (0, 1, n)
    assert H.longest_run("ab" * (n // 2), "ba" * (n // 2)) == (0, 1, n - 1)
    assert time.time() - began < 20


def test_excerpts_of_the_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text")
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    rows = pairs.select("text", "other", H.longest_common_excerpt("text", "other").alias("got")).orderBy("doc_id").limit(60).collect()

    def want(a, b):
        m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        return b[max(0, m.b - 15) : m.b + m.size + 16] if m.size >= 8 else ""

    assert [r.got for r in rows] == [want(r.text, r.other) for r in rows] and any(r.got for r in rows)
    odd = spark.createDataFrame([(None, "x"), ("x", None), ("", ""), ("12345678", "12345678")], "a string, b string")
    assert [r.e for r in odd.select(H.longest_common_excerpt("a", "b").alias("e")).collect()] == ["", "", "", "12345678"]


def test_glyphs_meet_cells_of_any_size_and_place(spark):
    rng = random.Random(3)
    cells = [(1, 1, c, x, x + rng.choice([3.0, 30.0, 250.0]), y, y + rng.choice([3.0, 30.0, 250.0])) for c in range(40) for x, y in [(rng.uniform(-50, 200), rng.uniform(-50, 200))]]
    cells += [(1, 1, 90, 39.5, 40.0, 0.0, 40.0), (1, 2, 91, 0.0, 10.0, 0.0, 10.0), (1, 2, 92, None, 10.0, 0.0, 10.0), (1, 2, 93, 0.0, float("inf"), 0.0, 10.0)]
    glyphs = [(1, 1, i, "g", x, x + 2.0, y, y + 2.0) for i in range(600) for x, y in [(rng.uniform(-80, 300), rng.uniform(-80, 300))]]
    glyphs += [(1, 1, 900, "pad", 39.5, 41.5, 3.0, 5.0), (1, 2, 901, "edge", 9.5, 11.5, 3.0, 5.0), (1, 2, 902, "out", 9.6, 11.6, 3.0, 5.0), (1, 2, 903, "odd", None, 1.0, 1.0, 1.0), (1, 2, 904, "odd", float("nan"), 1.0, 1.0, 1.0)]
    g = spark.createDataFrame(glyphs, "doc_id long, page long, i long, text string, x0 double, x1 double, top double, bottom double")
    c = spark.createDataFrame(cells, "doc_id long, page long, cell long, cx0 double, cx1 double, cy0 double, cy1 double")
    want = {}
    for _, page, i, _, x0, x1, top, bottom in glyphs:
        fits = [cell for _, p, cell, a, b, lo, hi in cells if p == page and None not in (x0, a) and b < 1e9 and a - 0.5 <= (x0 + x1) / 2 <= b + 0.5 and lo - 0.5 <= (top + bottom) / 2 <= hi + 0.5]
        if fits:
            want[i] = min(fits)
    got = [(r.i, r.cell) for r in Y.glyph_to_cell(g, c).collect()]
    assert len(got) == len(want) and dict(got) == want and 901 in want and 902 not in want


def test_the_index_of_cells_is_not_sent_through_the_driver(spark):
    g = spark.range(50).selectExpr("1L doc_id", "1L page", "id i", "'g' text", "5.0 * id x0", "5.0 * id + 4 x1", "0.0 top", "8.0 bottom")
    c = spark.range(5).selectExpr("1L doc_id", "1L page", "id cell", "20.0 * id cx0", "20.0 * id + 19 cx1", "0.0 cy0", "19.0 cy1")
    hit = Y.glyph_to_cell(g, c)
    assert hit.count() == 20 and "Broadcast" not in hit._jdf.queryExecution().executedPlan().toString()
