"""Queries of printed tables, buildings and georeferencing: words of conversations as glyphs, customers as control points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cover as V
from ..operators import layout as Y
from ..operators import ledger as L
from ..operators import spatial as S
from .base import Catalog, table
from .spatial import CELL_SQL, OBST_SQL, RP_SQL, cells, obstacles, raster_points

C = Catalog()
QUERIES, ORACLE = C.QUERIES, C.ORACLE

GLYPH_SQL = "gl AS (SELECT l_orderkey % 200 AS doc_id, l_linenumber::BIGINT AS page, row_number() OVER (PARTITION BY l_orderkey % 200, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, substr(l_returnflag, 1, 1) AS text FROM lineitem), g AS (SELECT *, (i % 12) * 5.0 AS x0, (i % 12) * 5.0 + 4.0 AS x1, (i // 12) * 10.0 AS top, (i // 12) * 10.0 + 8.0 AS bottom FROM gl)"


def glyphs(spark, sf_dir):
    """Line items of 200 documents as glyphs in rows of twelve."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy(F.col("l_orderkey") % 200, "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    g = li.select((F.col("l_orderkey") % 200).alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.substring("l_returnflag", 1, 1).alias("text"))
    x, y = (F.col("i") % 12) * 5.0, F.floor(F.col("i") / 12) * 10.0
    return g.select("*", x.alias("x0"), (x + 4.0).alias("x1"), y.alias("top"), (y + 8.0).alias("bottom"), F.lit(8.0).alias("size"), F.lit(1.0).alias("m0"))


def cell_grid(spark, sf_dir):
    """Three columns of 20 and rows of 20 on each page."""
    pages = glyphs(spark, sf_dir).groupBy("doc_id", "page").agg(F.max("bottom").alias("h"))
    c = pages.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.floor(F.col("h") / 20))).alias("r")).select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c"))
    return c.select("doc_id", "page", (F.col("r") * 3 + F.col("c")).alias("cell"), (F.col("c") * 20.0).alias("cx0"), (F.col("c") * 20.0 + 19.0).alias("cx1"), (F.col("r") * 20.0).alias("cy0"), (F.col("r") * 20.0 + 19.0).alias("cy1"))


@C.add(f"WITH {GLYPH_SQL} SELECT doc_id, page, i, (i // 24) * 3 + (i % 12) // 4 AS cell FROM g")
def glyph_to_cell(spark, sf_dir):
    return Y.glyph_to_cell(glyphs(spark, sf_dir), cell_grid(spark, sf_dir)).select("doc_id", "page", "i", "cell")


@C.add(f"WITH {GLYPH_SQL}, l AS (SELECT doc_id, page, (i // 24) * 3 + (i % 12) // 4 AS cell, i // 12 AS row, string_agg(text, '' ORDER BY i) AS t FROM g GROUP BY ALL) SELECT doc_id, page, cell, string_agg(t, chr(10) ORDER BY row) AS text FROM l GROUP BY doc_id, page, cell")
def cell_text_assemble(spark, sf_dir):
    return Y.cell_text(Y.glyph_to_cell(glyphs(spark, sf_dir), cell_grid(spark, sf_dir)))


@C.add(f"WITH {GLYPH_SQL} SELECT doc_id, page, i // 12 AS line, string_agg(text, '' ORDER BY i) AS text FROM g GROUP BY doc_id, page, i // 12 HAVING regexp_matches(string_agg(text, '' ORDER BY i), '^[AN]')")
def glyph_runs(spark, sf_dir):
    r = Y.glyph_runs(glyphs(spark, sf_dir), "^[AN]")
    return r.select("doc_id", "page", F.floor(F.col("y") / 10).alias("line"), "text")


@C.add(f"WITH {GLYPH_SQL} SELECT doc_id, page, i // 12 AS line, round(avg((x0 + x1) / 2), 6) AS x, round(avg((top + bottom) / 2), 6) AS y FROM g GROUP BY doc_id, page, i // 12")
def glyph_centroid(spark, sf_dir):
    r = Y.glyph_runs(glyphs(spark, sf_dir), ".")
    return r.select("doc_id", "page", F.floor(F.col("y") / 10).alias("line"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@C.add(f"WITH {GLYPH_SQL}, e AS (SELECT doc_id, page, round_even(x0 / 10, 0) AS x, top, bottom FROM g), h AS (SELECT doc_id, page, max(bottom) - min(top) AS height FROM g GROUP BY ALL) SELECT doc_id, page, x, sum(bottom - top) AS span FROM e JOIN h USING (doc_id, page) GROUP BY doc_id, page, x, height HAVING sum(bottom - top) >= 1.2 * height")
def column_rules(spark, sf_dir):
    e = glyphs(spark, sf_dir).select("doc_id", "page", F.lit("v").alias("orientation"), (F.col("x0") / 10).alias("x0"), "top", "bottom")
    return Y.column_rules(e, 1.2)


@C.add(f"WITH {GLYPH_SQL}, p AS (SELECT DISTINCT doc_id, page, CASE WHEN doc_id % 2 = 0 THEN 40.0 ELSE 60.0 END AS width FROM g), n AS (SELECT *, CASE WHEN width > 50 THEN 2 ELSE 1 END AS n FROM p), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT doc_id, (before + 1 + (n = 2 AND x0 + 2 >= width / 2)::INT)::BIGINT AS page, g.page * 10000 + i AS i, x0 - CASE WHEN n = 2 AND x0 + 2 >= width / 2 THEN width / 2 ELSE 0 END AS x0 FROM g JOIN b USING (doc_id, page)")
def two_up_split(spark, sf_dir):
    g = glyphs(spark, sf_dir)
    pages = g.select("doc_id", "page").distinct().withColumn("width", F.when(F.col("doc_id") % 2 == 0, 40.0).otherwise(60.0))
    return Y.two_up_split(pages, g.withColumn("i", F.col("page") * 10000 + F.col("i")), limit=50.0).select("doc_id", "page", "i", "x0")


@C.add("WITH r AS (SELECT s_nationkey AS doc_id, s_suppkey AS seq, CASE s_suppkey % 3 WHEN 0 THEN 'Road' WHEN 1 THEN 'works' ELSE 'Parks' END AS dept FROM supplier), n AS (SELECT *, lead(dept) OVER w AS nx, lag(dept) OVER w AS pv FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq, CASE WHEN dept = 'Road' AND nx = 'works' THEN 'Roadworks' WHEN dept = 'works' AND pv = 'Road' THEN 'Roadworks' ELSE dept END AS whole FROM n")
def dept_fragment_join(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    r = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("seq"), F.when(k == 0, "Road").when(k == 1, "works").otherwise("Parks").alias("dept"))
    return Y.fragment_join(r, spark.createDataFrame([("Roadworks",), ("Waterworks",)], "dept string")).select("doc_id", "seq", "whole")


@C.add("WITH r AS (SELECT conv_id AS doc_id, turn AS seq, CASE WHEN (conv_id + turn) % 3 = 0 THEN '○' ELSE coalesce(text, '') END AS text FROM conversations), n AS (SELECT *, text = '○' AS mark, lead(text = '○') OVER w AS nx, lag(text = '○') OVER w AS pv FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq, CASE WHEN pv AND NOT mark THEN '○' ELSE '' END || text AS text FROM n WHERE NOT (mark AND coalesce(NOT nx, false))")
def dept_marker_hold(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "○").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return Y.marker_hold(r)


@C.add("WITH r AS (SELECT s_nationkey AS doc_id, s_suppkey AS seq, CASE WHEN s_suppkey % 7 = 0 THEN 'G' || s_suppkey END AS g, CASE WHEN s_suppkey % 3 = 1 THEN 'D' || s_suppkey END AS d, s_suppkey % 5 AS k FROM supplier), f AS (SELECT *, last_value(g IGNORE NULLS) OVER w AS grp, last_value(d IGNORE NULLS) OVER w AS dept FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq, grp, dept FROM f WHERE k > 0 AND g IS NULL")
def reconsult_rows(spark, sf_dir):
    k = F.col("s_suppkey")
    text = lambda test, p: F.when(test, F.concat(F.lit(p), k.cast("string"))).otherwise("")
    r = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), k.alias("seq"), text(k % 7 == 0, "G").alias("grp"), text(k % 3 == 1, "D").alias("dept"), F.when(k % 5 > 0, "x").otherwise("").alias("opinion"))
    f = L.fill_down(r, {"grp": None, "dept": None})
    return f.where("opinion <> '' and grp = ''").select("doc_id", "seq", F.col("grp_filled").alias("grp"), F.col("dept_filled").alias("dept"))


@C.add("SELECT s_nationkey AS doc_id, s_suppkey AS seq, last_value(CASE WHEN s_suppkey % 4 = 0 THEN s_name END IGNORE NULLS) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS org FROM supplier")
def major_rows(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("seq"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise("").alias("org"))
    return L.fill_down(r, {"org": None}).select("doc_id", "seq", F.col("org_filled").alias("org"))


@C.add()
def cell_merge_regions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select((F.col("l_orderkey") % 500).alias("doc_id"), F.lit(1).cast("long").alias("page"), (F.col("l_partkey") % 6).alias("row"), (F.col("l_suppkey") % 5).alias("col"), (F.col("l_quantity") > 20), F.col("l_discount")).toDF("doc_id", "page", "row", "col", "q", "d")
    g = c.groupBy("doc_id", "page", "row", "col").agg(F.bool_or("q").alias("left_rule"), (F.max("d") > 0.06).alias("top_rule"))
    return Y.merge_regions(g)


@C.add(f"WITH {OBST_SQL}, c AS (SELECT obstacle, ox, oy, r, unnest(generate_series(floor(ox - r - 1.5)::BIGINT, floor(ox + r + 1.5)::BIGINT)) AS cx FROM obs), d AS (SELECT *, unnest(generate_series(floor(oy - r - 1.5)::BIGINT, floor(oy + r + 1.5)::BIGINT)) AS cy FROM c) SELECT obstacle, cx, cy FROM d WHERE greatest(abs(cx + 0.5 - ox) - r, 0) ** 2 + greatest(abs(cy + 0.5 - oy) - r, 0) ** 2 <= 1.5 ** 2")
def building_mask(spark, sf_dir):
    m = V.building_mask(obstacles(spark, sf_dir).withColumnRenamed("obstacle", "building"))
    return V.run_cells(m).withColumnRenamed("building", "obstacle").select("obstacle", "cx", "cy")


@C.add(f"""WITH RECURSIVE {CELL_SQL}, h AS (SELECT raster_id, row, col, v FROM ras WHERE v > 1.2),
 near AS (SELECT a.raster_id, a.row, a.col, b.row AS r2, b.col AS c2 FROM h a JOIN h b ON b.raster_id = a.raster_id AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1),
 reach AS (SELECT raster_id, row, col, row AS lr, col AS lc FROM h UNION SELECT n.raster_id, r2, c2, lr, lc FROM reach JOIN near n USING (raster_id, row, col)),
 lab AS (SELECT raster_id, row, col, min({{'r': lr, 'c': lc}}) AS label FROM reach GROUP BY ALL), j AS (SELECT * FROM lab JOIN h USING (raster_id, row, col)),
 g AS (SELECT raster_id, label, count(*) AS cells, list_sort(list(v)) AS vs, avg(v) AS m, (max(row) - min(row) + 1) AS height, (max(col) - min(col) + 1) AS width FROM j GROUP BY ALL)
SELECT raster_id, label.r || '/' || label.c AS label, cells, round(cells * 4.0, 4)::DOUBLE AS area, round(vs[floor((cells - 1) * 0.2 + 0.5)::BIGINT + 1], 6)::DOUBLE AS eave, round(vs[floor((cells - 1) * 0.95 + 0.5)::BIGINT + 1], 6)::DOUBLE AS ridge, round(m * cells * 4.0, 5)::DOUBLE AS volume, height, width FROM g""")
def building_component(spark, sf_dir):
    high = cells(spark, sf_dir).where("v > 1.2").select("raster_id", "row", "col", "v")
    s = S.building_shapes(S.building_components(high), 4.0)
    return s.select("raster_id", F.concat_ws("/", "label.row", "label.col").alias("label"), "cells", F.round("area", 4).alias("area"), F.round("eave", 6).alias("eave"), F.round("ridge", 6).alias("ridge"), F.round("volume", 5).alias("volume"), "height", "width")


@C.add()
def affine_fit_ransac(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (k % 300).cast("double"), (k * 7 % 200).cast("double")
    off = F.when(k % 10 == 0, 300.0).otherwise((k % 5 - 2) / 2.0)
    p = table(spark, sf_dir, "customer").select(x.alias("px"), y.alias("py"), (1000 + 5 * x - 0.03 * y + off).alias("gx"), (2000 + 0.03 * x + 5 * y - off).alias("gy"))
    return S.affine_ransac(p)


@C.add()
def contour_chain(spark, sf_dir):
    lines = S.chain_segments(S.contour_segments(cells(spark, sf_dir), (0.5, 1.5)))
    return lines.select("raster_id", "level", "line", "place", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", "closed")


@C.add(f"""WITH {CELL_SQL}, m AS (SELECT raster_id, median(v) AS mid FROM ras GROUP BY raster_id), f AS (SELECT raster_id, row, col, coalesce(v, mid) AS v FROM ras JOIN m USING (raster_id)), q AS (SELECT raster_id, r, c, r * 2 AS row, c * 2 AS col FROM m, (SELECT unnest(generate_series(0, 9)) AS r), (SELECT unnest(generate_series(0, 19)) AS c))
SELECT q.raster_id, r::INT AS row, c::INT AS col, CASE WHEN v IS NULL THEN -32768 ELSE round_even(v * 10, 0) END::INT AS dm FROM q LEFT JOIN f ON f.raster_id = q.raster_id AND f.row = q.row AND f.col = q.col""")
def grid_resample(spark, sf_dir):
    return S.resample(cells(spark, sf_dir), 10, 20, 2.0)


@C.add(f"""WITH {CELL_SQL}, {RP_SQL}, c AS (SELECT id, raster_id, i * 2 + j AS k, floor(row)::BIGINT + i AS row, floor(col)::BIGINT + j AS col, (CASE WHEN i = 1 THEN row - floor(row) ELSE 1 - row + floor(row) END) * (CASE WHEN j = 1 THEN col - floor(col) ELSE 1 - col + floor(col) END) AS w FROM rp, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
 s AS (SELECT id, count(*) AS n, sum(w * v) AS s, arg_min(v, k) AS first FROM c JOIN ras USING (raster_id, row, col) WHERE v IS NOT NULL GROUP BY id) SELECT rp.id, round(CASE WHEN n = 4 THEN s ELSE first END, 8) AS value FROM rp LEFT JOIN s USING (id)""")
def raster_sample_viewer(spark, sf_dir):
    return S.sample_viewer(raster_points(spark, sf_dir), cells(spark, sf_dir)).select("id", F.round("value", 8).alias("value"))


@C.add("SELECT doc_id, source, text FROM documents")
def src_json_records(spark, sf_dir):
    """Documents as the JSON lines of an archive, parsed with an explicit schema."""
    raw = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "source", "text")).alias("line"))
    return raw.select(F.from_json("line", "doc_id long, source string, text string").alias("r")).select("r.doc_id", "r.source", "r.text")
