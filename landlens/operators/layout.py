"""Printed tables from glyphs and rules: cells, their text, runs of glyphs, columns, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def glyph_to_cell(glyphs: DataFrame, cells: DataFrame, pad: float = 0.5, grid: float = 40.0) -> DataFrame:
    """Glyphs with the cell of their page that holds their centre, cells padded; the first cell where several do.

    Each page has a grid of buckets of ``grid``. A padded cell stands in every bucket it touches, a glyph in the one of its
    centre, so a glyph is compared with the cells of one bucket, not with all of its page. The cells of a bucket are one
    sorted array; the glyphs need no aggregation. The index is made by ``explode`` from a few rows a page, which Spark takes
    for its size; the hint keeps it from being sent whole through the driver. Null or non-finite bounds hold nothing and are held by nothing."""
    finite = lambda *names: F.forall(F.array(*[F.col(n).cast("double") for n in names]), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    bucket = lambda v: F.floor(v / grid)
    over = lambda lo, hi: F.explode(F.sequence(bucket(F.col(lo) - pad), bucket(F.col(hi) + pad)))
    there = cells.where(finite("cx0", "cx1", "cy0", "cy1")).where("cx0 <= cx1 and cy0 <= cy1")
    keyed = there.select("doc_id", "page", F.struct("cell", "cx0", "cx1", "cy0", "cy1").alias("c"), over("cx0", "cx1").alias("bx"), "cy0", "cy1").select("doc_id", "page", "c", "bx", over("cy0", "cy1").alias("by"))
    index = keyed.groupBy("doc_id", "page", "bx", "by").agg(F.array_sort(F.collect_list("c")).alias("cells"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    g = glyphs.where(finite("x0", "x1", "top", "bottom")).select("doc_id", "page", "i", "text", "x0", "x1", "top", "bottom", bucket(cx).alias("bx"), bucket(cy).alias("by"))
    inside = lambda c: cx.between(c["cx0"] - pad, c["cx1"] + pad) & cy.between(c["cy0"] - pad, c["cy1"] + pad)
    hit = g.join(index.hint("merge"), ["doc_id", "page", "bx", "by"]).withColumn("c", F.get(F.filter("cells", inside), 0)).where("c is not null")
    return hit.select("doc_id", "page", "i", F.col("c.cell").alias("cell"), "text", "x0", "x1", "top", "bottom")


def cell_text(glyphs: DataFrame, line: float = 3.0, gap: float = 1.6) -> DataFrame:
    """Text of each cell: glyphs fall into lines by their centre, stand in order of x, and a wide gap becomes a space."""
    row = F.floor((F.col("top") + F.col("bottom")) / 2 / line)
    w = Window.partitionBy("doc_id", "page", "cell", "row").orderBy("x0", "i")
    g = glyphs.withColumn("row", row)
    g = g.withColumn("piece", F.concat(F.when(F.col("x0") - F.lag("x1").over(w) > gap, " ").otherwise(""), "text"))
    lines = g.groupBy("doc_id", "page", "cell", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "i", "piece"))).alias("p")).withColumn("t", F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    return lines.groupBy("doc_id", "page", "cell").agg(F.array_sort(F.collect_list(F.struct("row", "t"))).alias("l")).select("doc_id", "page", "cell", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))


def glyph_runs(glyphs: DataFrame, pattern: str) -> DataFrame:
    """Strings of consecutive glyphs of one orientation with small gaps, those that fit the pattern, with the mean of their centres."""
    w = Window.partitionBy("doc_id", "page").orderBy("i")
    turn = F.bround("m0", 2) != F.lag(F.bround("m0", 2)).over(w)
    far = F.hypot(F.col("x0") - F.lag("x1").over(w), F.col("top") - F.lag("top").over(w)) > 2 * F.greatest(F.col("size"), F.lit(0.3))
    g = glyphs.withColumn("run", F.sum(F.coalesce((turn | far).cast("int"), F.lit(1))).over(w))
    runs = g.groupBy("doc_id", "page", "run").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("p"), F.avg((F.col("x0") + F.col("x1")) / 2).alias("x"), F.avg((F.col("top") + F.col("bottom")) / 2).alias("y"))
    runs = runs.withColumn("text", F.array_join(F.transform("p", lambda x: x["text"]), "")).drop("p")
    return runs.where(F.col("text").rlike(pattern))


def column_rules(edges: DataFrame, share: float) -> DataFrame:
    """Positions of vertical rules that span at least ``share`` of their page's table height."""
    v = edges.where("orientation = 'v'")
    extent = edges.groupBy("doc_id", "page").agg((F.max("bottom") - F.min("top")).alias("height"))
    spans = v.groupBy("doc_id", "page", F.bround("x0").alias("x")).agg(F.sum(F.col("bottom") - F.col("top")).alias("span"))
    return spans.join(extent, ["doc_id", "page"]).where(F.col("span") >= share * F.col("height")).select("doc_id", "page", "x", "span")


def two_up_split(pages: DataFrame, glyphs: DataFrame, limit: float = 1000.0) -> DataFrame:
    """Glyphs on logical pages: a page wider than ``limit`` is two, left and right, the right one shifted to its own origin."""
    n = F.when(F.col("width") > limit, 2).otherwise(1)
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    p = pages.withColumn("n", n).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    right = (F.col("n") == 2) & ((F.col("x0") + F.col("x1")) / 2 >= F.col("width") / 2)
    shift = F.when(right, F.col("width") / 2).otherwise(0.0)
    g = glyphs.join(p, ["doc_id", "page"])
    return g.select("doc_id", (F.col("before") + 1 + right.cast("int")).alias("page"), "i", "text", (F.col("x0") - shift).alias("x0"), (F.col("x1") - shift).alias("x1"))


def fragment_join(rows: DataFrame, known: DataFrame) -> DataFrame:
    """A department name cut over two rows becomes whole on both, where the two parts together are a known name."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    r = rows.withColumn("with_next", F.concat("dept", F.lead("dept").over(w))).withColumn("with_prev", F.concat(F.lag("dept").over(w), "dept"))
    k = known.select(F.col("dept").alias("full")).distinct()
    first = r.join(k.withColumnRenamed("full", "f1"), F.col("with_next") == F.col("f1"), "left")
    both = first.join(k.withColumnRenamed("full", "f2"), F.col("with_prev") == F.col("f2"), "left")
    return both.withColumn("whole", F.coalesce("f1", "f2", "dept")).drop("f1", "f2", "with_next", "with_prev")


def marker_hold(rows: DataFrame, marker: str = r"^\s*[○◦]\s*$") -> DataFrame:
    """A row that is a marker only goes before the text of the next row, or stays alone if another marker follows."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    r = rows.withColumn("mark", F.col("text").rlike(marker))
    r = r.withColumn("absorbed", F.col("mark") & F.coalesce(~F.lead("mark").over(w), F.lit(False))).withColumn("prefix", F.when(F.lag("mark").over(w) & ~F.col("mark"), F.lag("text").over(w)))
    return r.where("not absorbed").select("doc_id", "seq", F.concat_ws("", F.trim(F.coalesce("prefix", F.lit(""))), "text").alias("text"))


def merge_regions(cells: DataFrame) -> DataFrame:
    """Grid cells grown to merged ones: right while the next cell lacks its left rule, down while the one below lacks its top rule.

    Pages are small grids; each is one group for the helper."""

    def run(page):
        import pandas as pd

        left = {(r.row, r.col): r.left_rule for r in page.itertuples()}
        top = {(r.row, r.col): r.top_rule for r in page.itertuples()}
        done, out = set(), []
        for row, col in sorted(left):
            if (row, col) in done:
                continue
            right, low = col, row
            while (row, right + 1) in left and not left[row, right + 1] and (row, right + 1) not in done:
                right += 1
            while (low + 1, col) in top and not any(top.get((low + 1, c), True) for c in range(col, right + 1)):
                low += 1
            done |= {(i, j) for i in range(row, low + 1) for j in range(col, right + 1)}
            out.append((page.doc_id.iloc[0], page.page.iloc[0], row, col, low, right))
        return pd.DataFrame(out, columns=["doc_id", "page", "row", "col", "last_row", "last_col"])

    return cells.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page long, row long, col long, last_row long, last_col long")
