"""Points, zones, boundaries and rasters as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from .selection import quantiles, select_ranks
from .stable import checkpoint


# -- zones ----------------------------------------------------------------------------------------------------------------
def boundary_distance(points: DataFrame, ring: Column) -> DataFrame:
    """``points`` with ``distance`` to a boundary given as a literal ring, a fixed input of the job."""
    return points.withColumn("distance", G.distance_to_ring(F.col("x"), F.col("y"), ring))


def obstacle_at_point(points: DataFrame, obstacles: DataFrame, reach: float = 140.0, size: float = 10.0) -> DataFrame:
    """First obstacle whose centre lies within ``reach`` on both axes and whose ring holds the point, by cells of ``size``.

    A cell that no edge's box touches is held whole or not at all: of the obstacles that hold it whole, only the first is kept.
    Those that a cell's points must be tested against are the ones with an edge there that come before it, so however many
    obstacles lie over each other, a point meets few. Obstacles of one centre and ring are one. The tables of cells are made by
    ``explode`` from a smaller one, whose size Spark takes for theirs; the hints keep them from the driver."""
    slack = 1e-6  # a cell that is tested needlessly changes nothing
    finite = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))
    known = obstacles.where(finite(F.col("ox")) & finite(F.col("oy")) & F.col("obstacle").isNotNull() & F.col("ring").isNotNull())
    o = known.groupBy("ox", "oy", "ring").agg(F.min("obstacle").alias("obstacle"))
    whole = F.forall("ring", lambda p: finite(p["x"]) & finite(p["y"]))

    def span(centre, axis):
        along = F.when(whole, F.transform("ring", lambda p: p[axis]))
        low, high = F.greatest(F.col(centre) - reach, F.array_min(along) - slack), F.least(F.col(centre) + reach, F.array_max(along) + slack)
        return F.when(low <= high, F.sequence(F.floor(low / size), F.floor(high / size)))

    c = o.select("*", span("ox", "x").alias("xs"), span("oy", "y").alias("ys")).select("obstacle", "ox", "oy", "ring", "ys", F.explode("xs").alias("cx")).select("obstacle", "ox", "oy", "ring", "cx", F.explode("ys").alias("cy"))
    box = {v: (F.col(f"c{v}") * size - slack, (F.col(f"c{v}") + 1) * size + slack) for v in "xy"}
    meets = lambda e, v: (F.greatest(e["a"][v], e["b"][v]) >= box[v][0]) & (F.least(e["a"][v], e["b"][v]) <= box[v][1])
    touched = ~whole | F.exists(G._edges(F.col("ring")), lambda e: meets(e, "x") & meets(e, "y"))
    close = (box["x"][0] >= F.col("ox") - reach) & (box["x"][1] <= F.col("ox") + reach) & (box["y"][0] >= F.col("oy") - reach) & (box["y"][1] <= F.col("oy") + reach)
    held = G.in_ring((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("ring"))
    cells = c.withColumns({"touched": touched, "held": held}).where("touched or held").withColumn("full", ~F.col("touched") & close)
    first = checkpoint(cells.where("full").groupBy("cx", "cy").agg(F.min("obstacle").alias("first"))).hint("merge")
    tested = cells.where("not full").join(first, ["cx", "cy"], "left").where("first is null or obstacle < first").select("cx", "cy", "obstacle", "ox", "oy", "ring")
    p = points.where(finite(F.col("x")) & finite(F.col("y"))).select("id", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    near = (F.abs(F.col("x") - F.col("ox")) <= reach) & (F.abs(F.col("y") - F.col("oy")) <= reach)
    hits = p.join(tested.hint("merge"), ["cx", "cy"]).where(near & G.in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("id", "obstacle")
    hits = hits.unionByName(p.join(first, ["cx", "cy"]).select("id", F.col("first").alias("obstacle")))
    return points.join(hits.groupBy("id").agg(F.min("obstacle").alias("obstacle")), "id", "left")


def area_check(features: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Stated against measured area in per cent; features without a stated area are left out."""
    d = F.round(100 * (F.col("measured") - F.col("stated")) / F.col("stated"), 6)
    return features.where("stated is not null and stated <> 0").withColumn("diff_pct", d).withColumn("over", F.abs(d) > tolerance)


def unique_matches(drawing: DataFrame, listed: DataFrame) -> DataFrame:
    """Labels that stand exactly once on either side, with both positions."""
    once = lambda df, p: df.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("x", "y")).alias(p)).where("n = 1").drop("n")
    return once(drawing, "a").join(once(listed, "b"), "label")


def line_dedup(lines: DataFrame) -> DataFrame:
    """First line of each (code, first point, last point, length), points rounded to centimetres and repeats dropped; two points at least."""
    point = lambda p: F.struct(F.bround(p["x"], 2).alias("x"), F.bround(p["y"], 2).alias("y"))
    rounded = lines.withColumn("pts", F.transform("pts", point)).withColumn("n_raw", F.size("pts"))
    keys = [F.col("code"), F.col("pts")[0].alias("first"), F.element_at("pts", -1).alias("last"), F.col("n_raw")]
    first = rounded.groupBy(*keys).agg(F.min_by(F.struct("line_id", "pts"), "line_id").alias("r")).select("code", "r.*")
    clean = F.filter("pts", lambda p, i: (i == 0) | (p != F.try_element_at("pts", F.greatest(i, F.lit(1)))))
    return first.withColumn("pts", clean).where(F.size("pts") >= 2)


def contour_labels(lines: DataFrame, first: float = 80.0, step: float = 160.0) -> DataFrame:
    """Label marks along each line: positions every ``step`` from ``first``, interpolated on their segment, with an angle within ±90°."""
    pts = F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts")).alias("b"))
    segs = lines.select("line_id", F.posexplode(pts).alias("i", "s")).withColumn("len", F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")))
    w = Window.partitionBy("line_id").orderBy("i")
    run = F.sum("len").over(w)
    segs = segs.withColumn("end", run).withColumn("start", F.col("end") - F.col("len"))
    lo, hi = F.ceil((F.col("start") - first) / step), F.ceil((F.col("end") - first) / step) - 1
    marks = segs.withColumn("lo", F.greatest(lo, F.lit(0))).withColumn("hi", hi).where("hi >= lo and len > 0").select("*", F.explode(F.sequence("lo", "hi")).alias("mark"))
    t = (first + step * F.col("mark") - F.col("start")) / F.col("len")
    dx, dy = F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")
    angle = F.degrees(F.atan2(dy, dx))
    folded = F.when(angle > 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)
    return marks.select("line_id", "mark", (F.col("s.a.x") + t * dx).alias("x"), (F.col("s.a.y") + t * dy).alias("y"), folded.alias("angle"))


# -- rasters: rows (raster_id, row, col, v); void cells have a null v ----------------------------------------------------
def halve(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Mean of the valid cells of each 2 x 2 block, null if none; an odd last row or column is cut. Sums and counts combine before the shuffle."""
    inside = cells.where((F.col("row") < rows - rows % 2) & (F.col("col") < cols - cols % 2))
    return inside.groupBy("raster_id", F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.avg("v").alias("v"))


#: Cells of a raster that a task of ``pyramid`` brings together.
PYRAMID_CELLS = 500_000


def pyramid(cells: DataFrame, levels: int = 8, least: int = 4) -> DataFrame:
    """All coarser levels: ``level`` from 1, each half the one before, as long as both sides keep ``least`` cells.

    The size of a raster is that of its last row and column. Each level is an aggregation over the one before, which is
    stored, so no level is made twice; its cells are dealt by row to as many tasks as they need, of PYRAMID_CELLS each."""
    cur = checkpoint(cells.select("raster_id", "row", "col", "v"))
    sizes = checkpoint(cur.groupBy("raster_id").agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols")))
    n, out = cur.count(), None
    for level in range(1, levels + 1):
        inside = cur.join(sizes, "raster_id").where(f"_rows div 2 >= {least} and _cols div 2 >= {least}").where("row < _rows - _rows % 2 and col < _cols - _cols % 2")
        halves = inside.select("raster_id", F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col"), "v").repartition(n // PYRAMID_CELLS + 1, "raster_id", "row")
        cur = checkpoint(halves.groupBy("raster_id", "row", "col").agg(F.avg("v").alias("v")))
        n = cur.count()
        sizes = sizes.select("raster_id", F.expr("_rows div 2").alias("_rows"), F.expr("_cols div 2").alias("_cols"))
        one = cur.withColumn("level", F.lit(level))
        out = one if out is None else out.unionByName(one)
        if not n:
            break
    return out


def tile_inventory(pixels: DataFrame, top: int, bottom: int) -> DataFrame:
    """Tiles of zooms ``top`` to ``bottom`` over the extent of ``pixels(x, y, v)`` in Mercator metres: ``z, tx, ty, valid``
    pixels and ``present``, false for the tiles of the extent that hold none.

    Pixels are counted once, in the tiles of the deepest zoom; each of these tiles then gives its count to its ancestors, in one
    aggregation for all zooms. The wanted range of every zoom is that of all pixels, void ones included; what it has beyond the
    tiles with valid pixels is missing. No pixel gives no tile."""
    tx, ty = G.tile_of(F.col("x"), F.col("y"), F.lit(bottom))
    tiles = pixels.select(tx.cast("long").alias("tx"), ty.cast("long").alias("ty"), F.col("v").isNotNull().alias("ok")).groupBy("tx", "ty").agg(F.count_if("ok").alias("valid"))
    up = lambda c: F.expr(f"shiftright({c}, {bottom} - z)")
    zooms = F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("z")
    have = tiles.where("valid > 0").select("*", zooms).groupBy("z", up("tx").alias("tx"), up("ty").alias("ty")).agg(F.sum("valid").alias("valid"))
    extent = tiles.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("tx", "ty") for f in (F.min, F.max)]).where("min_tx is not null")
    columns = extent.select("*", zooms).select("*", F.explode(F.sequence(up("min_tx"), up("max_tx"))).alias("tx")).repartition("z", "tx")
    wanted = columns.select("z", "tx", F.explode(F.sequence(up("min_ty"), up("max_ty"))).alias("ty"))
    found = wanted.join(have, ["z", "tx", "ty"], "left")
    return found.select("z", "tx", "ty", F.coalesce("valid", F.lit(0).cast("long")).alias("valid"), F.col("valid").isNotNull().alias("present"))


def legend_use(rgb, legend, limit: float = 0.001) -> Column:
    """Land use of a fill colour: ``white`` if all parts are within 0.01 of 1, else the nearest colour of ``legend``
    (name, red, green, blue) if its squared distance is under ``limit``, else null; first of equals."""
    far = [F.struct(sum((F.pow(c - v, 2) for c, v in zip(rgb, colour)), F.lit(0.0)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("use")) for i, (name, *colour) in enumerate(legend)]
    white = F.lit(True)
    for c in rgb:
        white = white & (F.abs(c - 1) < 0.01)
    best = F.array_min(F.array(*far))
    return F.when(white, "white").when(best["d"] < limit, best["use"])


def classified_fills(fills: DataFrame, legend, legend_from: float = 760.0, least_area: float = 1.0) -> DataFrame:
    """``fills(y, area, r, g, b)`` outside the legend's band (from ``legend_from`` down) and of enough area, with ``use``."""
    kept = fills.where((F.col("y") <= legend_from) & (F.col("area") >= least_area))
    return kept.withColumn("use", legend_use([F.col("r"), F.col("g"), F.col("b")], legend))


def raster_stats(cells: DataFrame) -> DataFrame:
    return cells.groupBy("raster_id").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.count_if(F.col("v").isNull()).alias("void"))


def medians(cells: DataFrame, name: str) -> DataFrame:
    """``raster_id`` and the median of its valid cells."""
    return quantiles(cells, ["raster_id"], "v", [0.5]).select("raster_id", F.col("q")[0].alias(name))


def stretch(cells: DataFrame) -> DataFrame:
    """Values mapped by their 2, 50 and 98 percentiles (of positive ones) to 20, 128 and 236, where a spread under 1 counts as 1; void cells and zeros 128."""
    v = F.col("v")
    q = quantiles(cells.where("v > 0"), ["raster_id"], "v", [0.02, 0.5, 0.98])
    low, mid, high = (F.col("q")[i] for i in range(3))
    part = lambda a, b, lo, hi: lo + (hi - lo) * (v - a) / F.greatest(b - a, F.lit(1.0))
    level = F.when(v < mid, part(low, mid, 20.0, 128.0)).otherwise(part(mid, high, 128.0, 236.0))
    out = F.when(v.isNull() | (v == 0) | F.col("q").isNull(), 128.0).otherwise(F.greatest(F.least(level, F.lit(255.0)), F.lit(0.0)))
    return cells.join(q, "raster_id", "left").withColumn("level", out).drop("q")


def hillshade(cells: DataFrame, resolution: float, z_factor: float = 1.0) -> DataFrame:
    """Mean light from four directions (225, 270, 315, 360 degrees, 45 high) as 1 to 255.

    Void cells count with the raster's median and come out 0. Gradients are central differences, one-sided on the edges;
    one window runs along rows, one along columns. The mean of the four lights is held to 0 to 1."""
    cells = cells.join(medians(cells, "_mid"), "raster_id", "left")
    across, down = Window.partitionBy("raster_id", "row").orderBy("col"), Window.partitionBy("raster_id", "col").orderBy("row")

    def gradient(w):
        before, after = F.lag("z").over(w), F.lead("z").over(w)
        steps = before.isNotNull().cast("int") + after.isNotNull().cast("int")
        return F.coalesce(F.try_divide(F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z")), steps * resolution), F.lit(0.0))

    g = cells.withColumn("z", F.coalesce("v", "_mid") * z_factor).withColumn("gx", gradient(across)).withColumn("gy", gradient(down))
    light = F.lit(0.0)
    for azimuth in (225.0, 270.0, 315.0, 360.0):
        a = F.radians(F.lit(azimuth))
        shade = (1 - F.col("gx") * F.sin(a) + F.col("gy") * F.cos(a)) / F.sqrt(2.0 * (1 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
        light = light + shade / 4
    return g.withColumn("shade", F.when(F.col("v").isNull(), 0.0).otherwise(F.greatest(F.least(light, F.lit(1.0)), F.lit(0.0)) * 254 + 1)).drop("z", "gx", "gy", "_mid")


def sample(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Bilinear value at fractional ``(row, col)`` of each point, from its valid neighbours; null where they weigh half or less."""
    r0, c0 = F.floor("row"), F.floor("col")
    fr, fc = F.col("row") - r0, F.col("col") - c0
    corner = lambda i, j: F.struct((r0 + i).alias("row"), (c0 + j).alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w"))
    spread = points.select("id", "raster_id", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])).alias("c")).select("id", "raster_id", "c.row", "c.col", "c.w")
    j = spread.join(cells, ["raster_id", "row", "col"], "left").groupBy("id").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("w") * F.col("v"))).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w")).otherwise(0.0)).alias("w"))
    return points.join(j.select("id", F.when(F.col("w") > 0.5, F.col("s") / F.col("w")).alias("value")), "id", "left")


def sample_nearest(points: DataFrame, cells: DataFrame) -> DataFrame:
    at = points.withColumns({"_r": F.floor(F.col("row") + 0.5), "_c": F.floor(F.col("col") + 0.5)})
    c = cells.select("raster_id", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias("value"))
    return at.join(c, ["raster_id", "_r", "_c"], "left").drop("_r", "_c")


def surface_minus_ground(surface: DataFrame, ground: DataFrame) -> DataFrame:
    g = ground.withColumnRenamed("v", "g")
    return surface.join(g, ["raster_id", "row", "col"]).withColumn("d", F.col("v") - F.col("g")).withColumn("shown", F.col("d") >= 0.5)


def surface_class(d: Column, building: Column) -> Column:
    return F.when(building, "building").when(d > 1.5, "tree").otherwise("ground")


def object_height(d: Column) -> Column:
    """Bare below 0.3, else the ramp position d/6 within 0 to 1."""
    return F.when(d >= 0.3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / 6)))


def contour_segments(cells: DataFrame, levels) -> DataFrame:
    """Segments of each level in each 2 x 2 block of cells: ends interpolated on the block's sides, by the case of its corners.

    ``a_side`` and ``b_side`` name the sides of the grid that hold the ends: a level crosses a side once at most, so two
    segments at most share one, also where their ends lie on a corner that further segments touch."""
    across = Window.partitionBy("raster_id", "row").orderBy("col")
    pairs = cells.withColumn("right", F.lead("v").over(across))
    below = pairs.select("raster_id", (F.col("row") - 1).alias("row"), "col", F.col("v").alias("low"), F.col("right").alias("low_right"))
    quad = pairs.join(below, ["raster_id", "row", "col"]).where("v is not null and right is not null and low is not null and low_right is not null")
    q = quad.select("*", F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level"))
    bit = lambda c, k: F.when(F.col(c) >= F.col("level"), k).otherwise(0)
    q = q.withColumn("case", bit("v", 8) + bit("right", 4) + bit("low_right", 2) + bit("low", 1)).where("case not in (0, 15)")
    t = lambda a, b: F.try_divide(F.col("level") - F.col(a), F.col(b) - F.col(a))
    pt = lambda x, y, kind, r, c: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.struct((F.col("row") + r).cast("long").alias("row"), (F.col("col") + c).cast("long").alias("col"), F.lit(kind).alias("kind")).alias("side"))
    top, bottom = pt(F.col("col") + t("v", "right"), F.col("row"), "h", 0, 0), pt(F.col("col") + t("low", "low_right"), F.col("row") + 1, "h", 1, 0)
    left, right = pt(F.col("col"), F.col("row") + t("v", "low"), "v", 0, 0), pt(F.col("col") + 1, F.col("row") + t("right", "low_right"), "v", 0, 1)
    seg = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    c = F.col("case")
    ends = F.when(c.isin(1, 14), F.array(seg(left, bottom))).when(c.isin(2, 13), F.array(seg(bottom, right))).when(c.isin(3, 12), F.array(seg(left, right))).when(c.isin(4, 11), F.array(seg(top, right))).when(c.isin(6, 9), F.array(seg(top, bottom))).when(c.isin(7, 8), F.array(seg(left, top)))
    ends = F.when(c == 5, F.array(seg(left, top), seg(bottom, right))).when(c == 10, F.array(seg(left, bottom), seg(top, right))).otherwise(ends)
    return q.select("raster_id", "level", "row", "col", F.explode(ends).alias("s")).select("raster_id", "level", "row", "col", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"), F.col("s.a.side").alias("a_side"), F.col("s.b.side").alias("b_side"))


# -- buildings, georeferencing ---------------------------------------------------------------------------------------------
def building_components(cells: DataFrame, max_rounds: int = 64) -> DataFrame:
    """8-connected components of building cells ``(raster_id, row, col, v)``: every cell with the least cell (row, col) it reaches.

    Each round a cell takes the least label of its neighbourhood and then the label of that label's cell (pointer
    jumping), so the rounds grow with the logarithm of a component's width."""
    number = F.struct(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    cur = checkpoint(cells.select("raster_id", "row", "col", "v", number.alias("n"), number.alias("label")))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for _ in range(max_rounds):
        sent = cur.select("raster_id", "label", F.explode(around).alias("d"), "row", "col").select("raster_id", (F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col"), "label")
        low = sent.groupBy("raster_id", "row", "col").agg(F.min("label").alias("low"))
        near = cur.join(low, ["raster_id", "row", "col"])
        jump = near.select("raster_id", F.col("n").alias("label"), F.col("low").alias("next")).groupBy("raster_id", "label").agg(F.min("next").alias("next"))
        step = near.join(jump.withColumnRenamed("label", "low"), ["raster_id", "low"], "left")
        new = checkpoint(step.select("raster_id", "row", "col", "v", "n", F.least("low", F.coalesce("next", "low")).alias("label"), F.col("label").alias("was")))
        still = new.where("label <> was").isEmpty()
        cur = new.drop("was")
        if still:
            return cur
    raise RuntimeError("building components did not converge")


def building_shapes(labelled: DataFrame, cell_area: float) -> DataFrame:
    """Per component: area, eave (20th percentile, nearest rank), ridge (95th), mean height, volume and size of its box."""
    keys, place = ["raster_id", "label"], lambda n, q: F.floor((n - 1) * q + 0.5)
    area = F.count("*") * cell_area
    sums = labelled.groupBy(*keys).agg(F.count("*").alias("cells"), area.alias("area"), F.avg("v").alias("mean"), (F.avg("v") * area).alias("volume"), (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"))
    heights = select_ranks(labelled, keys, "v", lambda n: [place(n, 0.2), place(n, 0.95)])
    at = lambda q: F.col("at")[place(F.col("n"), q)]
    return sums.join(heights, keys, "left").withColumns({"eave": at(0.2), "ridge": at(0.95)}).drop("n", "at")


def _residual(m):
    """Squared distance of a point from where the 2 x 3 matrix ``m`` puts it."""
    at = lambda r: float(r[0]) * F.col("px") + float(r[1]) * F.col("py") + float(r[2])
    return F.pow(at(m[0]) - F.col("gx"), 2) + F.pow(at(m[1]) - F.col("gy"), 2)


def _least_squares(points: DataFrame):
    """The 2 x 3 matrix of the least squares, from sums of products; None if they do not determine it."""
    import numpy as np

    terms = {"x": F.col("px"), "y": F.col("py"), "1": F.lit(1.0), "e": F.col("gx"), "n": F.col("gy")}
    pairs = [(a, b) for a in "xy1" for b in "xy1en"]
    r = points.agg(*[F.sum(terms[a] * terms[b]).alias(f"{a}_{b}") for a, b in pairs]).first()
    if r["1_1"] is None or r["1_1"] < 3:
        return None
    left = np.array([[r[f"{a}_{b}"] for b in "xy1"] for a in "xy1"])
    right = np.array([[r[f"{a}_{b}"] for b in "en"] for a in "xy1"])
    return np.linalg.solve(left, right).T if np.linalg.matrix_rank(left) == 3 else None


def affine_ransac(points: DataFrame, trials: int = 2000, wide: float = 15.0, narrow: float = 10.0, refits: int = 5, seed: int = 7) -> DataFrame:
    """Affine map (px, py) to (gx, gy): the trial with most points within ``wide`` (first best), refitted on its points within ``narrow``.

    Trials draw triples from a bounded sample (three points a trial, chosen by a seeded hash); only the trials'
    matrices go to the tasks, which count all points for all trials in one pass. Refits are sums of products. One row:
    ``kept, median, rms, worst, scale, rotation``; none where no three points determine a map."""
    import numpy as np

    spark = points.sparkSession
    points = points.select(*[F.col(c).cast("double").alias(c) for c in ("px", "py", "gx", "gy")]).dropna()
    schema = "kept long, median double, rms double, worst double, scale double, rotation double"
    drawn = points.orderBy(F.xxhash64("px", "py", "gx", "gy", F.lit(seed)), "px", "py", "gx", "gy").limit(3 * trials).collect()  # bounded by the trials
    rng, rows, maps = np.random.default_rng(seed), np.array([tuple(r) for r in drawn]).reshape(-1, 4), []
    for _ in range(trials if len(rows) >= 3 else 0):
        pick = rows[rng.choice(len(rows), 3, replace=False)]
        left = np.column_stack((pick[:, :2], np.ones(3)))
        if abs(np.linalg.det(left)) > 1e-9:
            maps.append(np.linalg.solve(left, pick[:, 2:]).T)
    if not maps:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(np.array(maps))

    def count(batches):
        import pyarrow as pa

        total = np.zeros(len(held.value), np.int64)
        for b in batches:
            x = np.array([np.array(c) for c in b.columns])
            for at in range(0, b.num_rows, 512):
                own = x[:, at : at + 512]
                off = np.einsum("tij,jn->tin", held.value, np.vstack((own[:2], np.ones(own.shape[1])))) - own[2:]
                total += ((off**2).sum(axis=1) < wide * wide).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["trial", "n"])

    won = points.mapInArrow(count, "trial long, n long").groupBy("trial").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "trial").first()
    m = maps[won.trial]
    for reach in [wide, *[narrow] * refits]:
        better = _least_squares(points.where(_residual(m) < reach * reach))
        m = m if better is None else better
    err = F.sqrt(_residual(m))
    stats = points.where(err < narrow).agg(F.count("*").alias("kept"), F.percentile_approx(err, 0.5, 10000).alias("median"), F.sqrt(F.avg(err * err)).alias("rms"), F.max(err).alias("worst"))
    return stats.withColumns({"scale": F.lit(float(np.hypot(m[0, 0], m[0, 1]))), "rotation": F.lit(float(np.degrees(np.arctan2(m[0, 1], m[0, 0]))))})


def _ranked(arcs: DataFrame, max_rounds: int = 64) -> DataFrame:
    """List ranking by pointer jumping: ``arcs(arc, next, steps, end, tail, low)`` until each row has jumped to its list's end.

    A row knows the arc that follows the stretch it has seen, the stretch's number of arcs, where it ends and comes from last,
    and its least vertex. Each round joins every row to the one it points at, which doubles its stretch, so the rounds grow
    with the logarithm of the longest list; no list is ever gathered. Rows of a ring never end and keep
    their ``next``: they are done when a round changes no least vertex. In each round that leaves rows of a list open, others
    of it reach the end, so a round without either is the last."""
    cur = checkpoint(arcs)
    for _ in range(max_rounds):
        if cur.where("next is not null").isEmpty():
            return cur
        on = cur.select(*[F.col(c).alias(f"_{c}") for c in cur.columns])
        jump = F.col("_arc").isNotNull()
        two = cur.join(on, F.col("next") == F.col("_arc"), "left")
        low = F.when(jump, F.least("low", "_low")).otherwise(F.col("low"))
        new = two.select("arc", F.when(jump, F.col("_next")).alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), *[F.when(jump, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("end", "tail")], low.alias("low"), (F.col("_next").isNotNull() & (low == F.col("low"))).alias("still"), jump.alias("moved"))
        new = checkpoint(new)
        settled = new.where("moved and not still").isEmpty()
        cur = new.drop("still", "moved")
        if settled:
            return cur
    raise RuntimeError("lines did not converge")


def chain_segments(segments: DataFrame) -> DataFrame:
    """Polylines of ``contour_segments``, a row a point: ``raster_id, level, line, place, x, y, n, closed``.

    Segments that share a side follow each other. Every segment is two arcs, one a direction; list ranking tells each arc how
    far it is from its line's end, and the opposite arc how far from its start, so a line of any length is put in order over
    all tasks. Rings are cut at their least vertex first. A line starts at the lesser of its ends, a ring goes first to the
    lesser neighbour of its start; ``line`` names the start. Lines of fewer than three points go."""
    seg = checkpoint(segments.withColumn("sid", F.monotonically_increasing_id()))
    vertex = lambda side: F.struct("raster_id", "level", F.col(f"{side}_side.row").alias("row"), F.col(f"{side}_side.col").alias("col"), F.col(f"{side}_side.kind").alias("kind"))
    way = lambda d, u, v: seg.select((F.col("sid") * 2 + d).alias("arc"), vertex(u).alias("u"), vertex(v).alias("v"), F.col(f"{u}x").alias("ux"), F.col(f"{u}y").alias("uy"), F.col(f"{v}x").alias("vx"), F.col(f"{v}y").alias("vy"))
    arcs = way(0, "a", "b").unionByName(way(1, "b", "a"))
    after = arcs.select(F.col("u").alias("v"), F.col("arc").alias("next"))
    same = F.shiftright("arc", 1) == F.shiftright("next", 1)
    follow = arcs.join(after, "v").where(~same).select("arc", "next")
    first = checkpoint(arcs.join(follow, "arc", "left").select("arc", "next", F.lit(1).cast("long").alias("steps"), F.col("v").alias("end"), F.col("u").alias("tail"), F.least("u", "v").alias("low")))
    seen = _ranked(first)
    rings = seen.where("next is not null").select("arc", F.col("low").alias("cut"))
    opened = first.join(rings, "arc").withColumn("next", F.when(F.col("end") != F.col("cut"), F.col("next"))).drop("cut")
    done = seen.where("next is null").unionByName(_ranked(opened))
    back = done.select(F.col("arc").bitwiseXOR(F.lit(1).cast("long")).alias("arc"), (F.col("steps") - 1).alias("before"), F.col("end").alias("start"), F.col("tail").alias("second"))
    whole = arcs.join(done.select("arc", "steps", "end", "tail"), "arc").join(back, "arc")
    forward = whole.where(F.struct(F.col("start").alias("p"), F.col("second").alias("q")) < F.struct(F.col("end").alias("p"), F.col("tail").alias("q"))).withColumn("n", F.col("steps") + F.col("before") + 1).where("n >= 3")
    point = lambda place, x, y: F.struct(place.alias("place"), F.col(x).alias("x"), F.col(y).alias("y"))
    own = point(F.col("before") + 1, "vx", "vy")
    points = F.when(F.col("before") == 0, F.array(point(F.lit(0).cast("long"), "ux", "uy"), own)).otherwise(F.array(own))
    line = F.concat_ws("/", "start.row", "start.col", "start.kind")
    return forward.select("u.raster_id", "u.level", line.alias("line"), F.explode(points).alias("p"), "n", (F.col("start") == F.col("end")).alias("closed")).select("raster_id", "level", "line", "p.*", "n", "closed")


def resample(cells: DataFrame, rows: int, cols: int, factor: float) -> DataFrame:
    """The raster on another grid, ``factor`` cells apart, bilinear, void cells filled with the raster's median first, as decimetres."""
    mid = cells.select("raster_id").distinct().join(medians(cells, "mid"), "raster_id", "left")
    filled = cells.join(mid, "raster_id").select("raster_id", "row", "col", F.coalesce("v", "mid").alias("v"))
    grid = mid.select("raster_id", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    at = grid.select(F.concat_ws("/", "raster_id", "r", "c").alias("id"), "raster_id", "r", "c", (F.col("r") * factor).alias("row"), (F.col("c") * factor).alias("col"))
    got = sample(at, filled)
    return got.select("raster_id", F.col("r").alias("row"), F.col("c").alias("col"), G.to_decimetres(F.col("value")).alias("dm"))


def sample_viewer(points: DataFrame, cells: DataFrame) -> DataFrame:
    """As ``sample``, but with fewer than four valid neighbours the first valid one counts; outside: null."""
    r0, c0 = F.floor("row"), F.floor("col")
    fr, fc = F.col("row") - r0, F.col("col") - c0
    corner = lambda k, i, j: F.struct(F.lit(k).alias("k"), (r0 + i).alias("row"), (c0 + j).alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w"))
    spread = points.select("id", "raster_id", F.explode(F.array(corner(0, 0, 0), corner(1, 0, 1), corner(2, 1, 0), corner(3, 1, 1))).alias("c")).select("id", "raster_id", "c.*")
    j = spread.join(cells.where("v is not null"), ["raster_id", "row", "col"])
    got = j.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("v")).alias("s"), F.min_by("v", "k").alias("first"))
    return points.join(got.select("id", F.when(F.col("n") == 4, F.col("s")).otherwise(F.col("first")).alias("value")), "id", "left")
