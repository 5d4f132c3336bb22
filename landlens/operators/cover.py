"""Polygons burnt into grid cells, row by row.

A polygon is taken apart into its edges, each row of cells sees the edges that pass through it, and the cells between two
crossings come as one run. No ring is copied into the cells it covers: a cell inside carries nothing, a cell on the edge
carries the edges that touch it. Runs have columns ``cy`` (row), ``c0`` and ``c1`` (first and last column).

Rules of a point and a ring are those of ``functions.geo.in_ring``: even-odd, a point on a left or lower edge is inside. Null
and empty rings, and edges with a null or non-finite end, hold nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stable import checkpoint

#: Columns of a block in ``sweep``: the most different positions that one window of it can hold.
BLOCK = 4096


def ring_edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``ring`` (0 is the outer one, holes follow) and the ends ``ax, ay, bx, by`` of each edge of ``rings``."""
    ring = polygons.select(*keys, F.posexplode("rings").alias("ring", "pts")).where(F.size("pts") > 2)
    after = F.element_at("pts", F.when(F.col("at") + 1 < F.size("pts"), F.col("at") + 2).otherwise(1))
    e = ring.select(*keys, "ring", "pts", F.posexplode("pts").alias("at", "a")).select(*keys, "ring", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), after["x"].alias("bx"), after["y"].alias("by"))
    finite = [F.abs(F.col(c)) < float("inf") for c in ("ax", "ay", "bx", "by")]
    return e.where(finite[0] & finite[1] & finite[2] & finite[3])


def _crossing(y: Column) -> tuple[Column, Column]:
    """Whether the edge passes the height ``y``, and where."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    return (ay > y) != (by > y), (bx - ax) * (y - ay) / F.when(by == ay, 1e-300).otherwise(by - ay) + ax


def _span(low: Column, high: Column) -> list[Column]:
    """Where the part of the edge between two heights begins and ends in x; a level edge has all of itself."""
    dy = F.col("by") - F.col("ay")
    at = lambda h, level: F.when(dy == 0, level).otherwise(F.greatest(F.least((h - F.col("ay")) / F.nullif(dy, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    return [F.col("ax") + t * (F.col("bx") - F.col("ax")) for t in (at(low, 0.0), at(high, 1.0))]


def sweep(runs: DataFrame, keys: list[str], without: bool = False) -> DataFrame:
    """Runs of ``keys`` united, without overlap; with ``without``, less the runs whose ``minus`` is true.

    Rows are cut at blocks of columns, and the starts and ends of runs are added up by position before they are put in order,
    so a window holds at most ``BLOCK`` + 1 rows, whatever the number of polygons over it."""
    minus = F.col("minus") if without else F.lit(False)
    blocks = F.explode(F.sequence(F.floor(F.col("c0") / BLOCK), F.floor(F.col("c1") / BLOCK)))
    cut = runs.where("c0 <= c1").select(*keys, "cy", "c0", "c1", minus.alias("minus"), blocks.alias("block"))
    cut = cut.withColumns({"c0": F.greatest("c0", F.col("block") * BLOCK), "c1": F.least("c1", (F.col("block") + 1) * BLOCK - 1)})
    ends = F.explode(F.array(F.struct(F.col("c0").alias("at"), F.lit(1).alias("d")), F.struct((F.col("c1") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")
    side = lambda c: F.sum(F.when(c, F.col("e.d")).otherwise(0))
    events = cut.select(*keys, "cy", "block", "minus", ends).groupBy(*keys, "cy", "block", F.col("e.at").alias("at")).agg(side(~F.col("minus")).alias("plus"), side(F.col("minus")).alias("less"))
    w = Window.partitionBy(*keys, "cy", "block").orderBy("at")
    state = events.withColumn("on", (F.sum("plus").over(w) > 0) & (F.sum("less").over(w) == 0))
    turns = state.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where(F.col("on") != F.col("was"))
    return turns.withColumn("c1", F.lead("at").over(w) - 1).where("on").select(*keys, "cy", F.col("at").alias("c0"), "c1")


def burn(polygons: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Runs of the cells whose centre lies in a polygon: in its outer ring and in none of its holes. ``keys`` name a polygon."""
    y = (F.col("cy") + 0.5) * cell
    passes, x = _crossing(y)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))).alias("cy")
    hits = ring_edges(polygons, keys).where("ay <> by").select("*", rows).where(passes).select(*keys, "ring", "cy", x.alias("x"))
    w = Window.partitionBy(*keys, "ring", "cy").orderBy("x")
    paired = hits.withColumns({"n": F.row_number().over(w), "x1": F.lead("x").over(w)}).where("n % 2 = 1")
    column = lambda c: F.ceil(F.col(c) / cell - 0.5)
    runs = paired.select(*keys, "cy", (F.col("ring") > 0).alias("minus"), column("x").alias("c0"), (column("x1") - 1).alias("c1"))
    return sweep(runs, keys, without=True)


def run_cells(runs: DataFrame) -> DataFrame:
    """Runs as one row a cell: ``cx, cy`` in place of ``c0, c1``."""
    rest = [c for c in runs.columns if c not in ("c0", "c1", "cy")]
    return runs.select(*rest, F.explode(F.sequence("c0", "c1")).alias("cx"), "cy")


def run_area(runs: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Area of the runs of ``keys``, each run once."""
    return runs.groupBy(*keys).agg((F.sum(F.col("c1") - F.col("c0") + 1) * cell * cell).alias("area"))


def near_edges(polygons: DataFrame, keys: list[str], cell: float, margin: float) -> DataFrame:
    """Runs of cells whose centre lies within ``margin`` of an edge, one an edge and row; a cell near two edges comes twice.

    An edge meets in each row the columns between its ends within reach of that row's centre line only. What is within
    ``margin`` of an edge is convex, so these are one run."""
    e = ring_edges(polygons, keys)
    lo, hi = F.least("ay", "by") - margin, F.greatest("ay", "by") + margin
    r = e.select("*", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))).alias("cy"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    y = (F.col("cy") + 0.5) * cell
    xs = _span(y - margin, y + margin)
    c0, c1 = F.floor((F.least(*xs) - margin) / cell) - 1, F.floor((F.greatest(*xs) + margin) / cell) + 1

    def near(cx):
        x = (cx + 0.5) * cell
        t = F.coalesce(F.try_divide((x - F.col("ax")) * dx + (y - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - F.col("ax") - t * dx, y - F.col("ay") - t * dy) <= margin

    c = r.select(*keys, "cy", F.filter(F.sequence(c0, c1), near).alias("cells")).where(F.size("cells") > 0)
    return c.select(*keys, "cy", F.element_at("cells", 1).alias("c0"), F.element_at("cells", -1).alias("c1"))


def _above(y: Column, side: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether an edge that passes the upright line just left of ``side`` does so above ``y``."""
    (ax, ay), (bx, by) = a, b
    at = (by - ay) * (side - ax) / F.when(bx == ax, 1e-300).otherwise(bx - ax) + ay
    falls = ((by - ay) < 0) != ((bx - ax) < 0)
    return (at > y) | ((at == y) & falls & (ay != by))


def _left(y: Column, side: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether an edge that passes the height ``y`` does so left of ``side``; told by ``_above`` where it passes both."""
    (ax, ay), (bx, by) = a, b
    rises = ((by - ay) > 0) == ((bx - ax) > 0)
    return F.when((ax >= side) == (bx >= side), ax < side).otherwise(rises == _above(y, side, a, b))


def zone_cells(zones: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The cells of ``size`` over each ring of the zones: ``keys, ring, cx, cy, edges, odd``.

    Cells inside a ring have null ``edges``. Cells on its edge have the edges that touch them, and ``odd``: whether the
    point in the middle of the cell's right side, just inside, lies in the ring."""
    e = ring_edges(zones, keys)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    r = e.select("*", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))).alias("cy"))
    xs = [x / size for x in _span(F.col("cy") * size, (F.col("cy") + 1) * size)]
    slack = 1e-6  # an edge listed in a cell beside it changes nothing; one left out would
    c = r.select("*", F.explode(F.sequence(F.floor(F.least(*xs) - slack), F.floor(F.greatest(*xs) + slack))).alias("cx"))
    a, b, middle = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by")), (F.col("cy") + 0.5) * size
    passes, _ = _crossing(middle)
    here = passes & _left(middle, (F.col("cx") + 1) * size, a, b) & ~_left(middle, F.col("cx") * size, a, b)
    cells = c.groupBy(*keys, "ring", "cx", "cy").agg(F.count_if(here).alias("n"), F.collect_list(F.struct(F.struct(a[0].alias("x"), a[1].alias("y")).alias("a"), F.struct(b[0].alias("x"), b[1].alias("y")).alias("b"))).alias("edges"))
    w = Window.partitionBy(*keys, "ring", "cy").orderBy("cx")
    cells = cells.withColumns({"odd": F.sum("n").over(w) % 2 == 1, "next": F.lead("cx").over(w)})
    between = F.when(F.col("odd") & (F.col("next") > F.col("cx") + 1), F.sequence(F.col("cx") + 1, F.col("next") - 1))
    inner = cells.select(*keys, "ring", F.explode(between).alias("cx"), "cy", F.lit(None).cast(cells.schema["edges"].dataType).alias("edges"), F.lit(True).alias("odd"))
    return cells.select(*keys, "ring", "cx", "cy", "edges", "odd").unionByName(inner)


def holds(x: Column, y: Column, size: float) -> Column:
    """Whether the ring of a ``zone_cells`` row holds a point of its cell.

    The parity of the cell's known point changes with each edge met on the way to ``(x, y)``: up or down the cell's right side,
    then left to the point."""
    side, middle = (F.col("cx") + 1) * size, (F.col("cy") + 0.5) * size

    def met(e):
        a, b = (e["a"]["x"], e["a"]["y"]), (e["b"]["x"], e["b"]["y"])
        upright = ((a[0] >= side) != (b[0] >= side)) & (_above(y, side, a, b) != _above(middle, side, a, b))
        level = (a[1] > y) != (b[1] > y)
        at = (b[0] - a[0]) * (y - a[1]) / F.when(b[1] == a[1], 1e-300).otherwise(b[1] - a[1]) + a[0]
        return upright != (level & (x < at) & _left(y, side, a, b))

    return F.when(F.col("edges").isNull(), F.col("odd")).otherwise(F.col("odd") != (F.size(F.filter("edges", met)) % 2 == 1))


def points_in_zones(points: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Points ``(id, x, y)`` with the first zone (by ``ord``, then name) that holds them, null outside all.

    One equi-join on cells; a zone holds a point that its outer ring holds and no hole does. A null or non-finite position
    lies in no zone."""
    cover = zone_cells(zones, ["zone", "ord"], size)
    finite = points.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    keyed = finite.select("id", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    hits = keyed.join(cover, ["cx", "cy"]).where(holds(F.col("x"), F.col("y"), size))
    inside = hits.groupBy("id", "zone", "ord").agg(F.max("ring").alias("deepest"), F.min("ring").alias("outer")).where("outer = 0 and deepest = 0")
    first = inside.groupBy("id").agg(F.min(F.struct("ord", "zone")).alias("f")).select("id", F.col("f.zone").alias("zone"))
    return points.join(first, "id", "left")


def cells_union(polygons: DataFrame, keys: list[str], use: list[str], cell: float) -> DataFrame:
    """Runs of all polygons of a ``use`` as one: ``keys`` name a polygon and hold ``use``."""
    return sweep(burn(polygons, keys, cell).select(*use, "cy", "c0", "c1"), use)


def cells_difference(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """Runs of ``whole`` that no run of ``parts`` covers: what is left of a site, its roads."""
    side = lambda runs, minus: runs.select("cy", "c0", "c1", F.lit(minus).alias("minus"))
    return sweep(side(whole, False).unionByName(side(parts, True)), [], without=True)


#: Buildings that a task of ``building_mask`` takes apart.
BUILDINGS = 1000


def building_mask(buildings: DataFrame, margin: float = 1.5, cell: float = 1.0) -> DataFrame:
    """Runs ``building, cy, c0, c1`` of the cells whose centre lies in a building's ``ring`` or within ``margin`` of it.

    Buildings are dealt to as many tasks as they need; all that follows stays with them."""
    one = checkpoint(buildings.select("building", F.array("ring").alias("rings")))  # a small file would be one task, its cells are many
    one = one.repartition(one.count() // BUILDINGS + 1, "building")
    return sweep(burn(one, ["building"], cell).unionByName(near_edges(one, ["building"], cell, margin)), ["building"])
