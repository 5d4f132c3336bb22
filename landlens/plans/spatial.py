"""Queries of projections, zones, rasters and evidence. Positions are arithmetic on the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import text as T
from ..operators import cover as V
from ..operators import evidence as E
from ..operators import spatial as S
from ..operators.stable import checkpoint
from .base import Catalog, table

C = Catalog()
QUERIES, ORACLE = C.QUERIES, C.ORACLE
R = lambda c, n=6: F.round(c, n)

PT_SQL = "pts AS (SELECT c_custkey AS id, 126.9 + (c_custkey % 97) / 970.0 AS lng, 37.2 + (c_custkey % 89) / 890.0 AS lat, (c_custkey % 1009)::DOUBLE AS x, (c_custkey * 7 % 997)::DOUBLE AS y FROM customer)"


def points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (126.9 + (k % 97) / 970.0).alias("lng"), (37.2 + (k % 89) / 890.0).alias("lat"), (k % 1009).cast("double").alias("x"), (k * 7 % 997).cast("double").alias("y"))


TM = G.TransverseMercator(127.0, 38.0)
A, E2, EP2 = G.SEMI_MAJOR, TM.e2, TM.ep2
_ARC = lambda p: f"{A} * ({TM.arc[0]!r} * ({p}) - {TM.arc[1]!r} * sin(2 * ({p})) + {TM.arc[2]!r} * sin(4 * ({p})) - {TM.arc[3]!r} * sin(6 * ({p})))"
FORWARD_SQL = f"""{PT_SQL}, a AS (SELECT id, radians(lat) AS p, (radians(lng) - {TM.lon0!r}) * cos(radians(lat)) AS q FROM pts), b AS (SELECT *, {A} / sqrt(1 - {E2!r} * sin(p) * sin(p)) AS n, tan(p) * tan(p) AS t, {EP2!r} * cos(p) * cos(p) AS g, {_ARC('p')} AS m FROM a),
 en AS (SELECT id, 200000 + n * (q + (1 - t + g) * q ** 3 / 6 + (5 - 18 * t + t * t + 72 * g - 58 * {EP2!r}) * q ** 5 / 120) AS east, 600000 + m - {TM.m0!r} + n * tan(p) * (q * q / 2 + (5 - t + 9 * g + 4 * g * g) * q ** 4 / 24 + (61 - 58 * t + t * t + 600 * g - 330 * {EP2!r}) * q ** 6 / 720) AS north FROM b)"""


@C.add(f"WITH {FORWARD_SQL} SELECT id, round(east, 4) AS east, round(north, 4) AS north FROM en")
def tm_forward(spark, sf_dir):
    e, n = TM.forward(F.col("lng"), F.col("lat"))
    return points(spark, sf_dir).select("id", R(e, 4).alias("east"), R(n, 4).alias("north"))


@C.add(f"WITH {PT_SQL} SELECT id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM pts")
def tm_inverse(spark, sf_dir):
    e, n = TM.forward(F.col("lng"), F.col("lat"))
    lng, lat = TM.inverse(F.col("e"), F.col("n"))
    return points(spark, sf_dir).select("id", e.alias("e"), n.alias("n")).select("id", R(lng).alias("lng"), R(lat).alias("lat"))


MERC = f"radians(lng) * {A} AS mx, ln(tan(radians(lat) / 2 + pi() / 4)) * {A} AS my"


@C.add(f"WITH {PT_SQL}, m AS (SELECT id, {MERC} FROM pts) SELECT id, round(mx, 3) AS mx, round(my, 3) AS my FROM m")
def merc_forward(spark, sf_dir):
    x, y = G.mercator(F.col("lng"), F.col("lat"))
    return points(spark, sf_dir).select("id", R(x, 3).alias("mx"), R(y, 3).alias("my"))


@C.add(f"WITH {PT_SQL} SELECT id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM pts")
def merc_inverse(spark, sf_dir):
    lng, lat = G.from_mercator(*G.mercator(F.col("lng"), F.col("lat")))
    return points(spark, sf_dir).select("id", R(lng).alias("lng"), R(lat).alias("lat"))


HALF = G.MERCATOR_HALF


@C.add(f"WITH {PT_SQL}, m AS (SELECT id, {MERC} FROM pts) SELECT id, z, floor((mx + {HALF!r}) / ({2 * HALF!r} / 2 ** z))::INT AS tx, floor(({HALF!r} - my) / ({2 * HALF!r} / 2 ** z))::INT AS ty FROM m, (SELECT unnest(generate_series(10, 14)) AS z)")
def tile_of_point(spark, sf_dir):
    x, y = G.mercator(F.col("lng"), F.col("lat"))
    p = points(spark, sf_dir).select("id", x.alias("mx"), y.alias("my"), F.explode(F.sequence(F.lit(10), F.lit(14))).alias("z"))
    tx, ty = G.tile_of(F.col("mx"), F.col("my"), F.col("z"))
    return p.select("id", "z", tx.alias("tx"), ty.alias("ty"))


@C.add(f"SELECT c_custkey AS id, round((c_custkey % 1024) * ({2 * HALF!r} / 1024) - {HALF!r}, 3) AS x0, round({HALF!r} - (c_custkey % 1000) * ({2 * HALF!r} / 1024), 3) AS y0 FROM customer")
def tile_origin(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = G.tile_origin(k % 1024, k % 1000, F.lit(10))
    return table(spark, sf_dir, "customer").select(k.alias("id"), R(x, 3).alias("x0"), R(y, 3).alias("y0"))


@C.add(f"SELECT c_custkey % 20 AS z, round({2 * HALF!r} / 256 / 2 ** (c_custkey % 20), 6) AS res, count(*) AS n FROM customer GROUP BY c_custkey % 20")
def tile_res(spark, sf_dir):
    z = F.col("c_custkey") % 20
    return table(spark, sf_dir, "customer").groupBy(z.alias("z")).agg(F.count("*").alias("n")).select("z", R(G.tile_resolution(F.col("z"))).alias("res"), "n")


@C.add("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN -32768 ELSE greatest(least(round_even(o_totalprice / 8 * 10 / 10, 0), 32000), -32000) END::INT AS dm FROM orders")
def quantize_dm(spark, sf_dir):
    v = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 80)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), G.to_decimetres(v).alias("dm"))


@C.add(f"WITH {PT_SQL} SELECT id, round((lng - 127.0) * 111320.0 * cos(radians(37.2)), 4) AS east, round((lat - 37.2) * 111132.95, 4) AS north FROM pts")
def local_metres(spark, sf_dir):
    e, n = G.local_metres(F.col("lat"), F.col("lng"), F.lit(37.2), F.lit(127.0))
    return points(spark, sf_dir).select("id", R(e, 4).alias("east"), R(n, 4).alias("north"))


@C.add("SELECT c_custkey AS id, (['북', '북동', '동', '남동', '남', '남서', '서', '북서'])[(floor((c_custkey % 720) / 45.0 + 0.5)::INT % 8) + 1] AS name FROM customer")
def compass_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), G.compass_name(F.col("c_custkey") % 720).alias("name"))


@C.add("SELECT p_partkey, round(p_retailprice / 3.3058, 6) AS pyeong, round(p_retailprice / 10000, 6) AS ha, greatest(1, floor(p_size / 3.0 + 0.5))::INT AS storeys FROM part")
def area_units(spark, sf_dir):
    u = G.area_units(F.col("p_retailprice"), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", R(u["pyeong"]).alias("pyeong"), R(u["ha"]).alias("ha"), u["storeys"].alias("storeys"))


SUN = "sin(radians(lat)) * sin(radians(d)) + cos(radians(lat)) * cos(radians(d)) * cos(radians(h))"


@C.add(f"WITH {PT_SQL}, s AS (SELECT id, lat, -23.44 + id % 47 AS d, -60.0 + id % 121 AS h FROM pts) SELECT id, round(degrees(asin({SUN})), 6) AS up, round(degrees(atan2(sin(radians(h)), cos(radians(h)) * sin(radians(lat)) - tan(radians(d)) * cos(radians(lat)))), 6) AS azimuth FROM s")
def solar_position(spark, sf_dir):
    up, az = G.solar_position(F.col("lat"), -23.44 + F.col("id") % 47, -60.0 + F.col("id") % 121)
    return points(spark, sf_dir).select("id", R(up).alias("up"), R(az).alias("azimuth"))


# -- zones ------------------------------------------------------------------------------------------------------------------
#: Zones of the bindings: (zone, order, outer ring, holes); axis-parallel, so that SQL can check them.
ZONES = (("north", 1, ((0, 500), (600, 500), (600, 1010), (0, 1010)), (((200, 600), (300, 600), (300, 700), (200, 700)),)), ("centre", 2, ((300, 300), (700, 300), (700, 700), (300, 700)), ()), ("south", 3, ((0, 0), (800, 0), (800, 250), (0, 250)), (((100, 100), (150, 100), (150, 150), (100, 150)),)))
ZONE_SQL = """CASE WHEN x > 0 AND x < 600 AND y > 500 AND y < 1010 AND NOT (x > 200 AND x < 300 AND y > 600 AND y < 700) THEN 'north' WHEN x > 300 AND x < 700 AND y > 300 AND y < 700 THEN 'centre' WHEN x > 0 AND x < 800 AND y > 0 AND y < 250 AND NOT (x > 100 AND x < 150 AND y > 100 AND y < 150) THEN 'south' END"""


def zones(spark):
    rows = [(z, o, [[(float(a), float(b)) for a, b in r] for r in (outer, *holes)]) for z, o, outer, holes in ZONES]
    return spark.createDataFrame(rows, "zone string, ord int, rings array<array<struct<x:double,y:double>>>")


def zone_ring(i):
    """Outer ring of a zone as a literal."""
    return F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ZONES[i][2]])


def half_points(spark, sf_dir):
    """Points half a unit off the zones' edges."""
    return points(spark, sf_dir).select("id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))


HALF_SQL = f"{PT_SQL}, hp AS (SELECT id, x + 0.5 AS x, y + 0.5 AS y FROM pts)"


@C.add(f"WITH {HALF_SQL} SELECT id, {ZONE_SQL} AS zone FROM hp")
def point_in_zone(spark, sf_dir):
    return V.points_in_zones(half_points(spark, sf_dir), zones(spark), 100.0).select("id", "zone")


@C.add(f"WITH {HALF_SQL} SELECT id, round(least(abs(x), abs(x - 800)) , 6) AS side, round(CASE WHEN x BETWEEN 0 AND 800 AND y BETWEEN 0 AND 250 THEN least(x, 800 - x, y, 250 - y) ELSE sqrt(greatest(-x, 0, x - 800) ** 2 + greatest(-y, 0, y - 250) ** 2) END, 6) AS distance FROM hp")
def nearest_boundary(spark, sf_dir):
    d = S.boundary_distance(half_points(spark, sf_dir), zone_ring(2))
    return d.select("id", R(F.least(F.abs("x"), F.abs(F.col("x") - 800))).alias("side"), R(F.col("distance")).alias("distance"))


OBST_SQL = "obs AS (SELECT s_suppkey AS obstacle, (s_suppkey * 37 % 1000)::DOUBLE AS ox, (s_suppkey * 53 % 1000)::DOUBLE AS oy, 10.0 + s_suppkey % 30 AS r FROM supplier)"


def obstacles(spark, sf_dir):
    k = F.col("s_suppkey")
    o = table(spark, sf_dir, "supplier").select(k.alias("obstacle"), (k * 37 % 1000).cast("double").alias("ox"), (k * 53 % 1000).cast("double").alias("oy"), (10.0 + k % 30).alias("r"))
    p = lambda i, j: F.struct((F.col("ox") + i * F.col("r")).alias("x"), (F.col("oy") + j * F.col("r")).alias("y"))
    return o.withColumn("ring", F.array(p(-1, -1), p(1, -1), p(1, 1), p(-1, 1)))


@C.add(f"WITH {HALF_SQL}, {OBST_SQL} SELECT id, min(obstacle) AS obstacle FROM hp LEFT JOIN obs ON abs(x - ox) < r AND abs(y - oy) < r GROUP BY id")
def obstacle_at_point(spark, sf_dir):
    return S.obstacle_at_point(half_points(spark, sf_dir), obstacles(spark, sf_dir)).select("id", "obstacle")


@C.add(f"WITH {OBST_SQL} SELECT obstacle, round(4 * r * r, 6) AS area, round(8 * r, 6) AS perimeter FROM obs")
def ring_area(spark, sf_dir):
    return obstacles(spark, sf_dir).select("obstacle", R(G.ring_area(F.col("ring"))).alias("area"), R(G.ring_perimeter(F.col("ring"))).alias("perimeter"))


@C.add(f"WITH {OBST_SQL} SELECT obstacle, round(8 * r, 6) AS perimeter FROM obs")
def ring_perimeter(spark, sf_dir):
    return obstacles(spark, sf_dir).select("obstacle", R(G.ring_perimeter(F.col("ring"))).alias("perimeter"))


@C.add("SELECT c_custkey AS id, round((4 - 1) * 1e-6 * 111132.95 * 111320.0 * cos(radians(37.0 + (c_custkey % 10) / 10.0)), 1) AS area FROM customer")
def geom_area_holes(spark, sf_dir):
    lat = 37.0 + (F.col("c_custkey") % 10) / 10.0
    ring = lambda h: F.array(*[F.struct(F.lit(127.0 + a * h).alias("x"), (lat + b * h).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), R(G.polygon_area_lonlat(F.array(ring(0.001), ring(0.0005))), 1).alias("area"))


@C.add("WITH v AS (SELECT user_id, event_id, (event_id % 100)::DOUBLE AS x, (event_id * 3 % 70)::DOUBLE AS y, value AS z FROM events), l AS (SELECT user_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS h, z - lag(z) OVER w AS d FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), s AS (SELECT user_id, round(coalesce(sum(h), 0), 4) AS flat, round(coalesce(sum(sqrt(h * h + d * d)), 0), 4) AS slope FROM l GROUP BY user_id) SELECT s.*, round(arg_max(z, event_id) - arg_min(z, event_id), 4) AS rise, round(max(z) - min(z), 4) AS height_range FROM s JOIN v USING (user_id) GROUP BY ALL")
def path_length(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    pts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", (k % 100).cast("double").alias("x"), (k * 3 % 70).cast("double").alias("y"), F.col("value").alias("z")))), lambda p: F.struct(p["x"], p["y"], p["z"]))
    p = e.groupBy("user_id").agg(pts.alias("pts")).withColumn("l", G.path_length(F.col("pts")))
    z = F.transform("pts", lambda q: q["z"])
    return p.select("user_id", R(F.col("l.flat"), 4).alias("flat"), R(F.col("l.slope"), 4).alias("slope"), R(F.col("l.rise"), 4).alias("rise"), R(F.array_max(z) - F.array_min(z), 4).alias("height_range"))


@C.add("SELECT user_id, min(value) AS low, max(value) AS high, round(max(value) - min(value), 6) AS range FROM events GROUP BY user_id")
def path_heights(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), R(F.max("value") - F.min("value")).alias("range"))


@C.add(f"WITH {OBST_SQL} SELECT obstacle, round(100 * (4 * r * r - stated) / stated, 6) AS diff_pct, abs(100 * (4 * r * r - stated) / stated) > 0.5 AS over FROM (SELECT *, CASE WHEN obstacle % 5 = 0 THEN NULL ELSE 4 * r * r + obstacle % 3 * 5 END AS stated FROM obs) WHERE stated IS NOT NULL")
def area_check(spark, sf_dir):
    o = obstacles(spark, sf_dir).withColumn("measured", G.ring_area(F.col("ring")))
    o = o.withColumn("stated", F.when(F.col("obstacle") % 5 != 0, 4 * F.col("r") * F.col("r") + F.col("obstacle") % 3 * 5))
    return S.area_check(o).select("obstacle", "diff_pct", "over")


@C.add(f"WITH {HALF_SQL} SELECT id % 7 AS block, round(avg((({ZONE_SQL}) IS NOT NULL)::INT), 6) AS share, avg((({ZONE_SQL}) IS NOT NULL)::INT) < 0.9 AS problem FROM hp GROUP BY id % 7")
def position_check(spark, sf_dir):
    inside = V.points_in_zones(half_points(spark, sf_dir), zones(spark), 100.0)
    share = F.avg(F.col("zone").isNotNull().cast("int"))
    return inside.groupBy((F.col("id") % 7).alias("block")).agg(R(share).alias("share"), (share < 0.9).alias("problem"))


@C.add("SELECT s_suppkey, round(100 * (s_acctbal - (1000 + s_suppkey)) / (1000 + s_suppkey), 6) AS diff_pct, CASE WHEN s_suppkey % 3 = 0 THEN 'unregistered' WHEN abs(100 * (s_acctbal - (1000 + s_suppkey)) / (1000 + s_suppkey)) > 10 THEN 'differs' ELSE 'ok' END AS flag FROM supplier")
def register_area_diff(spark, sf_dir):
    reg = 1000 + F.col("s_suppkey")
    d = 100 * (F.col("s_acctbal") - reg) / reg
    return table(spark, sf_dir, "supplier").select("s_suppkey", R(d).alias("diff_pct"), F.when(F.col("s_suppkey") % 3 == 0, "unregistered").when(F.abs(d) > 10, "differs").otherwise("ok").alias("flag"))


@C.add("WITH a AS (SELECT o_custkey % 3000 AS label, o_orderkey AS x FROM orders), b AS (SELECT c_custkey AS label, c_nationkey AS x FROM customer), u AS (SELECT label, min(x) AS ax FROM a GROUP BY label HAVING count(*) = 1), v AS (SELECT label, min(x) AS bx FROM b GROUP BY label HAVING count(*) = 1) SELECT u.label, ax, bx FROM u JOIN v USING (label)")
def control_point_match(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3000).alias("label"), F.col("o_orderkey").alias("x"), F.lit(0).alias("y"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label"), F.col("c_nationkey").alias("x"), F.lit(0).alias("y"))
    return S.unique_matches(a, b).select("label", F.col("a.x").alias("ax"), F.col("b.x").alias("bx"))


@C.add("SELECT p_brand AS use, count(*) AS n, round(sum(p_retailprice), 2) AS area, round(100 * sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 1) AS pct FROM part GROUP BY p_brand")
def use_share(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    total = p.agg(F.sum("p_retailprice").alias("total"))
    by = p.groupBy(F.col("p_brand").alias("use")).agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("area"))
    return by.crossJoin(F.broadcast(total)).select("use", "n", R(F.col("area"), 2).alias("area"), R(F.try_divide(100 * F.col("area"), F.nullif("total", F.lit(0.0))), 1).alias("pct"))


@C.add("SELECT p_type AS use, count(*) AS n, round(sum(p_size), 2)::DOUBLE AS area FROM part GROUP BY p_type")
def block_by_use(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("use")).agg(F.count("*").alias("n"), F.sum("p_size").cast("double").alias("area"))


#: Suppliers as parcels of four uses: diamonds with a square hole, their corners off the cells' centres.
PARCEL_SQL = "par AS (SELECT s_suppkey AS parcel, 'u' || s_nationkey % 4 AS use, s_suppkey * 37 % 1000 + 0.3::DOUBLE AS px, s_suppkey * 53 % 1000 + 0.15::DOUBLE AS py, 10.0 + s_suppkey % 30 AS r FROM supplier), burnt AS (SELECT DISTINCT use, cx, cy FROM (SELECT *, unnest(generate_series(floor((py - r) / 2)::BIGINT, floor((py + r) / 2)::BIGINT)) AS cy FROM (SELECT *, unnest(generate_series(floor((px - r) / 2)::BIGINT, floor((px + r) / 2)::BIGINT)) AS cx FROM par)) WHERE abs(cx * 2 + 1 - px) + abs(cy * 2 + 1 - py) < r AND greatest(abs(cx * 2 + 1 - px), abs(cy * 2 + 1 - py)) >= r / 3)"


def parcels(spark, sf_dir):
    k, r = F.col("s_suppkey"), F.col("r")
    o = table(spark, sf_dir, "supplier").select(k.alias("parcel"), F.concat(F.lit("u"), (F.col("s_nationkey") % 4).cast("string")).alias("use"), (k * 37 % 1000 + 0.3).cast("double").alias("px"), (k * 53 % 1000 + 0.15).cast("double").alias("py"), (10.0 + k % 30).cast("double").alias("r"))
    p = lambda i, j: F.struct((F.col("px") + i * r).alias("x"), (F.col("py") + j * r).alias("y"))
    hole = F.array(*[F.struct((F.col("px") + i * r / 3).alias("x"), (F.col("py") + j * r / 3).alias("y")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    return o.select("parcel", "use", F.array(F.array(p(-1, 0), p(0, -1), p(1, 0), p(0, 1)), hole).alias("rings"))


@C.add(f"WITH {PARCEL_SQL} SELECT use, cx, cy FROM burnt")
def cells_union(spark, sf_dir):
    """Cells of 2 x 2 under the parcels of each use, dissolved."""
    return V.run_cells(V.cells_union(parcels(spark, sf_dir), ["use", "parcel"], ["use"], 2.0)).select("use", "cx", "cy")


@C.add(f"WITH {PARCEL_SQL}, site AS (SELECT cx, cy, cx * 2 + 1 AS x, cy * 2 + 1 AS y FROM (SELECT unnest(generate_series(0, 510)) AS cx), (SELECT unnest(generate_series(0, 510)) AS cy)) SELECT cx, cy FROM site WHERE ({ZONE_SQL}) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM burnt b WHERE b.cx = site.cx AND b.cy = site.cy)")
def cells_difference(spark, sf_dir):
    """The zones' cells that no parcel covers: the roads."""
    site = V.cells_union(zones(spark), ["zone"], [], 2.0)
    return V.run_cells(V.cells_difference(site, V.cells_union(parcels(spark, sf_dir), ["use", "parcel"], [], 2.0))).select("cx", "cy")


@C.add(f"WITH {PT_SQL} SELECT id FROM pts WHERE 2 * 6371.0 * asin(sqrt(sin(radians(37.25 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(37.25)) * sin(radians(126.95 - lng) / 2) ** 2)) <= 3.0")
def in_range_gate(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where(G.haversine_km(F.col("lat"), F.col("lng"), F.lit(37.25), F.lit(126.95)) <= 3.0).select("id")


@C.add("SELECT n_name, floor_no, wall, round(3.0 * floor_no - 1.4, 4) AS eye, round(wall - (3.0 * floor_no - 1.4), 4) AS below_top, 3.0 * floor_no - 1.4 > wall AS open FROM nation, (SELECT unnest(generate_series(1, 12)) AS floor_no), (VALUES (4.0), (8.0), (12.0)) w(wall)")
def scenario_sightline(spark, sf_dir):
    grid = table(spark, sf_dir, "nation").select("n_name", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("floor_no")).select("*", F.explode(F.array(F.lit(4.0), F.lit(8.0), F.lit(12.0))).alias("wall"))
    eye = 3.0 * F.col("floor_no") - 1.4
    return grid.select("n_name", "floor_no", "wall", R(eye, 4).alias("eye"), R(F.col("wall") - eye, 4).alias("below_top"), (eye > F.col("wall")).alias("open"))


@C.add(f"WITH {HALF_SQL}, d AS (SELECT id, least(sqrt((x - greatest(0, least(100, x))) ** 2 + y ** 2), sqrt(x ** 2 + (y - greatest(0, least(80, y))) ** 2)) AS d FROM hp) SELECT id, round(d, 6) AS distance, round(degrees(atan2(8.0 - 1.6, d)), 6) AS angle FROM d")
def wall_distance_angle(spark, sf_dir):
    clamp = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(hi), c))
    x, y = F.col("x"), F.col("y")
    d = F.least(F.hypot(x - clamp(x, 100.0), y), F.hypot(x, y - clamp(y, 80.0)))
    return half_points(spark, sf_dir).select("id", R(d).alias("distance"), R(F.degrees(F.atan2(F.lit(6.4), d))).alias("angle"))


COLORS = (("housing", 1.0, 0.9, 0.6), ("industry", 0.6, 0.7, 1.0), ("green", 0.6, 0.8, 0.8))


@C.add("""WITH c AS (SELECT p_partkey, (p_partkey % 11) / 10.0 + (p_partkey % 7) / 100.0 AS r, (p_partkey % 10) / 10.0 + 0.1 AS g, (p_partkey % 11) / 10.0 * 0.5 + 0.5 AS b, p_size * 20.0 AS y, p_retailprice / 950.0 AS area FROM part),
 d AS (SELECT *, (r - 1.0) ** 2 + (g - 0.9) ** 2 + (b - 0.6) ** 2 AS d1, (r - 0.6) ** 2 + (g - 0.7) ** 2 + (b - 1.0) ** 2 AS d2, (r - 0.6) ** 2 + (g - 0.8) ** 2 + (b - 0.8) ** 2 AS d3 FROM c WHERE y <= 760 AND area >= 1)
SELECT p_partkey, CASE WHEN abs(r - 1) < 0.01 AND abs(g - 1) < 0.01 AND abs(b - 1) < 0.01 THEN 'white' WHEN least(d1, d2, d3) >= 0.001 THEN NULL WHEN d1 <= d2 AND d1 <= d3 THEN 'housing' WHEN d2 <= d3 THEN 'industry' ELSE 'green' END AS use FROM d""")
def legend_color(spark, sf_dir):
    k = F.col("p_partkey")
    f = table(spark, sf_dir, "part").select("p_partkey", ((k % 11) / 10.0 + (k % 7) / 100.0).alias("r"), ((k % 10) / 10.0 + 0.1).alias("g"), ((k % 11) / 10.0 * 0.5 + 0.5).alias("b"), (F.col("p_size") * 20.0).alias("y"), (F.col("p_retailprice") / 950.0).cast("double").alias("area"))
    return S.classified_fills(f, COLORS).select("p_partkey", "use")


LINE_SQL = "ln AS (SELECT c_custkey AS line_id, c_nationkey % 5 AS code, (c_custkey % 40)::DOUBLE AS a, (c_custkey % 30 + 100)::DOUBLE AS b FROM customer)"


def lines(spark, sf_dir):
    k = F.col("c_custkey")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return table(spark, sf_dir, "customer").select(k.alias("line_id"), (F.col("c_nationkey") % 5).alias("code"), F.array(p(k % 40, F.lit(0)), p(k % 40 + 0.001, F.lit(0.001)), p(k % 40, k % 30 + 100), p(k % 40 + 300, k % 30 + 100)).alias("pts"))


@C.add(f"WITH {LINE_SQL} SELECT min(line_id) AS line_id, code, CAST(3 AS BIGINT) AS n FROM ln GROUP BY code, a, b")
def line_dedup(spark, sf_dir):
    return S.line_dedup(lines(spark, sf_dir)).select("line_id", "code", F.size("pts").cast("long").alias("n"))


@C.add(f"WITH {LINE_SQL}, d AS (SELECT min(line_id) AS line_id, code, a, b FROM ln GROUP BY code, a, b) SELECT code, count(*) AS kept, (SELECT count(*) FROM ln WHERE ln.code = d.code) - count(*) AS dropped FROM d GROUP BY code")
def line_code_counts(spark, sf_dir):
    raw = lines(spark, sf_dir)
    kept = S.line_dedup(raw).groupBy("code").agg(F.count("*").alias("kept"))
    return raw.groupBy("code").agg(F.count("*").alias("n")).join(kept, "code").select("code", "kept", (F.col("n") - F.col("kept")).alias("dropped"))


@C.add(f"WITH {LINE_SQL}, d AS (SELECT min(line_id) AS line_id, a, b FROM ln GROUP BY code, a, b), m AS (SELECT line_id, a, b, unnest(generate_series(0, 3)) AS mark FROM d), p AS (SELECT *, 80 + 160 * mark AS s FROM m WHERE 80 + 160 * mark < b + 300) SELECT line_id, mark, round(CASE WHEN s < b THEN a ELSE a + s - b END, 6) AS x, round(CASE WHEN s < b THEN s ELSE b END, 6) AS y, round(CASE WHEN s < b THEN 90.0 ELSE 0.0 END, 6) AS angle FROM p")
def contour_labels(spark, sf_dir):
    pts = F.filter("pts", lambda p, i: i != 1)
    clean = S.line_dedup(lines(spark, sf_dir).withColumn("pts", pts))
    m = S.contour_labels(clean)
    return m.select("line_id", "mark", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"), R(F.col("angle")).alias("angle"))


@C.add(f"WITH {LINE_SQL} SELECT line_id FROM ln WHERE code IN (1) AND a + 300 >= 200 - 50 AND a <= 310 + 50 AND b >= 110 - 50 AND 0 <= 120 + 50")
def layer_prefix_bbox(spark, sf_dir):
    ls = lines(spark, sf_dir).withColumn("layer", F.concat(F.lit("F"), F.col("code").cast("string"), F.lit("17")))
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    box = (F.array_max(xs) >= 150) & (F.array_min(xs) <= 360) & (F.array_max(ys) >= 60) & (F.array_min(ys) <= 170)
    return ls.where(F.col("layer").startswith("F1") & (F.size("pts") >= 2) & box).select("line_id")


@C.add("SELECT min(o_orderkey) AS id, x, y FROM (SELECT o_orderkey, (o_custkey % 100)::DOUBLE AS x, (o_orderkey % 50)::DOUBLE AS y, o_orderkey % 3 = 0 AS bad FROM orders) WHERE NOT bad GROUP BY x, y")
def spot_heights(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "12.34").otherwise(F.concat((F.col("o_orderkey") % 300).cast("string"), F.lit(".5")))
    s = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).cast("double").alias("x"), (F.col("o_orderkey") % 50).cast("double").alias("y"), text.alias("text"))
    return s.where(F.col("text").rlike(r"^\d{1,3}\.\d$")).groupBy(F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y")).agg(F.min("id").alias("id"))


# -- rasters: vectors as rows ---------------------------------------------------------------------------------------------------
CELL_SQL = """cells AS (SELECT label AS raster_id, vec_id // 10 AS row, i - 1 AS col, CASE WHEN (vec_id + i) % 17 = 0 THEN NULL ELSE round(10 * e::DOUBLE, 4) END AS v FROM (SELECT *, row_number() OVER () AS k FROM (SELECT label, vec_id, unnest(embedding) AS e, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))),
 ras AS (SELECT raster_id, row, col, avg(v) AS v FROM cells GROUP BY ALL)"""


def cells(spark, sf_dir):
    """A raster for each label: ten vectors fold into a row of 64 columns, so every label has all its rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("raster_id"), "vec_id", F.posexplode("embedding").alias("col", "e"))
    v = F.when((F.col("vec_id") + F.col("col") + 1) % 17 != 0, F.round(10 * F.col("e").cast("double"), 4))
    return e.groupBy("raster_id", F.floor(F.col("vec_id") / 10).alias("row"), F.col("col").cast("long").alias("col")).agg(F.avg(v).alias("v"))


def _levels():
    """SQL of the pyramid: each level from the one before, with the raster's size halved."""
    sql = [f"WITH {CELL_SQL}", "l0 AS (SELECT raster_id, row, col, v, max(row) OVER p + 1 AS nr, max(col) OVER p + 1 AS nc FROM ras WINDOW p AS (PARTITION BY raster_id))"]
    for i in range(1, 9):
        sql.append(f"l{i} AS (SELECT raster_id, row // 2 AS row, col // 2 AS col, avg(v) AS v, any_value(nr) // 2 AS nr, any_value(nc) // 2 AS nc FROM l{i - 1} WHERE nr // 2 >= 4 AND nc // 2 >= 4 AND row < nr - nr % 2 AND col < nc - nc % 2 GROUP BY raster_id, row // 2, col // 2)")
    return ", ".join(sql) + " " + " UNION ALL ".join(f"SELECT {i} AS level, raster_id, row, col, round(v, 8) AS v FROM l{i}" for i in range(1, 9))


@C.add(_levels())
def raster_pyramid(spark, sf_dir):
    return S.pyramid(cells(spark, sf_dir)).select("level", "raster_id", "row", "col", R(F.col("v"), 8).alias("v"))


@C.add(f"WITH {CELL_SQL} SELECT raster_id, min(v) AS low, max(v) AS high, round(avg(v), 8) AS mean, count(*) - count(v) AS void FROM ras GROUP BY raster_id")
def raster_stats(spark, sf_dir):
    return S.raster_stats(cells(spark, sf_dir)).withColumn("mean", R(F.col("mean"), 8))


@C.add(f"WITH {CELL_SQL}, q AS (SELECT raster_id, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.98) AS c FROM ras WHERE v > 0 GROUP BY raster_id) SELECT raster_id, row, col, round(CASE WHEN v IS NULL OR v = 0 OR a IS NULL THEN 128 ELSE greatest(least(CASE WHEN v < b THEN 20 + 108 * (v - a) / greatest(b - a, 1) ELSE 128 + 108 * (v - b) / greatest(c - b, 1) END, 255), 0) END, 4)::DOUBLE AS level FROM ras LEFT JOIN q USING (raster_id)")
def raster_stretch(spark, sf_dir):
    return S.stretch(cells(spark, sf_dir)).select("raster_id", "row", "col", R(F.col("level"), 4).alias("level"))


_SHADE = " + ".join(f"(1 - gx * sin(radians({a})) + gy * cos(radians({a}))) / sqrt(2.0 * (1 + gx * gx + gy * gy))" for a in (225, 270, 315, 360))


def _grad(w):
    return f"CASE WHEN lag(v) OVER {w} IS NULL AND lead(v) OVER {w} IS NULL THEN 0 ELSE coalesce((coalesce(lead(v) OVER {w}, v) - coalesce(lag(v) OVER {w}, v)) / (((lag(v) OVER {w} IS NOT NULL)::INT + (lead(v) OVER {w} IS NOT NULL)::INT) * 2.0), 0) END"


@C.add(f"WITH {CELL_SQL}, filled AS (SELECT raster_id, row, col, v IS NULL AS void, coalesce(v, median(v) OVER (PARTITION BY raster_id)) AS v FROM ras), g AS (SELECT *, {_grad('a')} AS gx, {_grad('d')} AS gy FROM filled WINDOW a AS (PARTITION BY raster_id, row ORDER BY col), d AS (PARTITION BY raster_id, col ORDER BY row)) SELECT raster_id, row, col, round(CASE WHEN void THEN 0 ELSE greatest(least(({_SHADE}) / 4, 1), 0) * 254 + 1 END, 4)::DOUBLE AS shade FROM g")
def hillshade_multi(spark, sf_dir):
    return S.hillshade(cells(spark, sf_dir), 2.0).select("raster_id", "row", "col", R(F.col("shade"), 4).alias("shade"))


def raster_points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 10).cast("int").alias("raster_id"), (k % 40 + (k % 4) / 4.0).alias("row"), (k % 60 + (k % 5) / 5.0).alias("col"))


RP_SQL = "rp AS (SELECT c_custkey AS id, (c_custkey % 10)::INT AS raster_id, c_custkey % 40 + (c_custkey % 4) / 4.0 AS row, c_custkey % 60 + (c_custkey % 5) / 5.0 AS col FROM customer)"


@C.add(f"""WITH {CELL_SQL}, {RP_SQL}, c AS (SELECT id, raster_id, floor(row)::BIGINT + i AS row, floor(col)::BIGINT + j AS col, (CASE WHEN i = 1 THEN row - floor(row) ELSE 1 - row + floor(row) END) * (CASE WHEN j = 1 THEN col - floor(col) ELSE 1 - col + floor(col) END) AS w FROM rp, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
 s AS (SELECT id, sum(w * v) AS s, sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) AS w FROM c LEFT JOIN ras USING (raster_id, row, col) GROUP BY id) SELECT id, round(CASE WHEN w > 0.5 THEN s / w END, 8) AS value FROM s""")
def raster_sample_join(spark, sf_dir):
    return S.sample(raster_points(spark, sf_dir), cells(spark, sf_dir)).select("id", R(F.col("value"), 8).alias("value"))


@C.add(f"WITH {CELL_SQL}, {RP_SQL} SELECT id, round(v, 8) AS value FROM rp LEFT JOIN ras ON ras.raster_id = rp.raster_id AND ras.row = floor(rp.row + 0.5) AND ras.col = floor(rp.col + 0.5)")
def raster_sample_nearest(spark, sf_dir):
    return S.sample_nearest(raster_points(spark, sf_dir), cells(spark, sf_dir)).select("id", R(F.col("value"), 8).alias("value"))


@C.add(f"WITH {CELL_SQL} SELECT a.raster_id, a.row, a.col, round(a.v - b.v, 8) AS d, CASE WHEN a.v - b.v > 1.5 THEN 'tree' ELSE 'ground' END AS cls FROM ras a JOIN ras b ON b.raster_id = a.raster_id - 1 AND a.row = b.row AND a.col = b.col WHERE a.v IS NOT NULL AND b.v IS NOT NULL")
def surface_minus_ground(spark, sf_dir):
    c = cells(spark, sf_dir)
    d = S.surface_minus_ground(c, c.withColumn("raster_id", F.col("raster_id") + 1)).where("d is not null")
    return d.select("raster_id", "row", "col", R(F.col("d"), 8).alias("d"), S.surface_class(F.col("d"), F.lit(False)).alias("cls"))


@C.add(f"WITH {CELL_SQL} SELECT raster_id, row, col, CASE WHEN col < 8 THEN 'building' WHEN v > 1.5 THEN 'tree' ELSE 'ground' END AS cls FROM ras WHERE v IS NOT NULL")
def surface_class(spark, sf_dir):
    return cells(spark, sf_dir).where("v is not null").select("raster_id", "row", "col", S.surface_class(F.col("v"), F.col("col") < 8).alias("cls"))


@C.add(f"WITH {CELL_SQL} SELECT raster_id, row, col, round(CASE WHEN v >= 0.3 THEN greatest(0, least(1, v / 6)) END, 8)::DOUBLE AS ramp FROM ras WHERE v IS NOT NULL")
def object_height_class(spark, sf_dir):
    return cells(spark, sf_dir).where("v is not null").select("raster_id", "row", "col", R(S.object_height(F.col("v")), 8).alias("ramp"))


@C.add(f"""WITH {CELL_SQL}, q AS (SELECT a.raster_id, a.row, a.col, a.v AS tl, b.v AS tr, c.v AS bl, d.v AS br FROM ras a JOIN ras b ON b.raster_id = a.raster_id AND b.row = a.row AND b.col = a.col + 1 JOIN ras c ON c.raster_id = a.raster_id AND c.row = a.row + 1 AND c.col = a.col JOIN ras d ON d.raster_id = a.raster_id AND d.row = a.row + 1 AND d.col = a.col + 1 WHERE a.v + b.v + c.v + d.v IS NOT NULL),
 k AS (SELECT *, (tl >= l)::INT * 8 + (tr >= l)::INT * 4 + (br >= l)::INT * 2 + (bl >= l)::INT AS case_no FROM q, (VALUES (0.5), (1.5)) v(l)), p AS (SELECT *, {{'x': col + (l - tl) / nullif(tr - tl, 0), 'y': row::DOUBLE}} AS t, {{'x': col + (l - bl) / nullif(br - bl, 0), 'y': row + 1.0}} AS b, {{'x': col::DOUBLE, 'y': row + (l - tl) / nullif(bl - tl, 0)}} AS le, {{'x': col + 1.0, 'y': row + (l - tr) / nullif(br - tr, 0)}} AS r FROM k WHERE case_no NOT IN (0, 15)),
 s AS (SELECT raster_id, l, row, col, unnest(CASE WHEN case_no IN (1, 14) THEN [[le, b]] WHEN case_no IN (2, 13) THEN [[b, r]] WHEN case_no IN (3, 12) THEN [[le, r]] WHEN case_no IN (4, 11) THEN [[t, r]] WHEN case_no IN (6, 9) THEN [[t, b]] WHEN case_no IN (7, 8) THEN [[le, t]] WHEN case_no = 5 THEN [[le, t], [b, r]] ELSE [[le, b], [t, r]] END) AS e FROM p)
SELECT raster_id, l::DOUBLE AS level, row, col, round(e[1].x, 6)::DOUBLE AS ax, round(e[1].y, 6)::DOUBLE AS ay, round(e[2].x, 6)::DOUBLE AS bx, round(e[2].y, 6)::DOUBLE AS by FROM s""")
def contour_segments(spark, sf_dir):
    s = S.contour_segments(cells(spark, sf_dir), (0.5, 1.5))
    return s.select("raster_id", "level", "row", "col", *[R(F.col(c)).alias(c) for c in ("ax", "ay", "bx", "by")])


@C.add(f"""WITH {PT_SQL}, m AS (SELECT {MERC}, id FROM pts), t AS (SELECT z, floor((mx + {HALF!r}) / ({2 * HALF!r} / 2 ** z))::BIGINT AS tx, floor(({HALF!r} - my) / ({2 * HALF!r} / 2 ** z))::BIGINT AS ty, id FROM m, (SELECT unnest(generate_series(8, 17)) AS z)),
 r AS (SELECT z, min(tx) AS x0, max(tx) AS x1, min(ty) AS y0, max(ty) AS y1 FROM t GROUP BY z), w AS (SELECT z, tx, unnest(generate_series(y0, y1)) AS ty FROM (SELECT *, unnest(generate_series(x0, x1)) AS tx FROM r)), h AS (SELECT z, tx, ty, count(*) AS valid FROM t WHERE id % 3 > 0 GROUP BY ALL)
SELECT z::INT AS z, tx, ty, coalesce(valid, 0) AS valid, valid IS NOT NULL AS present FROM w LEFT JOIN h USING (z, tx, ty)""")
def tile_inventory(spark, sf_dir):
    """Customers as pixels, one in three void."""
    x, y = G.mercator(F.col("lng"), F.col("lat"))
    return S.tile_inventory(points(spark, sf_dir).select(x.alias("x"), y.alias("y"), F.when(F.col("id") % 3 > 0, 1.0).alias("v")), 8, 17)


# -- evidence -------------------------------------------------------------------------------------------------------------------
EV_SQL = r"""op AS (SELECT item_id AS opinion_id, 0 AS key, lower(regexp_replace(text, '\s+', '', 'g')) AS norm FROM benchmark), ev AS (SELECT doc_id, 0 AS key, lower(regexp_replace(text, '\s+', '', 'g')) AS norm FROM documents),
 og AS (SELECT DISTINCT key, opinion_id, substr(norm, i, 3) AS g FROM (SELECT *, unnest(generate_series(1, greatest(length(norm) - 2, 1))) AS i FROM op)), eg AS (SELECT DISTINCT key, doc_id, substr(norm, i, 3) AS g FROM (SELECT *, unnest(generate_series(1, greatest(length(norm) - 2, 1))) AS i FROM ev)),
 t AS (SELECT opinion_id, count(*) AS total FROM og GROUP BY 1), s AS (SELECT opinion_id, doc_id, count(*) AS n FROM og JOIN eg USING (key, g) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY opinion_id ORDER BY n DESC, doc_id) = 1),
 sc AS (SELECT opinion_id, doc_id, round(coalesce(n, 0) / total, 6) AS score FROM t LEFT JOIN s USING (opinion_id))"""


def evidence(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("opinion_id"), F.lower(T.flat(F.col("text"))).alias("norm"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(T.flat(F.col("text"))).alias("norm"))
    return b, d


#: Agencies of the sample binding: opinions have decomposed names, letters composed ones; agency 6 wrote no letter.
KEY_SQL = """k AS (SELECT opinion_id, nfc_normalize(concat_ws(chr(31), 'g' || opinion_id % 2, 'Cafe' || chr(769) || opinion_id % 7, 'd' || opinion_id % 2)) AS key, norm FROM op),
 ek AS (SELECT doc_id, concat_ws(chr(31), 'g' || doc_id % 2, 'Caf' || chr(233) || doc_id % 7, 'd' || doc_id % 2) AS key, norm FROM ev WHERE doc_id % 7 <> 6)"""
AGENCY_SQL = EV_SQL[: EV_SQL.index("og AS")] + KEY_SQL + """, kg AS (SELECT DISTINCT key, opinion_id, substr(norm, i, 3) AS g FROM (SELECT *, unnest(generate_series(1, greatest(length(norm) - 2, 1))) AS i FROM k)), dg AS (SELECT DISTINCT key, doc_id, substr(norm, i, 3) AS g FROM (SELECT *, unnest(generate_series(1, greatest(length(norm) - 2, 1))) AS i FROM ek)),
 t AS (SELECT opinion_id, count(*) AS total FROM kg GROUP BY 1), s AS (SELECT opinion_id, doc_id, count(*) AS n FROM kg JOIN dg USING (key, g) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY opinion_id ORDER BY n DESC, doc_id) = 1),
 sc AS (SELECT opinion_id, doc_id, round(coalesce(n, 0) / total, 6) AS score FROM t LEFT JOIN s USING (opinion_id)), op2 AS (SELECT opinion_id, CASE WHEN opinion_id % 9 = 0 THEN '미회신' ELSE '회신' END AS status FROM op)"""


def agency_evidence(spark, sf_dir):
    """Opinions and letters of agencies; the letters of one agency are missing."""
    b, d = evidence(spark, sf_dir)
    key = lambda i, name: E.agency_key(F.concat(F.lit("g"), i % 2), F.concat(F.lit(name), i % 7), F.concat(F.lit("d"), i % 2))
    return b.withColumn("key", key(F.col("opinion_id"), "Cafe\u0301")), d.where("doc_id % 7 <> 6").withColumn("key", key(F.col("doc_id"), "Caf\u00e9"))


@C.add(f"WITH {AGENCY_SQL} SELECT opinion_id, (SELECT count(*) FROM ek WHERE ek.key = k.key) AS n FROM k")
def evidence_candidates(spark, sf_dir):
    return E.candidates(*agency_evidence(spark, sf_dir))


@C.add(f"WITH {EV_SQL} SELECT opinion_id, doc_id, score FROM sc")
def evidence_coverage(spark, sf_dir):
    return E.coverage(*evidence(spark, sf_dir))


VERDICT_SQL = "CASE WHEN status = '미회신' THEN '미회신' WHEN doc_id IS NULL THEN '원문없음' WHEN score >= 0.85 THEN '일치' WHEN score >= 0.60 THEN '부분일치' WHEN opinion_id % 4 = 0 THEN '의견없음' ELSE '상이' END"


def agency_verdicts(spark, sf_dir):
    """Opinions within their agency's letters, some without a reply, some trivial, those of one agency without a letter."""
    b, d = agency_evidence(spark, sf_dir)
    scored = E.coverage(b, d, ["key"]).join(b.select("opinion_id", F.when(F.col("opinion_id") % 9 == 0, "미회신").otherwise("회신").alias("status")), "opinion_id")
    score = F.when(F.col("doc_id").isNotNull(), F.col("score"))
    return scored.withColumn("verdict", E.verdict(score, F.lit("x"), F.col("status"), F.col("opinion_id") % 4 == 0))


@C.add(f"WITH {AGENCY_SQL} SELECT opinion_id, doc_id, score, {VERDICT_SQL} AS verdict FROM sc JOIN op2 USING (opinion_id)")
def evidence_by_agency(spark, sf_dir):
    return agency_verdicts(spark, sf_dir).select("opinion_id", "doc_id", "score", "verdict")


@C.add(f"WITH {AGENCY_SQL} SELECT {VERDICT_SQL} AS verdict, count(*) AS n FROM sc JOIN op2 USING (opinion_id) GROUP BY 1")
def match_verdicts(spark, sf_dir):
    return agency_verdicts(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@C.add(f"WITH {AGENCY_SQL} SELECT opinion_id FROM sc JOIN op2 USING (opinion_id) WHERE {VERDICT_SQL} IN ('부분일치', '상이')")
def verify_filter(spark, sf_dir):
    return agency_verdicts(spark, sf_dir).where(F.col("verdict").isin("부분일치", "상이")).select("opinion_id")


@C.add()
def longest_common_excerpt(spark, sf_dir):
    """The excerpt of the best document of each opinion that scores at least 0.35; only the winners' texts are made flat and joined."""
    from ..functions.helpers import longest_common_excerpt as excerpt

    b, d = evidence(spark, sf_dir)
    won = checkpoint(E.coverage(b, d).where("score >= 0.35"))
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))
    j = raw.join(F.broadcast(won) if won.count() <= E.BROADCAST_ROWS else won, "doc_id").withColumn("src", F.lower(T.flat(F.col("raw"))))
    j = j.join(b.select("opinion_id", F.col("norm").alias("op")), "opinion_id").repartition("opinion_id")
    return j.select("opinion_id", "doc_id", "score", excerpt("op", "src").alias("excerpt"))
