"""Queries of sources, sinks and the incremental jobs, over data that Spark derives from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import monitor as M
from ..operators.stable import checkpoint, shared_folder
from ..sources import files
from ..streaming import jobs, portal, tracking
from ..streaming import posts as stored
from .base import NEWS_SQL, ORG_ANY, ORG_QUERIES, SITE_PLACE, SITE_WITH, Catalog, news_items, table
from .ledger import ROWS_SQL, rows
from .monitor import RESOLVE_SQL, TAG_SQL
from .spatial import ZONE_SQL, zone_ring, zones
from .text import posts

C = Catalog()
QUERIES, ORACLE = C.QUERIES, C.ORACLE


def thirds(df, order):
    """All rows in three batches by ranges of ``order``; only its greatest value reaches the driver."""
    top = df.agg(F.max(order).alias("top")).first()["top"] or 0
    part = F.least(F.floor(3 * F.col(order) / (top + 1)), F.lit(2))
    return [df.where(part == i) for i in range(3)]


@C.add(f"WITH {NEWS_SQL} SELECT query, count(*) AS n, max(date) AS last_date FROM news GROUP BY query")
def sink_status(spark, sf_dir):
    n = news_items(spark, sf_dir)
    s = n.groupBy("query").agg(F.array(F.struct(F.lit("n").alias("label"), F.count("*").alias("value"), F.lit("건").alias("unit"))).alias("metrics"), F.max("date").alias("updated"))
    return s.select("query", F.col("metrics")[0]["value"].alias("n"), F.col("updated").alias("last_date"))


@C.add("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'x item ' || o_orderkey ELSE 'item ' || o_orderkey || ' more <b' END AS text, strftime(o_orderdate, '%Y-%m-%d') AS date, 'http://f/' || o_orderkey AS href FROM orders")
def src_feed_xml(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    rss = F.concat(F.lit("<rss><channel><title>t</title><item><title>x</title><link>http://f/"), k, F.lit("</link><description>&lt;b&gt;item &lt;/b&gt; "), k, F.lit("</description><pubDate>"), F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 03:00:00 GMT</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>item "), k, F.lit('</title><media:group xmlns:media="m"><media:description>&lt;i&gt;more&lt;/i&gt; &lt;b</media:description></media:group><link href="http://f/'), k, F.lit('"/><updated>'), F.date_format(day, "yyyy-MM-dd"), F.lit("T03:00:00Z</updated></entry></feed>"))
    e = files.parse_feeds(o.select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, rss).otherwise(atom).alias("raw")))
    return e.select("seq", "text", F.col("when.date").alias("date"), "href")


@C.add("SELECT o_orderkey AS seq, 'News ' || o_orderkey AS title, 'Daily' AS source, strftime(o_orderdate, '%Y-%m-%d') AS date, 'd ' || o_orderkey AS \"desc\" FROM orders")
def src_news_rss(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit("<rss><channel><item><title>News "), k, F.lit(" - Daily</title><link>l</link><description>&lt;i&gt;d&lt;/i&gt; "), k, F.lit("</description><pubDate>"), F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "EEE, dd MMM yyyy"), F.lit(" 03:00:00 GMT</pubDate></item></channel></rss>"))
    return files.parse_news_feeds(o.select(F.col("o_orderkey").alias("seq"), raw.alias("raw"))).select("seq", "title", "source", "date", "desc")


@C.add("SELECT o_orderkey AS seq, CASE WHEN k = 1 THEN 'infolist' ELSE 'orginl' END AS kind, CASE WHEN k = 1 THEN 'N' || o_custkey ELSE 'P' || o_orderkey END AS id FROM orders, (VALUES (1), (2)) v(k)")
def src_nested_store(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = lambda p, c: F.array(F.struct(F.concat(F.lit(p), F.col(c).cast("string")).alias("id")))
    raw = F.to_json(F.struct(F.lit("x").alias("updated"), F.struct(one("N", "o_custkey").alias("infolist"), one("P", "o_orderkey").alias("orginl")).alias("items")))
    return files.parse_nested_store(o.select(F.col("o_orderkey").alias("seq"), raw.alias("raw")), "raw", "id string", ("infolist", "orginl"))


@C.add("SELECT s_suppkey AS id, s_name AS use, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_polys, (s_suppkey % 100)::DOUBLE AS x0 FROM supplier")
def src_geojson(spark, sf_dir):
    k = F.col("s_suppkey")
    ring = F.concat(F.lit("[[["), (k % 100).cast("string"), F.lit(",0],[200,0],[200,9]]]"))
    geometry = F.when(k % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit(","), ring, F.lit("]}")))
    raw = F.concat(F.lit('{"type":"FeatureCollection","features":[{"properties":{"use":"'), "s_name", F.lit('"},"geometry":'), geometry, F.lit("}]}"))
    g = files.parse_geojson(table(spark, sf_dir, "supplier").select(k.alias("id"), raw.alias("raw")), "raw", "use string")
    return g.select("id", "use", F.size("polys").cast("long").alias("n_polys"), F.col("polys")[0][0][0][0].alias("x0"))


@C.add("SELECT c_custkey AS id, c_name AS label, 37.0 + (c_custkey % 8) / 8.0 AS lat, 127.0 + (c_custkey % 4) / 4.0 AS lng, CASE WHEN c_custkey % 3 = 0 THEN 'a, \"b\"' ELSE c_mktsegment END AS note FROM customer")
def src_csv_points(spark, sf_dir):
    k = F.col("c_custkey")
    note = F.when(k % 3 == 0, 'a, "b"').otherwise(F.col("c_mktsegment"))
    line = files.csv_line([F.col("c_name"), (37.0 + (k % 8) / 8.0).alias("lat"), (127.0 + (k % 4) / 4.0).alias("lng"), note.alias("note")], {})
    return files.parse_points_csv(table(spark, sf_dir, "customer").select(k.alias("id"), line.alias("raw")), "raw")


@C.add("SELECT c_custkey AS id, '\"' || c_name || '\",\"' || CASE WHEN c_custkey % 2 = 0 THEN 'say \"\"hi\"\"' ELSE c_mktsegment END || '\"' AS line FROM customer")
def sink_csv_quoted(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 2 == 0, 'say "hi"').otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), files.csv_line([F.col("c_name"), text.alias("text")], files.QUOTED).alias("line"))


@C.add("SELECT c_custkey AS id, c_name || ',' || CASE WHEN c_custkey % 2 = 0 THEN '\"a' || chr(10) || c_mktsegment || '\"' ELSE c_mktsegment END AS line FROM customer")
def sink_csv_minimal(spark, sf_dir):
    lists = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), "c_mktsegment")).otherwise(F.array("c_mktsegment"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", lists.alias("lines"))
    _, name, lines = files.joined_lists(c)
    return c.select(F.col("c_custkey").alias("id"), files.csv_line([name, lines], files.MINIMAL).alias("line"))


@C.add(f"WITH {NEWS_SQL} SELECT query, count(*) AS total, count(*) FILTER (WHERE source <> '') AS with_source FROM news GROUP BY query")
def sink_json_snapshot(spark, sf_dir):
    """Rows of a snapshot as JSON lines, read back and counted as its meta file does."""
    lines = news_items(spark, sf_dir).select(F.to_json(F.struct("query", "source", "seq")).alias("line"))
    back = lines.select(F.from_json("line", "query string, source string, seq long").alias("r")).select("r.*")
    return back.groupBy("query").agg(F.count("*").alias("total"), F.count_if(F.col("source") != "").alias("with_source"))


@C.add(f"WITH {ROWS_SQL} SELECT sheet, count(*) AS n FROM (SELECT 'ledger' AS sheet FROM recs UNION ALL SELECT 'open' FROM recs WHERE status IN ('미반영', '미기재', '미회신') OR again = 'Y' UNION ALL SELECT 'by_dept' FROM (SELECT DISTINCT grp, org, dept FROM recs)) GROUP BY sheet")
def sink_ledger_sheets(spark, sf_dir):
    r = rows(spark, sf_dir)
    sheets = {"ledger": r, "open": L.open_items(r), "by_dept": L.by_dept(r)}
    out = None
    for name, df in sheets.items():
        one = df.select(F.lit(name).alias("sheet"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("sheet").agg(F.count("*").alias("n"))


@C.add(f"WITH {TAG_SQL} SELECT key, min(seq) AS seq FROM tagged GROUP BY key")
def inc_news(spark, sf_dir):
    """What the archive holds after the items have come in three batches: first of each key over all of them.

    What a batch adds is stored as keys before the next comes, so each item is tagged once."""
    held = None
    for part in thirds(news_items(spark, sf_dir), "seq"):
        first = M.news_dedup(M.news_tag(part, ORG_ANY, ORG_QUERIES, SITE_PLACE, SITE_WITH)).select("key", "seq")
        new = checkpoint(first if held is None else M.fresh(first, held))
        held = new if held is None else held.unionByName(new)
    return held.select("key", "seq")


@C.add(f"""WITH {RESOLVE_SQL} SELECT key, arg_max(platform, seq) AS platform, arg_max(account, seq) AS account, (arg_max({{'t': text}}, {{'n': length(text), 's': -seq}})).t AS text, coalesce(arg_min(url, seq) FILTER (WHERE url <> ''), '') AS url, coalesce(arg_min(date, seq) FILTER (WHERE exact), arg_min(date, seq)) AS date, bool_or(exact) AS exact, min(seq) AS first_seen, max(seq) AS last_seen, count(*) AS n FROM res GROUP BY key""")
def inc_posts(spark, sf_dir):
    """The stored posts after the captures have come in three batches, with a base written after the second."""
    path = f"{shared_folder(spark)}/posts-{uuid.uuid4()}"
    put = stored.fold_batch(path, every=2)
    for i, batch in enumerate(thirds(posts(spark, sf_dir), "seq")):
        put(batch, i)
    return stored.posts_state(spark, path).select("key", "platform", "account", "text", "url", "date", "exact", "first_seen", "last_seen", "n")


@C.add("WITH o AS (SELECT 'N' || o_custkey AS id, *, least(floor(3 * o_orderkey / ((SELECT max(o_orderkey) FROM orders) + 1)), 2) AS part FROM orders) SELECT id, arg_min(o_orderstatus, o_orderkey) AS status, strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS produced, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kwds, min(part) = (SELECT max(part) FROM o) AS added FROM o GROUP BY id")
def inc_portal_rescan(spark, sf_dir):
    """Records and keywords stored after three batches; a base after the second closes the months before the horizon."""
    o = table(spark, sf_dir, "orders")
    records = o.select(F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("seq"), F.array("o_orderpriority").alias("kwds"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").cast("date").alias("produced"))
    path = f"{shared_folder(spark)}/portal-{uuid.uuid4()}"
    put = portal.portal_batch(path, every=2)
    for i, batch in enumerate(thirds(records, "seq")):
        put(batch, i)
    s = portal.portal_state(spark, path)
    return s.select("id", "status", F.date_format("produced", "yyyy-MM-dd").alias("produced"), F.array_join("kwds", ",").alias("kwds"), "added")


@C.add("SELECT key, updated IS NULL OR epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(updated) > 3600 * h AS stale FROM (VALUES ('click', 24), ('view', 48), ('nothing', 36)) v(key, h) LEFT JOIN (SELECT event_type AS key, max(ts) AS updated FROM events GROUP BY 1) USING (key)")
def stale_monitor(spark, sf_dir):
    feed = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("updated"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    return jobs.stale(jobs.latest_by_key(feed), {"click": 24, "view": 48, "nothing": 36}, now).select("key", "stale")


@C.add("SELECT count(*) FILTER (WHERE event_type <> 'error') AS collected, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-15') AS fresh, 'publish' AS verdict FROM events")
def collection_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return jobs.collection_gate(e.select((F.col("event_type") != "error").alias("ok"), (F.col("ts").cast("timestamp_ntz") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("is_new")))


FIX_SQL = "fx AS (SELECT event_id, user_id AS device, ts, 37.25 + (event_id % 41 - 20) / 2000.0 AS lat, 126.95 + (event_id % 37 - 18) / 2000.0 AS lng, value / 10.0 AS speed, (event_id % 360)::DOUBLE AS heading, CASE WHEN event_id % 3 = 0 THEN (event_id % 180)::DOUBLE END AS compass FROM events)"


@C.add("WITH " + FIX_SQL + """, t AS (SELECT *, (lng - 126.95) * 111320.0 * cos(radians(37.25)) AS x, (lat - 37.25) * 111132.95 AS y, 2 * 6371.0 * asin(sqrt(sin(radians(37.25 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(37.25)) * sin(radians(126.95 - lng) / 2) ** 2)) <= 1.2 AS in_range, CASE WHEN speed > 0.7 THEN heading END AS moved FROM fx),
 o AS (SELECT device, min({'t': ts, 'e': event_id}) AS left_at FROM t WHERE NOT in_range GROUP BY device), k AS (SELECT t.*, x + 0.5 AS hx, y + 0.5 AS hy FROM t LEFT JOIN o USING (device) WHERE left_at IS NULL OR {'t': ts, 'e': event_id} < left_at),
 d AS (SELECT *, coalesce(last_value(compass IGNORE NULLS) OVER w, last_value(moved IGNORE NULLS) OVER w) AS direction, row_number() OVER w = 1 AS first FROM k WINDOW w AS (PARTITION BY device ORDER BY ts, event_id))
SELECT event_id, round(x, 3) AS x, round(y, 3) AS y, direction, first, """ + ZONE_SQL.replace("x ", "hx ").replace("y ", "hy ") + """ AS zone, round(CASE WHEN hx BETWEEN 0 AND 800 AND hy BETWEEN 0 AND 250 THEN 0 ELSE sqrt(greatest(-hx, 0, hx - 800) ** 2 + greatest(-hy, 0, hy - 250) ** 2) END, 3) AS outside, CASE WHEN direction IS NOT NULL THEN ['북', '북동', '동', '남동', '남', '남서', '서', '북서'][(floor(direction / 45 + 0.5)::INT % 8) + 1] END AS toward FROM d""")
def track_fixes(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    fixes = e.select("event_id", F.col("user_id").alias("device"), "ts", (37.25 + (k % 41 - 20) / 2000.0).alias("lat"), (126.95 + (k % 37 - 18) / 2000.0).alias("lng"), (F.col("value") / 10.0).alias("speed"), (k % 360).cast("double").alias("heading"), F.when(k % 3 == 0, (k % 180).cast("double")).alias("compass"))
    half = tracking.follow(tracking.positions(fixes, 37.25, 126.95, 1.2)).withColumns({"x": F.col("x") + 0.5, "y": F.col("y") + 0.5})
    t = tracking.place(half, zones(spark), zone_ring(2), 100.0)
    return t.select("event_id", F.round(F.col("x") - 0.5, 3).alias("x"), F.round(F.col("y") - 0.5, 3).alias("y"), "direction", "first", "zone", F.round("outside", 3).alias("outside"), "toward")
