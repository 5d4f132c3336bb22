"""Queries of the monitoring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..operators.stable import number_rows
from .base import NEWS_SQL, ORG_ANY, ORG_QUERIES, SITE_PLACE, SITE_WITH, TOPICS, Catalog, news_items, table
from .text import KEY_SQL, PORTAL_SQL, POST_SQL, portal_raw, posts

C = Catalog()
QUERIES, ORACLE = C.QUERIES, C.ORACLE


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _first(text, rules):
    return "CASE " + " ".join(f"WHEN {_any(text, words)} THEN '{name}'" for name, words in rules) + " ELSE '기타 동향' END"


TAG_SQL = rf"""{NEWS_SQL}, spaced AS (SELECT *, regexp_replace(title || "desc", '\s+', '', 'g') AS flat FROM news),
 flags AS (SELECT *, {_any('flat', [w.replace(' ', '') for w in ORG_ANY])} OR query IN {ORG_QUERIES} AS org, {_any('flat', SITE_PLACE)} AND {_any('flat', SITE_WITH)} AS site FROM spaced),
 tagged AS (SELECT *, CASE WHEN org AND site THEN 'both' WHEN org THEN 'org' ELSE 'site' END AS tag, substr(regexp_replace(title, '[^\p{{L}}\p{{N}}_]', '', 'g'), 1, 40) AS key FROM flags WHERE org OR site)"""
DEDUP_SQL = f"""{TAG_SQL}, first AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1),
 topics AS (SELECT *, CASE WHEN tag IN ('site', 'both') THEN {_first("(title || ' ' || \"desc\")", TOPICS['site'])} ELSE {_first("(title || ' ' || \"desc\")", TOPICS['org'])} END AS topic FROM first)"""


def tagged(spark, sf_dir):
    return M.news_tag(news_items(spark, sf_dir), ORG_ANY, ORG_QUERIES, SITE_PLACE, SITE_WITH)


def picked(spark, sf_dir):
    return M.with_topic(M.news_dedup(tagged(spark, sf_dir)), TOPICS)


@C.add(f"WITH {TAG_SQL} SELECT seq, tag FROM tagged")
def news_tag(spark, sf_dir):
    return tagged(spark, sf_dir).select("seq", "tag")


@C.add(f"WITH {DEDUP_SQL} SELECT seq, tag, key FROM first")
def news_dedup(spark, sf_dir):
    return M.news_dedup(tagged(spark, sf_dir)).select("seq", "tag", "key")


@C.add(f"WITH {DEDUP_SQL} SELECT seq, topic FROM topics")
def news_topic(spark, sf_dir):
    return picked(spark, sf_dir).select("seq", "topic")


@C.add(f"WITH {DEDUP_SQL} SELECT tag, topic, count(*) AS n, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (WHERE \"desc\" <> '') AS with_text FROM topics GROUP BY tag, topic")
def news_summary(spark, sf_dir):
    return M.news_summary(picked(spark, sf_dir))


@C.add(f"""WITH {DEDUP_SQL}, aged AS (SELECT topic, source, tag, date, DATE '2025-01-20' - CAST(date AS DATE) AS age FROM topics)
SELECT 'topic' AS facet, topic AS value, count(*) AS n FROM aged GROUP BY topic UNION ALL SELECT 'source', source, count(*) FROM aged GROUP BY source UNION ALL SELECT 'period', 'all', count(*) FROM aged HAVING count(*) > 0
UNION ALL SELECT 'period', '7', count(*) FROM aged WHERE age <= 7 HAVING count(*) > 0 UNION ALL SELECT 'period', '30', count(*) FROM aged WHERE age <= 30 HAVING count(*) > 0 UNION ALL SELECT 'period', '90', count(*) FROM aged WHERE age <= 90 HAVING count(*) > 0 UNION ALL SELECT 'period', 'year', count(*) FROM aged WHERE date LIKE '2025%' HAVING count(*) > 0
UNION ALL SELECT 'group', 'org', count(*) FROM aged WHERE tag IN ('org', 'both') HAVING count(*) > 0 UNION ALL SELECT 'group', 'site', count(*) FROM aged WHERE tag IN ('site', 'both') HAVING count(*) > 0""")
def news_facets(spark, sf_dir):
    return M.news_facets(picked(spark, sf_dir), "2025-01-20")


@C.add(f"WITH {DEDUP_SQL} SELECT seq FROM topics WHERE contains(lower(title || ' ' || \"desc\" || ' ' || source || ' ' || topic), 'the') AND contains(lower(title || ' ' || \"desc\" || ' ' || source || ' ' || topic), 'src') AND tag IN ('org', 'both') AND DATE '2025-01-20' - CAST(date AS DATE) <= 200")
def news_search(spark, sf_dir):
    return M.news_search(picked(spark, sf_dir), ("The", "src"), group="org", days=200, today="2025-01-20").select("seq")


@C.add(f"WITH {DEDUP_SQL} SELECT seq, key FROM first WHERE key NOT IN (SELECT key FROM first WHERE seq % 4 = 0)")
def news_fresh(spark, sf_dir):
    first = M.news_dedup(tagged(spark, sf_dir))
    return M.fresh(first, first.where("seq % 4 = 0")).select("seq", "key")


@C.add(f"WITH {TAG_SQL} SELECT key, max(seq) AS seq, min(seq) AS position FROM tagged GROUP BY key")
def news_archive_upsert(spark, sf_dir):
    from ..functions.text import title_key

    t = tagged(spark, sf_dir).withColumn("key", title_key(F.col("title")))
    return M.archive_upsert(t.where("seq % 2 = 0"), t.where("seq % 2 = 1")).select("key", "seq", "position")


@C.add(f"WITH {DEDUP_SQL} SELECT seq, date, row_number() OVER (ORDER BY date DESC, seq) AS place FROM first")
def news_sort(spark, sf_dir):
    return number_rows(M.news_dedup(tagged(spark, sf_dir)).select("seq", "date"), M.news_order())


@C.add(f"WITH {DEDUP_SQL} SELECT seq, date FROM first ORDER BY date DESC, seq LIMIT 50 OFFSET 50")
def page_slice(spark, sf_dir):
    return M.news_sort(M.news_dedup(tagged(spark, sf_dir))).select("seq", "date").offset(50).limit(50)


GRADE_RULES = {"hard_exclude": [["1-URGENT", "O"]], "exclude": [["LOW"]], "guard": ["F"], "land": [["HIGH", "F"], ["MEDIUM", "O"]], "core": [["HIGH"], ["NOT", "P"]]}
GRADE_SQL = """CASE WHEN (contains(t, '1-URGENT') AND contains(t, 'O')) OR (contains(t, 'LOW') AND NOT contains(t, 'F')) THEN NULL WHEN (contains(t, 'HIGH') AND contains(t, 'F')) OR (contains(t, 'MEDIUM') AND contains(t, 'O')) THEN 'land' WHEN contains(t, 'HIGH') OR (contains(t, 'NOT') AND contains(t, 'P')) THEN 'core' ELSE 'related' END"""
RECORDS_SQL = f"""{PORTAL_SQL}, recs AS (SELECT o_orderkey AS seq, id, instt, trim(pri, ' ') AS title, se, substr(dt, 1, 4) || '-' || substr(dt, 5, 2) || '-' || substr(dt, 7, 2) AS date, CASE o_orderkey % 5 WHEN 0 THEN '공개' WHEN 1 THEN '부분공개' ELSE '비공개' END AS othbc,
 CASE WHEN o_orderkey % 4 = 0 THEN 'orginl' ELSE 'infolist' END AS kind, trim(pri, ' ') || ' ' || o_orderstatus AS t, CASE WHEN o_orderkey % 2 = 0 THEN 'Plans' ELSE 'Roads' END AS dept, o_orderkey % 3 = 0 AS has_orginl, 'k' || (o_orderkey % 6) AS kwd FROM raw), graded AS (SELECT *, {GRADE_SQL} AS grade FROM recs)"""


def records(spark, sf_dir):
    r = M.normalize_record(portal_raw(spark, sf_dir), F.concat(F.lit("k"), (F.col("seq") % 6).cast("string")), "https://portal.example/detail")
    return r.withColumn("kind", F.when(F.col("seq") % 4 == 0, "orginl").otherwise("infolist")).withColumn("grade", M.portal_grade(F.concat_ws(" ", "title", "unit_job"), GRADE_RULES))


@C.add(f"WITH {RECORDS_SQL} SELECT seq, grade FROM graded")
def portal_classify(spark, sf_dir):
    return records(spark, sf_dir).select("seq", "grade")


@C.add(f"WITH {RECORDS_SQL} SELECT seq, kwd2 AS kwd FROM recs, (VALUES ('HIGH'), ('NOT SPECIFIED'), ('M E')) v(kwd2) WHERE date BETWEEN '1994-01-01' AND '1996-06-30' AND (CASE kwd2 WHEN 'HIGH' THEN contains(title, 'HIGH') WHEN 'NOT SPECIFIED' THEN contains(title, 'NOT') AND contains(title, 'SPECIFIED') ELSE contains(title, 'M') AND contains(title, 'E') END)")
def portal_allword_search(spark, sf_dir):
    words = spark.createDataFrame([("HIGH",), ("NOT SPECIFIED",), ("M E",)], "kwd string")
    return M.allword_search(records(spark, sf_dir), words, "1994-01-01", "1996-06-30").select("seq", "kwd")


@C.add(f"""WITH {RECORDS_SQL}, r AS (SELECT *, seq % 2 = 1 AS new FROM recs), f AS (SELECT id, arg_min(title, CASE WHEN new THEN 1000000000 ELSE 0 END + seq) AS title, arg_min(seq, CASE WHEN new THEN 1000000000 ELSE 0 END + seq) AS seq, bool_and(new) AS added FROM r GROUP BY id)
SELECT f.id, f.title, f.seq, f.added, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT kwd AS k FROM r WHERE r.id = f.id)) AS kwds FROM f""")
def portal_merge(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "title", "kwds", "seq")
    return M.portal_merge(r.where("seq % 2 = 0"), r.where("seq % 2 = 1")).select("id", "title", "seq", "added", F.array_join("kwds", ",").alias("kwds"))


@C.add(f"WITH {RECORDS_SQL} SELECT kind, count(*) AS total, count(*) FILTER (WHERE grade = 'core') AS core, count(*) FILTER (WHERE grade = 'land') AS land, count(*) FILTER (WHERE grade = 'related') AS other, count(*) FILTER (WHERE grade IS NULL) AS excluded FROM graded GROUP BY kind")
def portal_counts(spark, sf_dir):
    return M.counts_by_kind(records(spark, sf_dir))


@C.add(f"WITH {RECORDS_SQL} SELECT kind, kwd, count(*) AS collected, count(*) + 3 AS reported FROM recs GROUP BY kind, kwd")
def portal_query_stats(spark, sf_dir):
    return records(spark, sf_dir).groupBy("kind", F.col("kwds")[0].alias("kwd")).agg(F.count("*").alias("collected"), (F.count("*") + 3).alias("reported"))


@C.add(f"WITH {RECORDS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE grade = 'core') AS core, count(*) FILTER (WHERE grade = 'land') AS land, count(*) FILTER (WHERE date > '1998-07-01') AS recent FROM graded WHERE grade IS NOT NULL")
def portal_cards(spark, sf_dir):
    g = F.col("grade")
    return records(spark, sf_dir).where("grade is not null").agg(F.count("*").alias("total"), F.count_if(g == "core").alias("core"), F.count_if(g == "land").alias("land"), F.count_if(F.col("date") > "1998-07-01").alias("recent"))


@C.add(f"""WITH {RECORDS_SQL}, f AS (SELECT *, coalesce(se = 'C' OR se = 'W', false) AS a, coalesce(dept = 'Roads', false) AS b, coalesce(othbc <> '비공개', false) AS c FROM graded)
SELECT 'instt_se' AS facet, se AS value, count(*) AS n FROM f WHERE b AND c GROUP BY se UNION ALL SELECT 'dept', dept, count(*) FROM f WHERE a AND c GROUP BY dept UNION ALL SELECT 'othbc', othbc, count(*) FROM f WHERE a AND b GROUP BY othbc""")
def facet_excl_self(spark, sf_dir):
    return M.facets_excluding_self(records(spark, sf_dir), {"instt_se": F.col("instt_se").isin("C", "W"), "dept": F.col("dept") == "Roads", "othbc": F.col("othbc") != "비공개"})


@C.add(f"WITH {RECORDS_SQL} SELECT substr(date, 1, 4) AS year, count(*) AS n FROM recs WHERE date <> '' GROUP BY 1")
def portal_years(spark, sf_dir):
    return records(spark, sf_dir).where("date <> ''").groupBy(F.substring("date", 1, 4).alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year"))


@C.add(f"""WITH {RECORDS_SQL}, m AS (SELECT strftime(CAST(unnest(generate_series(DATE '1996-07-01', DATE '1998-06-01', INTERVAL 1 MONTH)) AS DATE), '%Y-%m') AS month), c AS (SELECT substr(date, 1, 7) AS month, count(*) AS n FROM recs GROUP BY 1), j AS (SELECT m.month, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (month))
SELECT month, n, greatest((SELECT max(n) FROM j), 1) AS peak FROM j""")
def portal_trend_24m(spark, sf_dir):
    return M.trend_24_months(records(spark, sf_dir), "1998-06")


@C.add(f"WITH {RECORDS_SQL} SELECT seq FROM graded WHERE contains(lower(title || ' ' || instt || ' ' || dept || ' ' || seq), 'h') AND contains(lower(title || ' ' || instt || ' ' || dept || ' ' || seq), '1') AND se IN ('C', 'B') AND date >= '1995-01-01' AND date <= '1997-12-31'")
def portal_search(spark, sf_dir):
    from ..functions.text import rule_hits

    r = records(spark, sf_dir)
    text = F.lower(F.concat_ws(" ", "title", "instt", "dept", "doc_no"))
    return r.where(rule_hits(text, [["h", "1"]]) & F.col("instt_se").isin("C", "B") & (F.col("date") >= "1995-01-01") & (F.col("date") <= "1997-12-31")).select("seq")


@C.add(f"WITH {RECORDS_SQL} SELECT seq, date, row_number() OVER (ORDER BY date, seq) AS place FROM recs")
def portal_sort(spark, sf_dir):
    return number_rows(records(spark, sf_dir).select("seq", "date"), M.portal_order("old"))


@C.add(f"WITH {RECORDS_SQL} SELECT instt, count(*) AS n FROM recs GROUP BY instt ORDER BY n DESC, instt LIMIT 12")
def top_institutions(spark, sf_dir):
    return records(spark, sf_dir).groupBy("instt").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "instt").limit(12)


@C.add(f"WITH {RECORDS_SQL} SELECT id, seq, CAST(2 AS BIGINT) AS n_files FROM recs WHERE othbc = '공개' QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN kind = 'orginl' THEN 0 ELSE 1 END, seq) = 1")
def downloadable_docs(spark, sf_dir):
    return M.downloadable(records(spark, sf_dir)).select("id", "seq", F.col("n_files").cast("long").alias("n_files"))


@C.add(f"WITH {RECORDS_SQL} SELECT kind, id, seq FROM recs")
def union_kinds(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.where("kind = 'orginl'").unionByName(r.where("kind = 'infolist'").drop("grade"), allowMissingColumns=True).select("kind", "id", "seq")


@C.add(f"WITH {RECORDS_SQL} SELECT id FROM recs WHERE kind = 'orginl' INTERSECT SELECT id FROM recs WHERE kind = 'infolist'")
def set_by_key(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.where("kind = 'orginl'").select("id").intersect(r.where("kind = 'infolist'").select("id"))


@C.add(f"WITH {RECORDS_SQL} SELECT seq, grade FROM graded WHERE grade IS NOT NULL")
def reclassify(spark, sf_dir):
    stored = records(spark, sf_dir).drop("grade")
    return stored.withColumn("grade", M.portal_grade(F.concat_ws(" ", "title", "unit_job"), GRADE_RULES)).where("grade is not null").select("seq", "grade")


# -- posts ----------------------------------------------------------------------------------------------------------------
GROUPS = (("low", ("1", "2")), ("click", ("click", "scroll")), ("buy", ("purchase", "9")))
CLASS_SQL = f"{POST_SQL}, cls AS (SELECT *, contains(text, '1') OR contains(text, '2') AS a, contains(text, 'click') OR contains(text, 'scroll') AS b, contains(text, 'purchase') OR contains(text, '9') AS c FROM posts)"


def classified(spark, sf_dir):
    return posts(spark, sf_dir).withColumns(M.classify_post(F.col("text"), GROUPS, ("buy",)))


@C.add(f"WITH {CLASS_SQL} SELECT seq, concat_ws(',', CASE WHEN a THEN 'low' END, CASE WHEN b THEN 'click' END, CASE WHEN c THEN 'buy' END) AS groups, concat_ws(',', CASE WHEN contains(text, '1') THEN '1' END, CASE WHEN contains(text, '2') THEN '2' END, CASE WHEN contains(text, '9') THEN '9' END, CASE WHEN contains(text, 'click') THEN 'click' END, CASE WHEN contains(text, 'purchase') THEN 'purchase' END, CASE WHEN contains(text, 'scroll') THEN 'scroll' END) AS words, c AS priority FROM cls")
def post_classify(spark, sf_dir):
    return classified(spark, sf_dir).select("seq", F.array_join("groups", ",").alias("groups"), F.array_join("words", ",").alias("words"), "priority")


@C.add(f"WITH {POST_SQL} SELECT seq FROM posts WHERE NOT (contains(text, 'error') OR contains(text, '7'))")
def post_exclude(spark, sf_dir):
    from ..functions.text import any_word

    return posts(spark, sf_dir).where(~any_word(F.col("text"), [w for w in ("error", "", "7") if w])).select("seq")


RESOLVE_SQL = f"""{POST_SQL}, keyed AS (SELECT *, {KEY_SQL} AS k FROM posts), anc AS (SELECT k, arg_min(date, seq) AS anchor FROM keyed WHERE exact GROUP BY k), res AS (SELECT p.*, CASE WHEN exact AND date <> anchor THEN p.k || '@' || date ELSE p.k END AS key FROM keyed p LEFT JOIN anc USING (k))"""


@C.add(f"WITH {RESOLVE_SQL} SELECT seq, key FROM res")
def post_resolve_key(spark, sf_dir):
    return M.resolve_keys(posts(spark, sf_dir)).select("seq", "key")


@C.add(f"""WITH {RESOLVE_SQL} SELECT key, arg_max(platform, seq) AS platform, arg_max(account, seq) AS account, (arg_max({{'t': text}}, {{'n': length(text), 's': -seq}})).t AS text, coalesce(arg_min(url, seq) FILTER (WHERE url <> ''), '') AS url, coalesce(arg_min(date, seq) FILTER (WHERE exact), arg_min(date, seq)) AS date, bool_or(exact) AS exact, min(seq) AS seq, count(*) AS n FROM res GROUP BY key""")
def post_merge(spark, sf_dir):
    return M.merge_posts(M.resolve_keys(posts(spark, sf_dir))).select("key", "platform", "account", "text", "url", "date", "exact", "seq", "n")


@C.add(f"WITH {POST_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE fixed <> date) AS corrected FROM (SELECT date, CASE WHEN seq % 50 = 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') ELSE date END AS fixed FROM posts)")
def post_repair(spark, sf_dir):
    from ..functions.text import kst_date

    p = posts(spark, sf_dir)
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    fixed = F.when(F.col("seq") % 50 == 0, kst_date(iso)).otherwise(F.col("date"))
    return p.withColumn("fixed", fixed).agg(F.count("*").alias("n"), F.count_if(F.col("fixed") != F.col("date")).alias("corrected"))


@C.add(f"WITH {CLASS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE a OR b OR c) AS detected, count(*) FILTER (WHERE c) AS priority, count(DISTINCT account) AS accounts, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT platform AS p FROM cls)) AS platforms FROM cls")
def post_counts(spark, sf_dir):
    c = classified(spark, sf_dir)
    return c.agg(F.count("*").alias("total"), F.count_if(F.size("groups") > 0).alias("detected"), F.count_if("priority").alias("priority"), F.countDistinct("account").alias("accounts"), F.array_join(F.array_sort(F.collect_set("platform")), ",").alias("platforms"))


@C.add(f"WITH {CLASS_SQL} SELECT 'group' AS facet, 'low' AS value, count(*) AS n FROM cls WHERE a UNION ALL SELECT 'group', 'click', count(*) FROM cls WHERE b UNION ALL SELECT 'group', 'buy', count(*) FROM cls WHERE c UNION ALL SELECT 'platform', platform, count(*) FROM cls GROUP BY platform UNION ALL SELECT 'account', account, count(*) FROM cls GROUP BY account")
def post_group_counts(spark, sf_dir):
    one = lambda f, v: F.struct(F.lit(f).alias("facet"), v.alias("value"))
    pairs = F.concat(F.transform("groups", lambda g: one("group", g)), F.array(one("platform", F.col("platform")), one("account", F.col("account"))))
    return classified(spark, sf_dir).select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


@C.add(f"WITH {CLASS_SQL} SELECT seq FROM cls WHERE platform = 'click' AND b AND contains(text, '5')")
def post_search(spark, sf_dir):
    c = classified(spark, sf_dir)
    return c.where((F.col("platform") == "click") & F.array_contains("groups", "click") & (F.size("groups") > 0) & F.col("text").contains("5")).select("seq")


@C.add(f"WITH {CLASS_SQL} SELECT seq, row_number() OVER (ORDER BY date DESC, ts DESC, seq) AS place, row_number() OVER (ORDER BY c DESC, a OR b OR c DESC, date DESC, ts DESC, seq) AS screen_place FROM cls")
def post_sort(spark, sf_dir):
    placed = number_rows(classified(spark, sf_dir).select("seq", "date", "ts", "groups", "priority"), M.post_order())
    return number_rows(placed, M.post_order(screen=True), "screen_place").select("seq", "place", "screen_place")


@C.add(f"WITH {POST_SQL} SELECT account, CASE account WHEN 'User3' THEN 1 WHEN 'User7' THEN 2 ELSE 999 END AS rank FROM (SELECT DISTINCT account FROM posts)")
def post_person_order(spark, sf_dir):
    ranks = spark.createDataFrame([("User3", 1), ("User7", 2)], "account string, rank int")
    return posts(spark, sf_dir).select("account").distinct().join(F.broadcast(ranks), "account", "left").select("account", F.coalesce("rank", F.lit(999)).alias("rank")).orderBy("rank", "account")


@C.add(f"WITH {POST_SQL} SELECT account, seq FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY seq) AS r FROM posts) WHERE r <= 20 AND seq % 3 <> 0")
def feed_cap(spark, sf_dir):
    p = posts(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("text")))
    return M.feed_cap(p).select("account", "seq")


@C.add(f"WITH {POST_SQL} SELECT event_id AS file_id FROM events WHERE event_id % 10 = 0 AND event_id NOT IN (SELECT seq FROM posts WHERE url <> '')")
def orphan_files(spark, sf_dir):
    files = table(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.col("event_id").alias("file_id"))
    used = posts(spark, sf_dir).where("url <> ''").select(F.col("seq").alias("file_id"))
    return files.join(used, "file_id", "left_anti")


HUB_SQL = """feeds AS (SELECT event_type AS key, max(ts) AS updated, count(*) AS total, sum((value > 10)::INT)::BIGINT AS high FROM events WHERE event_type <> 'error' GROUP BY 1), sites AS (SELECT DISTINCT event_type AS key, CASE WHEN event_type < 'm' THEN 'high' ELSE 'none' END AS pick FROM events),
 hub AS (SELECT s.key, f.updated, CASE WHEN pick = 'high' THEN high ELSE total END AS value, f.updated IS NULL OR epoch(TIMESTAMP '2024-02-01 12:00:00') - epoch(f.updated) > 3600 * 36 AS stale FROM sites s LEFT JOIN feeds f USING (key))"""


def _hub(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = lambda label, v: F.struct(F.lit(label).alias("label"), v.alias("value"))
    feeds = e.where("event_type <> 'error'").groupBy(F.col("event_type").alias("key")).agg(F.max("ts").alias("updated"), F.array(m("total", F.count("*")), m("high", F.count_if(F.col("value") > 10))).alias("metrics"))
    sites = e.select(F.col("event_type").alias("key")).distinct().withColumns({"pick": F.when(F.col("key") < "m", "high").otherwise("none"), "stale_hours": F.lit(36)})
    now = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz").cast("timestamp")
    return M.hub_status(sites, feeds.withColumn("updated", F.col("updated").cast("timestamp")), now)


@C.add(f"WITH {HUB_SQL} SELECT key, value FROM hub")
def status_pick(spark, sf_dir):
    return _hub(spark, sf_dir).select("key", "value")


@C.add(f"WITH {HUB_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE stale) AS stale, strftime(max(updated), '%Y-%m-%d %H:%M') AS newest FROM hub")
def hub_status(spark, sf_dir):
    return _hub(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if("stale").alias("stale"), F.date_format(F.max("updated"), "yyyy-MM-dd HH:mm").alias("newest"))


@C.add("SELECT strftime(CAST(s AS DATE), '%Y-%m-%d') AS start, strftime(CAST(s AS DATE) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS last, month(s) % 3 = 1 AS quarter_start, (SELECT count(*) FROM orders WHERE o_orderdate >= s AND o_orderdate < s + INTERVAL 1 MONTH) AS n FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders)::TIMESTAMP, (SELECT max(o_orderdate) FROM orders)::TIMESTAMP, INTERVAL 1 MONTH)) AS s)")
def month_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    span = o.agg(F.trunc(F.min("d"), "month").alias("a"), F.max("d").alias("b"))
    windows = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("s"))
    counted = o.groupBy(F.trunc("d", "month").alias("s")).agg(F.count("*").alias("n"))
    w = windows.join(counted, "s", "left")
    return w.select(F.date_format("s", "yyyy-MM-dd").alias("start"), F.date_format(F.last_day("s"), "yyyy-MM-dd").alias("last"), (F.month("s") % 3 == 1).alias("quarter_start"), F.coalesce("n", F.lit(0)).alias("n"))


@C.add("""WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS href, unnest(generate_series(1, len(regexp_extract_all(html, 'href="/([^"]*)"', 1)))) AS pos FROM pages), g AS (SELECT page_id, href, min(pos) AS pos FROM f WHERE href <> '' GROUP BY page_id, href)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place, href FROM g""")
def embedded_file_list(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(F.col("html"), F.lit('href="/([^"]*)"'), F.lit(1))).alias("pos", "href")).where("href <> ''")
    first = rows.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("long").alias("place"), "href")


@C.add(r"SELECT page_id FROM pages WHERE NOT (regexp_matches(url, '^\w+://[^/]*/de/') AND regexp_matches(url, '^\w+://[^/?#]*\.org[/?#]'))")
def robots_gate(spark, sf_dir):
    from ..functions.helpers import robots_allowed

    p = table(spark, sf_dir, "pages").withColumn("host", F.parse_url("url", F.lit("HOST")))
    hosts = p.select("host").distinct().where(F.col("host").endswith(".org")).withColumn("robots", F.lit("User-agent: *\nDisallow: /de/"))
    return p.join(hosts, "host", "left").where(robots_allowed("robots", "url")).select("page_id")
