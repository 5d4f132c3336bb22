"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import helpers as H
from ..functions import text as T
from .base import NEWS_SQL, Catalog, news_items, table

C = Catalog()
QUERIES, ORACLE = C.QUERIES, C.ORACLE


@C.add(f"""WITH {NEWS_SQL}, t AS (SELECT seq, CASE WHEN seq % 2 = 0 THEN replace(title, '-', '') || ' - Outlet ' || query ELSE title END AS title, source FROM news)
SELECT seq, trim(CASE WHEN regexp_matches(title, '^(.*) - ([^-]+)$', 's') THEN regexp_extract(title, '^(.*) - ([^-]+)$', 1, 's') ELSE title END, ' ') AS title,
 CASE WHEN source = '' THEN (CASE WHEN regexp_matches(title, '^(.*) - ([^-]+)$', 's') THEN trim(regexp_extract(title, '^(.*) - ([^-]+)$', 2, 's'), ' ') ELSE '' END) ELSE source END AS source FROM t""")
def news_split_title(spark, sf_dir):
    n = news_items(spark, sf_dir)
    titled = n.withColumn("title", F.when(F.col("seq") % 2 == 0, F.concat(F.replace("title", F.lit("-"), F.lit("")), F.lit(" - Outlet "), "query")).otherwise(F.col("title")))
    title, source = T.split_title(F.col("title"), F.col("source"))
    return titled.select("seq", title.alias("title"), source.alias("source"))


@C.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 18 HOUR + INTERVAL 9 HOUR, '%Y-%m-%d') END AS date FROM orders""")
def news_pub_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stamp = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "EEE, dd MMM yyyy"), F.lit(" 18:00:00 GMT"))
    return o.select("o_orderkey", T.rfc822_date(F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(stamp)).alias("date"))


@C.add("SELECT page_id, substr(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), 1, 300) AS text FROM pages")
def strip_html_300(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@C.add(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM pages")
def strip_html_ws(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html_spaced(F.col("html")).alias("text"))


@C.add(rf"WITH {NEWS_SQL} SELECT seq, substr(regexp_replace(title, '[^\p{{L}}\p{{N}}_]', '', 'g'), 1, 40) AS key FROM news")
def title_key(spark, sf_dir):
    return news_items(spark, sf_dir).select("seq", T.title_key(F.col("title")).alias("key"))


SOURCE_NAMES = {"src1": "First Press", "src2": "Second Press"}
SOURCE_URLS = (("/src4/", "Fourth Daily"), ("/src5/", "Fifth Daily"), ("/src6/", "Sixth Daily"))


@C.add(f"""WITH {NEWS_SQL} SELECT seq, CASE WHEN source = 'src1' THEN 'First Press' WHEN source = 'src2' THEN 'Second Press' WHEN source <> '' THEN source
 WHEN contains(link, '/src4/') THEN 'Fourth Daily' WHEN contains(link, '/src5/') THEN 'Fifth Daily' WHEN contains(link, '/src6/') THEN 'Sixth Daily' ELSE '기타' END AS outlet FROM news""")
def source_fix(spark, sf_dir):
    from ..operators.monitor import fix_source

    return news_items(spark, sf_dir).select("seq", fix_source(F.col("source"), F.col("link"), SOURCE_NAMES, SOURCE_URLS).alias("outlet"))


@C.add(f"WITH {NEWS_SQL} SELECT seq, CASE WHEN seq % 5 = 0 THEN substr(date, 1, 7) || '-15' WHEN seq % 11 = 1 THEN '' ELSE date END AS date FROM news")
def best_date(spark, sf_dir):
    n = news_items(spark, sf_dir)
    page = F.when(F.col("seq") % 5 == 0, F.concat(F.substring("date", 1, 7), F.lit("-15"))).otherwise("")
    feed = F.when(F.col("seq") % 11 == 1, F.lit(None)).otherwise(F.col("date"))
    return n.select("seq", T.best_date(page, feed).alias("date"))


PAGE_SQL = """metas AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<META property="og:description" content=" A &amp; ' || url || ' ">' WHEN page_id % 3 = 1 THEN '<meta content=''D ' || url || ''' name="description">' ELSE '' END
 || '<meta property="article:published_time" content="2024' || sep || '0' || (1 + page_id % 9) || sep || '1' || (page_id % 10) || 'T09:00:00+09:00">' || html AS html FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN '-' WHEN 1 THEN '.' WHEN 2 THEN '/' ELSE '' END AS sep FROM pages))"""


def _metas(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    desc = F.when(i % 3 == 0, F.concat(F.lit('<META property="og:description" content=" A &amp; '), "url", F.lit(' ">'))).when(i % 3 == 1, F.concat(F.lit("<meta content='D "), "url", F.lit("' name=\"description\">"))).otherwise("")
    sep = F.when(i % 4 == 0, "-").when(i % 4 == 1, ".").when(i % 4 == 2, "/").otherwise("")
    stamp = F.concat(F.lit('<meta property="article:published_time" content="2024'), sep, F.lit("0"), (1 + i % 9).cast("string"), sep, F.lit("1"), (i % 10).cast("string"), F.lit('T09:00:00+09:00">'))
    return p.select("page_id", F.concat(desc, stamp, "html").alias("html"))


@C.add(f"""WITH {PAGE_SQL} SELECT page_id, trim(replace(CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, 'content="([^"]*)"', 1) ELSE '' END, '&amp;', '&'), ' ') AS og FROM metas""")
def html_meta(spark, sf_dir):
    return _metas(spark, sf_dir).select("page_id", F.trim(H.html_unescape(T.html_meta(F.col("html"), "og:description"))).alias("og"))


@C.add(rf"""WITH {PAGE_SQL} SELECT page_id, substr(trim(CASE WHEN page_id % 3 = 0 THEN replace(regexp_extract(html, 'content="([^"]*)"', 1), '&amp;', '&') WHEN page_id % 3 = 1 THEN regexp_extract(html, 'content=''([^'']*)''', 1) ELSE '' END, ' '), 1, 400) AS summary FROM metas""")
def html_summary(spark, sf_dir):
    return _metas(spark, sf_dir).select("page_id", T.html_summary(F.col("html")).alias("summary"))


@C.add("SELECT page_id, '2024-0' || (1 + page_id % 9) || '-1' || (page_id % 10) AS date FROM pages")
def html_pub_date(spark, sf_dir):
    return _metas(spark, sf_dir).select("page_id", T.html_published(F.col("html")).alias("date"))


@C.add("SELECT doc_id, text FROM documents")
def decode_bytes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("raw", F.encode("text", "utf-8"))
    sound = F.try_validate_utf8(F.col("raw").cast("string"))
    return d.select("doc_id", F.when(sound.isNotNull(), sound).otherwise(H.decode_bytes("raw")).alias("text"))


KOREAN_SQL = """ko AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || '이 사업은 지원을 한다.' WHEN 1 THEN lang || '一丁七万丈三上' WHEN 2 THEN text || 'ㄱㄴㄷ' WHEN 3 THEN '' ELSE text END AS s FROM documents),
 k AS (SELECT doc_id, s, (contains(s, '이 ')::INT + contains(s, '다.')::INT + contains(s, '는 ')::INT + contains(s, '을 ')::INT + contains(s, '를 ')::INT + contains(s, '의 ')::INT + contains(s, '에 ')::INT + contains(s, '했')::INT + contains(s, '한다')::INT + contains(s, '하는')::INT + contains(s, '기업')::INT + contains(s, '지원')::INT + contains(s, '사업')::INT) AS n,
 length(s) - length(regexp_replace(s, '[一-鿿]', '', 'g')) AS han, length(s) - length(regexp_replace(s, '[ㄱ-ㆎ]', '', 'g')) AS jamo FROM ko)"""


def _korean(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    s = F.when(i == 0, F.concat(F.col("text"), F.lit("이 사업은 지원을 한다."))).when(i == 1, F.concat(F.col("lang"), F.lit("一丁七万丈三上"))).when(i == 2, F.concat(F.col("text"), F.lit("ㄱㄴㄷ"))).when(i == 3, "").otherwise(F.col("text"))
    return d.select("doc_id", s.alias("s"))


@C.add(f"WITH {KOREAN_SQL} SELECT doc_id, n >= 2 AND 100 * han < 12 * length(s) AS ok FROM k")
def text_korean_ok(spark, sf_dir):
    return _korean(spark, sf_dir).select("doc_id", T.korean_ok(F.col("s")).alias("ok"))


@C.add(f"WITH {KOREAN_SQL} SELECT doc_id, s <> '' AND NOT (n >= 2 AND 100 * han < 12 * length(s)) AND (100 * han > 15 * length(s) OR jamo >= 3) AS broken FROM k")
def text_broken(spark, sf_dir):
    return _korean(spark, sf_dir).select("doc_id", T.text_broken(F.col("s"), H.redecode_cp949("s")).alias("broken"))


@C.add(f"WITH {NEWS_SQL} SELECT title AS t, link AS u, date AS d, CASE WHEN source = '' THEN '기타' ELSE source END AS s, lang AS g, query AS c, substr(\"desc\", 1, 100) AS y FROM news")
def news_publish(spark, sf_dir):
    from ..operators.monitor import publish

    n = news_items(spark, sf_dir)
    return publish(n.withColumns({"summary": F.substring("desc", 1, 100), "source": F.when(F.col("source") == "", "기타").otherwise(F.col("source"))}), tag="lang", topic="query")


PORTAL_SQL = """raw AS (SELECT 'N' || o_custkey AS id, 'Office ' || (o_custkey % 40) AS instt, CASE o_orderkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'W' WHEN 2 THEN 'B' WHEN 3 THEN 'E' ELSE 'X' END AS se, strftime(o_orderdate, '%Y%m%d') AS dt, o_orderpriority AS pri, o_orderkey, o_orderstatus FROM orders)"""


def portal_raw(spark, sf_dir):
    """Orders as raw records of a portal."""
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    se = F.when(i == 0, "C").when(i == 1, "W").when(i == 2, "B").when(i == 3, "E").otherwise("X")
    return o.select(
        F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("PRDCTN_INSTT_REGIST_NO"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("INFO_SJ"), F.concat(F.lit(" Office "), (F.col("o_custkey") % 40).cast("string")).alias("PROC_INSTT_NM"), se.alias("INSTT_SE_CD"),
        F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.lit("Roads")).alias("NFLST_CHRG_DEPT_NM"), F.lit("Plans").alias("CHRG_DEPT_NM"), F.col("o_orderkey").cast("string").alias("DOC_NO"), F.lit("Kim").alias("CHARGER_NM"), F.col("o_orderstatus").alias("UNIT_JOB_NM"),
        F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyyMMdd").alias("PRDCTN_DT"), F.when(i == 0, "1").when(i == 1, "2").otherwise("3").alias("OTHBC_SE_CD"), F.lit("a|b").alias("FILE_NM"), F.when(F.col("o_orderkey") % 3 == 0, "Y").otherwise("N").alias("ORGNAL_YN"), F.col("o_orderkey").alias("seq"),
    )


@C.add(f"""WITH {PORTAL_SQL} SELECT o_orderkey AS seq, id, trim(pri, ' ') AS title, instt, CASE se WHEN 'C' THEN '중앙행정기관' WHEN 'W' THEN '광역자치단체' WHEN 'B' THEN '기초자치단체' WHEN 'E' THEN '교육청' WHEN 'P' THEN '공공기관' ELSE '' END AS instt_se_nm,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Plans' ELSE 'Roads' END AS dept, substr(dt, 1, 4) || '-' || substr(dt, 5, 2) || '-' || substr(dt, 7, 2) AS date, CASE o_orderkey % 5 WHEN 0 THEN '공개' WHEN 1 THEN '부분공개' ELSE '비공개' END AS othbc, o_orderkey % 3 = 0 AS has_orginl, 'word' AS kwds FROM raw""")
def portal_normalize(spark, sf_dir):
    from ..operators.monitor import normalize_record

    n = normalize_record(portal_raw(spark, sf_dir), F.lit("word"), "https://portal.example/detail")
    return n.select("seq", "id", "title", "instt", "instt_se_nm", "dept", "date", "othbc", "has_orginl", F.array_join("kwds", ",").alias("kwds"))


@C.add(f"WITH {PORTAL_SQL} SELECT o_orderkey AS seq, 'https://portal.example/detail?prdnNstRgstNo=' || id || '+%2A~&prdnDt=' || dt || '&nstSeCd=' || se AS url FROM raw")
def portal_detail_url(spark, sf_dir):
    r = portal_raw(spark, sf_dir)
    return r.select("seq", T.detail_url("https://portal.example/detail", F.concat("PRDCTN_INSTT_REGIST_NO", F.lit(" *~")), F.col("PRDCTN_DT"), F.col("INSTT_SE_CD")).alias("url"))


@C.add("SELECT c_custkey, CASE WHEN length(substr(c_name, 1, CAST(c_custkey % 9 AS INT))) >= 2 THEN substr(c_name, 1, 1) || repeat('○', length(substr(c_name, 1, CAST(c_custkey % 9 AS INT))) - 1) ELSE substr(c_name, 1, CAST(c_custkey % 9 AS INT)) END AS name FROM customer")
def mask_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.mask_name(F.concat(F.lit(" "), F.substring(F.col("c_name"), F.lit(1), (F.col("c_custkey") % 9).cast("int")), F.lit("\t "))).alias("name"))


@C.add("SELECT conv_id, turn, role, coalesce(CASE WHEN turn % 2 = 0 THEN text END, '') AS text, substr(role, 1, 1) || repeat('○', length(role) - 1) AS charger FROM conversations")
def slim_fields(spark, sf_dir):
    from ..operators.monitor import slim

    c = table(spark, sf_dir, "conversations").withColumns({"text": F.when(F.col("turn") % 2 == 0, F.col("text")), "charger": F.col("role"), "internal": F.lit("x")})
    return slim(c, ("conv_id", "turn", "role", "text", "charger"), mask="charger")


@C.add("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS pri FROM orders")
def scrub_fields(spark, sf_dir):
    from ..operators.monitor import scrub

    o = table(spark, sf_dir, "orders")
    nested = o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_clerk" if "o_clerk" in o.columns else "o_orderkey").alias("_note")).alias("a"), F.array(F.struct(F.col("o_orderpriority").alias("pri"), F.lit("x").alias("memo"))).alias("b"), F.lit("s").alias("_secret"))
    clean = scrub(nested, lambda name: name.startswith("_") or name == "memo")
    assert [f.name for f in clean.schema["a"].dataType.fields] == ["status"] and "_secret" not in clean.columns
    return clean.select("o_orderkey", "a.status", F.col("b")[0]["pri"].alias("pri"))


@C.add(r"SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '(?:…|\.\.\.|\s)*더\s*보기\s*$', ''), ' ') AS text FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN '…  더 보기 ' ELSE '' END AS text FROM documents)")
def post_text_norm(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.post_text(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "…  더 보기 ").otherwise(""))).alias("text"))


POST_SQL = """posts AS (SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'facebook' ELSE event_type END AS platform, 'User' || (user_id % 20) AS account, event_type || ' ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS text, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'http://p/' || (event_id % 97) END AS url,
 strftime(ts, '%Y-%m-%d') AS date, CAST(json_extract(props, '$.k') AS BIGINT) % 3 <> 0 AS exact, ts FROM events)"""


def posts(spark, sf_dir):
    """Events as captured posts."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "facebook").otherwise(F.col("event_type")).alias("platform"), F.concat(F.lit("User"), (F.col("user_id") % 20).cast("string")).alias("account"), F.lit("").alias("author"), F.lit("").alias("role"),
        F.concat("event_type", F.lit(" "), k).alias("text"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("http://p/"), (F.col("event_id") % 97).cast("string"))).alias("url"),
        F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd").alias("date"), (k.cast("long") % 3 != 0).alias("exact"), "ts",
    )


KEY_SQL = "CASE WHEN platform <> 'facebook' AND url <> '' THEN platform || ':' || url ELSE 'fb:' || lower(account) || ':' || substr(sha1(text), 1, 16) END"


@C.add(f"WITH {POST_SQL} SELECT seq, {KEY_SQL} AS key FROM posts")
def post_key(spark, sf_dir):
    return posts(spark, sf_dir).select("seq", T.post_key(*[F.col(c) for c in ("platform", "url", "account", "author", "text")]).alias("key"))


WHEN_SQL = """w AS (SELECT o_orderkey, year(o_orderdate) + 8 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 24 AS h, o_orderkey % 6 AS kind FROM orders)"""


def _stamps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y, m, d = (F.year("o_orderdate") + 8).cast("string"), F.month("o_orderdate").cast("string"), F.dayofmonth("o_orderdate").cast("string")
    h, kind = (F.col("o_orderkey") % 24), F.col("o_orderkey") % 6
    half = F.when(h < 12, "오전 ").otherwise("오후 ")
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string")
    raw = F.when(kind == 0, F.concat(y, F.lit("년 "), m, F.lit("월 "), d, F.lit("일 수요일 "), half, h12, F.lit(":05"))).when(kind == 1, F.concat(m, F.lit("월 "), d, F.lit("일"))).when(kind == 2, F.concat(y, F.lit("."), m, F.lit("."), d)).when(kind == 3, F.concat(h.cast("string"), F.lit("시간"))).when(kind == 4, "어제").otherwise("13월 45일")
    return o.select("o_orderkey", raw.alias("raw"), F.lit("2024-06-15 10:00:00").cast("timestamp_ntz").alias("now"))


ABS_DATE = """CASE kind WHEN 0 THEN strftime(make_date(y, m, d), '%Y-%m-%d') WHEN 1 THEN strftime(try_cast((CASE WHEN m < 6 OR (m = 6 AND d <= 15) THEN 2024 ELSE 2023 END || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0')) AS DATE), '%Y-%m-%d') WHEN 2 THEN strftime(make_date(y, m, d), '%Y-%m-%d') END"""
ABS_ISO = """CASE WHEN kind = 0 THEN strftime(make_date(y, m, d), '%Y-%m-%d') || 'T' || lpad(h::VARCHAR, 2, '0') || ':05+09:00' ELSE dt END"""


@C.add(f"WITH {WHEN_SQL}, a AS (SELECT *, {ABS_DATE} AS dt FROM w) SELECT o_orderkey, dt AS date, {ABS_ISO} AS iso FROM a")
def when_parse_abs(spark, sf_dir):
    s = _stamps(spark, sf_dir).withColumn("w", T.parse_absolute(F.col("raw"), F.col("now")))
    return s.select("o_orderkey", "w.date", "w.iso")


DAYS_AGO = "strftime(TIMESTAMP '2024-06-15 10:00:00' - to_days({}::INT), '%Y-%m-%d')"
REL_DATE = "CASE kind WHEN 3 THEN strftime(TIMESTAMP '2024-06-15 10:00:00' - to_hours(h::INT), '%Y-%m-%d') WHEN 4 THEN '2024-06-14' {more} END"


@C.add(f"WITH {WHEN_SQL} SELECT o_orderkey, {REL_DATE.format(more=f"WHEN 5 THEN {DAYS_AGO.format('45')} WHEN 2 THEN NULL ELSE {DAYS_AGO.format('d')}")} AS date FROM w")
def when_parse_rel(spark, sf_dir):
    """Relative readings of all stamps; a day of the month reads as a number of days."""
    s = _stamps(spark, sf_dir)
    return s.select("o_orderkey", T.parse_relative(F.col("raw"), F.col("now"))["date"].alias("date"))


@C.add(f"WITH {WHEN_SQL}, a AS (SELECT *, {ABS_DATE} AS dt FROM w) SELECT o_orderkey, coalesce(dt, {REL_DATE.format(more=f"WHEN 5 THEN {DAYS_AGO.format('45')}")}, '') AS date, dt IS NOT NULL AS exact FROM a")
def when_parse(spark, sf_dir):
    """Half of the stamps come as the tip of a post, half as its text."""
    tip = F.col("o_orderkey") % 6 < 3
    w = T.parse_when(F.when(tip, "").otherwise(F.col("raw")), F.when(tip, F.col("raw")), F.col("now"))
    return _stamps(spark, sf_dir).withColumn("w", w).select("o_orderkey", "w.date", "w.exact")


@C.add("SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') WHEN 3 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') WHEN 4 THEN strftime(ts + INTERVAL 750 MINUTE, '%Y-%m-%d') ELSE substr(event_type || ' at no time', 1, 10) END AS date FROM events")
def kst_date(spark, sf_dir):
    i, stamp = F.col("event_id") % 6, F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(i == 0, F.concat(stamp, F.lit("Z"))).when(i == 1, stamp).when(i == 2, F.concat(stamp, F.lit("+02:00"))).when(i == 3, F.concat(stamp, F.lit("+0000"))).when(i == 4, F.concat(stamp, F.lit("-0330"))).otherwise(F.concat("event_type", F.lit(" at no time")))
    return table(spark, sf_dir, "events").select("event_id", T.kst_date(iso).alias("date"))


@C.add("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN strftime(ts + INTERVAL 14 HOUR, '%Y-%m-%d') ELSE strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') END AS date, CASE event_id % 5 WHEN 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 5 WHEN 1 THEN '+00:00' WHEN 2 THEN 'Z' WHEN 3 THEN '+09:00' ELSE '-05:00' END END AS iso, event_id % 5 <> 0 AS exact FROM events")
def feed_when(spark, sf_dir):
    i, ts = F.col("event_id") % 5, F.col("ts").cast("timestamp_ntz")
    day = F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss")
    stamp = F.when(i == 0, "").when(i == 1, F.concat(day, F.lit(" GMT"))).when(i == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(i == 3, F.concat(day, F.lit(" +0900"))).otherwise(F.concat(day, F.lit(" -0500")))
    return table(spark, sf_dir, "events").withColumn("w", T.feed_when(stamp)).select("event_id", "w.date", "w.iso", "w.exact")


@C.add(r"SELECT conv_id, turn, regexp_replace(text, '\s+', '', 'g') AS flat FROM conversations")
def ledger_flat(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.flat(F.col("text")).alias("flat"))


@C.add("""WITH o AS (SELECT *, (o_orderkey + 100)::VARCHAR AS n, strftime(o_orderdate, '%Y.%m.%d') AS day, o_orderkey % 5 AS i FROM orders)
SELECT o_orderkey, CASE i WHEN 0 THEN 'nonumber' WHEN 1 THEN '환경과' WHEN 2 THEN '도로과' WHEN 3 THEN '' ELSE '총무과' END AS name, CASE i WHEN 1 THEN '환경과-' || n WHEN 2 THEN '도로과-' || n || ' ; plan-456' WHEN 3 THEN 'roads-' || n ELSE '' END AS numbers, CASE i WHEN 1 THEN day WHEN 2 THEN day || ' ; 2024.01.05' WHEN 3 THEN day ELSE '' END AS dates FROM o""")
def doc_number_split(spark, sf_dir):
    i, d, n = F.col("o_orderkey") % 5, F.col("o_orderdate"), (F.col("o_orderkey") + 100).cast("string")
    day = F.concat(F.year(d).cast("string"), F.lit("."), F.month(d).cast("string"), F.lit(". "), F.dayofmonth(d).cast("string"), F.lit("."))
    cell = F.when(i == 0, "no number").when(i == 1, F.concat(F.lit("환경과-"), n, F.lit("("), day, F.lit(")"))).when(i == 2, F.concat(F.lit("도로 과\n- "), n, F.lit(" （"), day, F.lit("）, plan-456 2024.1.5, plan-7(2024.1.5)")))
    cell = cell.when(i == 3, F.concat(F.lit("-"), n, F.lit("(2023.1.1) roads-"), n, F.lit(" "), day)).otherwise("(2차 협의) 총무과")
    return table(spark, sf_dir, "orders").withColumn("n", T.doc_numbers(cell)).select("o_orderkey", "n.name", "n.numbers", "n.dates")


@C.add("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '｢도로법｣' ELSE '하천법' END AS law FROM customer")
def first_law(spark, sf_dir):
    i = F.col("c_custkey") % 3
    opinion = F.when(i == 1, "see 「note」 and 「도로법」 then 「건축법」").otherwise("none 「note」")
    return table(spark, sf_dir, "customer").select("c_custkey", T.first_law(opinion, F.when(i == 2, "하천법").otherwise(" - ")).alias("law"))


@C.add("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE (c_custkey % 90 + 1) || ',7' END AS numbers FROM customer")
def attach_numbers(spark, sf_dir):
    status = F.when(F.col("c_custkey") % 2 == 0, "반영").otherwise(F.concat(F.lit("반영 (붙임 "), (F.col("c_custkey") % 90 + 1).cast("string"), F.lit(", 붙임7 참조)")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.attachment_numbers(status).alias("numbers"))


@C.add("SELECT l_orderkey, l_linenumber, concat_ws(' / ', CASE WHEN l_linenumber >= 2 THEN l_linenumber || '차협의(본협의표 통합)' END, CASE WHEN l_returnflag = 'R' THEN '근거첨부:붙임3' END, CASE WHEN l_linestatus = 'F' THEN '무응답/미회신' END) AS note FROM lineitem")
def note_build(spark, sf_dir):
    from ..operators.ledger import note

    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", note(F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", "3").otherwise(""), F.lit(""), F.when(F.col("l_linestatus") == "F", "미회신").otherwise("반영")).alias("note"))


@C.add()
def unwrap_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.unwrap_lines(F.col("text")), "\n").alias("text"))


@C.add(r"SELECT conv_id, turn, lower(regexp_replace(nfc_normalize(text), '\s+', '', 'g')) AS norm FROM conversations")
def nfc_lower_norm(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(T.flat(H.nfc("text"))).alias("norm"))


@C.add("SELECT item_id, count(DISTINCT substr(t, i, 3)) AS n, min(substr(t, i, 3)) AS low, max(substr(t, i, 3)) AS high FROM (SELECT item_id, t, unnest(generate_series(1, greatest(length(t) - 2, 1))) AS i FROM (SELECT item_id, text AS t FROM benchmark)) GROUP BY item_id")
def char_ngrams(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("g", T.char_ngrams(F.col("text")))
    return b.select("item_id", F.size("g").cast("long").alias("n"), F.array_min("g").alias("low"), F.array_max("g").alias("high"))


@C.add(r"SELECT conv_id, turn, role || '|' || substr(regexp_replace(text, '\s+', '', 'g'), 1, 20) AS fp FROM conversations")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.row_fingerprint(F.col("role"), F.col("text")).alias("fp"))
