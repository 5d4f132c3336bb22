"""News, portal records and posts: classification, de-duplication, archives, facets and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.text import any_word, compact_date, detail_url, mask_name, post_key, post_text, rule_hits, title_key

DEFAULT_TOPIC = "기타 동향"
#: Fixed code names of the portal.
INSTITUTION_KINDS = {"C": "중앙행정기관", "W": "광역자치단체", "B": "기초자치단체", "E": "교육청", "P": "공공기관"}
DISCLOSURE = {"1": "공개", "2": "부분공개", "3": "비공개"}


def named(code: Column, names: dict[str, str]) -> Column:
    out = F
    for k, v in names.items():
        out = out.when(code == k, v)
    return out.otherwise("")


# -- news -------------------------------------------------------------------------------------------------------------
def fix_source(source: Column, url: Column, names: dict[str, str], by_url, default: str = "기타") -> Column:
    """Corrected outlet: the exact map, then, without a source, the first url part that fits, then the default."""
    out = F
    for k, v in names.items():
        out = out.when(source == k, v)
    out = out.when(source != "", source)
    for part, v in by_url:
        out = out.when(url.contains(part), v)
    return out.otherwise(default)


def news_tag(items: DataFrame, org_any, org_queries, place, with_any) -> DataFrame:
    """Relevant items with ``tag`` both, org or site, judged on title and description without spaces; spaces in the rules' words do not count."""
    org_any, place, with_any = ([w.replace(" ", "") for w in words] for words in (org_any, place, with_any))
    text = F.regexp_replace(F.concat_ws("", "title", "desc"), r"\s+", "")
    org = any_word(text, org_any) | F.col("query").isin(*org_queries)
    site = any_word(text, place) & any_word(text, with_any)
    tag = F.when(org & site, "both").when(org, "org").when(site, "site")
    return items.withColumn("tag", tag).where("tag is not null")


def news_dedup(items: DataFrame) -> DataFrame:
    """First relevant item of each title key in the order of ``seq``. One aggregation: partial results meet per key, so a
    key that holds most rows (such as the empty one) costs no more than any other."""
    cols = items.columns
    first = items.withColumn("key", title_key(F.col("title"))).groupBy("key").agg(F.min_by(F.struct(*cols), "seq").alias("r"))
    return first.select("r.*", "key")


def topic(text: Column, tag: Column, topics: dict) -> Column:
    """First topic with a word in the text, from the site's list for site and both, else from the organisation's."""

    def first(rules):
        out = F
        for name, words in rules:
            out = out.when(any_word(text, words), name)
        return out.otherwise(DEFAULT_TOPIC)

    return F.when(tag.isin("site", "both"), first(topics["site"])).otherwise(first(topics["org"]))


def with_topic(items: DataFrame, topics: dict) -> DataFrame:
    return items.withColumn("topic", topic(F.concat_ws(" ", "title", "desc"), F.col("tag"), topics))


def publish(items: DataFrame, tag: str = "tag", topic: str = "topic") -> DataFrame:
    return items.select(F.col("title").alias("t"), F.col("link").alias("u"), F.col("date").alias("d"), F.col("source").alias("s"), F.col(tag).alias("g"), F.col(topic).alias("c"), F.col("summary").alias("y"))


def fresh(items: DataFrame, archive: DataFrame) -> DataFrame:
    """Items whose title key the archive lacks."""
    return items.join(archive.select("key").distinct(), "key", "left_anti")


def archive_upsert(archive: DataFrame, batch: DataFrame) -> DataFrame:
    """Last record of each key, at the position of its first. Both have ``key`` and a ``seq`` that grows."""
    both = archive.unionByName(batch)
    return both.groupBy("key").agg(F.max_by(F.struct(*both.columns), "seq").alias("r"), F.min("seq").alias("position")).select("r.*", "position")


def news_summary(items: DataFrame) -> DataFrame:
    """Counts by tag and topic in one pass, with first and last date; site totals count both."""
    return items.groupBy("tag", "topic").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("desc") != "").alias("with_text"))


def news_facets(items: DataFrame, today: str) -> DataFrame:
    """(facet, value, n): topics, outlets, groups (items of both count in each) and periods up to ``today``, from one aggregation."""
    age = F.datediff(F.lit(today).cast("date"), F.col("date").try_cast("date"))
    periods = {"all": F.lit(True), "7": age <= 7, "30": age <= 30, "90": age <= 90, "year": F.substring("date", 1, 4) == today[:4]}
    flags = F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in periods.items()]))
    pairs = F.concat(F.array(F.struct(F.lit("topic").alias("facet"), F.col("topic").alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"))), F.transform(flags, lambda p: F.struct(F.lit("period").alias("facet"), p.alias("value"))))
    groups = F.array_compact(F.array(*[F.when(F.col("tag").isin(g, "both"), F.struct(F.lit("group").alias("facet"), F.lit(g).alias("value"))) for g in ("org", "site")]))
    pairs = F.concat(pairs, groups)
    return items.select(F.explode(pairs).alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def news_search(items: DataFrame, terms, group: str | None = None, topic: str | None = None, source: str | None = None, days: int | None = None, today: str | None = None) -> DataFrame:
    """AND of lower-case terms over title, description, source and topic; a group also matches both."""
    text = F.lower(F.concat_ws(" ", "title", "desc", "source", "topic"))
    out = items.where(rule_hits(text, [[t.lower() for t in terms]]))
    if group:
        out = out.where(F.col("tag").isin(group, "both"))
    if topic:
        out = out.where(F.col("topic") == topic)
    if source:
        out = out.where(F.col("source") == source)
    if days is not None:
        out = out.where(F.datediff(F.lit(today).cast("date"), F.col("date").try_cast("date")) <= days)
    return out


def news_order(order: str = "new") -> list[Column]:
    by = {"new": [F.desc("date")], "old": [F.asc("date")], "outlet": [F.collate("source", "ko").asc(), F.desc("date")]}[order]
    return [*by, F.asc("seq")]


def news_sort(items: DataFrame, order: str = "new") -> DataFrame:
    return items.orderBy(*news_order(order))


# -- portal records ---------------------------------------------------------------------------------------------------
def normalize_record(raw: DataFrame, keyword: Column, base_url: str) -> DataFrame:
    """Raw portal fields as the library's record, with any further columns kept."""
    c = F.col
    own = ("PRDCTN_INSTT_REGIST_NO", "INFO_SJ", "PROC_INSTT_NM", "INSTT_SE_CD", "NFLST_CHRG_DEPT_NM", "CHRG_DEPT_NM", "DOC_NO", "CHARGER_NM", "UNIT_JOB_NM", "PRDCTN_DT", "OTHBC_SE_CD", "FILE_NM", "ORGNAL_YN")
    text = lambda name: F.coalesce(c(name), F.lit(""))
    rest = [c(n) for n in raw.columns if n not in own]
    return raw.select(
        text("PRDCTN_INSTT_REGIST_NO").alias("id"), F.trim(text("INFO_SJ")).alias("title"), F.trim(text("PROC_INSTT_NM")).alias("instt"), text("INSTT_SE_CD").alias("instt_se"), named(c("INSTT_SE_CD"), INSTITUTION_KINDS).alias("instt_se_nm"),
        F.trim(F.coalesce(F.nullif(c("NFLST_CHRG_DEPT_NM"), F.lit("")), text("CHRG_DEPT_NM"))).alias("dept"), text("DOC_NO").alias("doc_no"), text("CHARGER_NM").alias("charger"), text("UNIT_JOB_NM").alias("unit_job"), compact_date(text("PRDCTN_DT")).alias("date"), text("PRDCTN_DT").alias("datetime"),
        named(c("OTHBC_SE_CD"), DISCLOSURE).alias("othbc"), text("FILE_NM").alias("file_nm"), (text("ORGNAL_YN") == "Y").alias("has_orginl"), detail_url(base_url, c("PRDCTN_INSTT_REGIST_NO"), c("PRDCTN_DT"), c("INSTT_SE_CD")).alias("url"), F.array(keyword).alias("kwds"), *rest,
    )


def portal_grade(text: Column, rules: dict) -> Column:
    """land, core or related; excluded rows are null. ``rules``: hard_exclude, exclude, land, core (OR of ANDs) and guard words."""
    out = rule_hits(text, rules["hard_exclude"]) | (rule_hits(text, rules["exclude"]) & ~any_word(text, rules["guard"]))
    return F.when(out, F.lit(None).cast("string")).when(rule_hits(text, rules["land"]), "land").when(rule_hits(text, rules["core"]), "core").otherwise("related")


def portal_merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert by id: the first record's fields stay, keywords are united and sorted; ``added`` marks new ids."""
    cols = [c for c in stored.columns if c not in ("id", "kwds", "seq")]
    rows = stored.withColumn("old", F.lit(True)).unionByName(batch.withColumn("old", F.lit(False)))
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_set("kwds"))))
    merged = rows.groupBy("id").agg(F.min_by(F.struct(*cols, "seq"), F.struct(~F.col("old"), "seq")).alias("r"), words.alias("kwds"), (~F.bool_or("old")).alias("added"))
    return merged.select("id", "r.*", "kwds", "added")


def allword_search(records: DataFrame, keywords: DataFrame, start: str, end: str) -> DataFrame:
    """(record, keyword) where all words of the keyword stand in the title and the date lies in the range, both ends in.

    The keyword table is a configuration: it is broadcast whole, whatever the number of records."""
    found = records.where(F.col("date").between(start, end)).join(F.broadcast(keywords), F.forall(F.split("kwd", " "), lambda w: F.col("title").contains(w)))
    return found


def counts_by_kind(rows: DataFrame) -> DataFrame:
    g = F.col("grade")
    return rows.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(g == "core").alias("core"), F.count_if(g == "land").alias("land"), F.count_if(g == "related").alias("other"), F.count_if(g.isNull()).alias("excluded"))


def facets_excluding_self(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(facet, value, n) of each facet under all filters but its own.

    The filters become flags once; a row feeds a facet when no other filter rejects it, so one scan and one
    aggregation serve all facets."""
    flags = {f: F.coalesce(ok, F.lit(False)) for f, ok in filters.items()}
    others = lambda f: [ok for g, ok in flags.items() if g != f]
    cells = []
    for f in filters:
        test = F.lit(True)
        for ok in others(f):
            test = test & ok
        value = F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("(미상)"))
        cells.append(F.when(test, F.struct(F.lit(f).alias("facet"), value.alias("value"))))
    return rows.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def trend_24_months(rows: DataFrame, last_month: str, date: str = "date") -> DataFrame:
    """Counts of the 24 months up to ``last_month`` (yyyy-MM), zero-filled, with the peak (1 at least)."""
    spark = rows.sparkSession
    months = spark.range(1).select(F.explode(F.sequence(F.add_months(F.to_date(F.lit(last_month + "-01")), -23), F.to_date(F.lit(last_month + "-01")), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    counted = rows.groupBy(F.substring(date, 1, 7).alias("month")).agg(F.count("*").alias("n"))
    filled = months.join(counted, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.crossJoin(F.broadcast(filled.agg(F.greatest(F.max("n"), F.lit(1)).alias("peak"))))  # 24 rows and one


def downloadable(records: DataFrame) -> DataFrame:
    """First eligible record of each id, originals before lists: disclosed, with a file name or an original."""
    ok = records.where((F.col("othbc") == "공개") & ((F.col("file_nm") != "") | F.col("has_orginl")))
    cols = ok.columns
    first = ok.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct(F.when(F.col("kind") == "orginl", 0).otherwise(1).alias("k"), "seq")).alias("r")).select("r.*")
    return first.withColumn("n_files", F.size(F.filter(F.split("file_nm", r"\|"), lambda x: x != "")))


def portal_order(order: str = "new") -> list[Column]:
    by = {"new": [F.desc("date")], "old": [F.asc("date")], "instt": [F.collate("instt", "ko").asc(), F.desc("date")], "title": [F.collate("title", "ko").asc()]}[order]
    return [*by, F.asc("seq")]


def portal_sort(rows: DataFrame, order: str = "new") -> DataFrame:
    return rows.orderBy(*portal_order(order))


def slim(rows: DataFrame, fields, mask: str | None = None) -> DataFrame:
    """The named fields, absent strings empty, one masked."""
    kind = dict(rows.dtypes)
    one = lambda f: mask_name(F.col(f)) if f == mask else F.coalesce(F.col(f), F.lit("")) if kind[f] == "string" else F.col(f)
    return rows.select(*[one(f).alias(f) for f in fields])


def scrub(rows: DataFrame, private) -> DataFrame:
    """``rows`` without the fields that ``private(name)`` names, at any depth of structs and arrays."""

    def clean(col: Column, kind):
        if isinstance(kind, StructType):
            return F.when(col.isNotNull(), F.struct(*[clean(col[f.name], f.dataType).alias(f.name) for f in kind.fields if not private(f.name)]))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
            return F.transform(col, lambda x: clean(x, kind.elementType))
        return col

    return rows.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields if not private(f.name)])


# -- posts --------------------------------------------------------------------------------------------------------------
def classify_post(text: Column, groups, priority) -> dict[str, Column]:
    """``groups`` hit in their order, the distinct words found, and whether a priority group was hit."""
    hit = F.array_compact(F.array(*[F.when(any_word(text, words), F.lit(name)) for name, words in groups]))
    words = [w for _, ws in groups for w in ws]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words]))))
    return {"groups": hit, "words": found, "priority": F.arrays_overlap(hit, F.array(*[F.lit(p) for p in priority]))}


def resolve_keys(posts: DataFrame) -> DataFrame:
    """``posts`` with their final ``key``: rows with an exact date other than that of the key's first exact row get ``key@date``.

    The anchor date comes from an aggregation and a join on the key, so a key with very many posts needs no single task."""
    dated = F.col("exact") & (F.coalesce("date", F.lit("")) != "")
    keyed = posts.withColumn("base_key", post_key(*[F.col(c) for c in ("platform", "url", "account", "author", "text")]))
    anchors = keyed.where(dated).groupBy("base_key").agg(F.min_by("date", "seq").alias("anchor"))
    joined = keyed.join(anchors, "base_key", "left")
    other = dated & (F.col("date") != F.col("anchor"))
    return joined.withColumn("key", F.when(other, F.concat_ws("@", "base_key", "date")).otherwise(F.col("base_key"))).drop("anchor", "base_key")


def merge_posts(posts: DataFrame) -> DataFrame:
    """One row a key, as folding the rows in the order of ``seq`` gives: last non-empty fields, longest text (earliest on a tie),
    first non-empty address, the date of the first exact row, else of the first dated one."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    last = lambda c: F.coalesce(F.max_by(c, F.when(filled(c), F.col("seq"))), F.lit("")).alias(c)
    text = post_text(F.col("text"))
    dated = F.coalesce("date", F.lit("")) != ""
    exact = F.col("exact") & dated
    when = F.struct("date", "exact")
    date = F.coalesce(F.min_by(when, F.when(exact, F.col("seq"))), F.min_by(when, F.when(dated, F.col("seq"))), F.struct(F.lit("").alias("date"), F.lit(False).alias("exact")))
    got = posts.groupBy("key").agg(*[last(c) for c in ("platform", "account", "author", "role")], F.max_by(text, F.struct(F.length(text), -F.col("seq"))).alias("text"), F.coalesce(F.min_by("url", F.when(filled("url"), F.col("seq"))), F.lit("")).alias("url"), date.alias("w"), F.min("seq").alias("seq"), F.count("*").alias("n"))
    return got.select("key", "platform", "account", "author", "role", "text", "url", F.col("w.date").alias("date"), F.col("w.exact").alias("exact"), "seq", "n")


def feed_cap(entries: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` entries of each account in feed order, then those with a text."""
    rank = F.row_number().over(Window.partitionBy("account").orderBy("seq"))
    return entries.withColumn("rank", rank).where(F.col("rank") <= n).where(F.coalesce("text", F.lit("")) != "").drop("rank")


def post_order(screen: bool = False) -> list[Column]:
    """Order of stored posts: date, then time, newest first. On the screen posts of a priority group, then posts with any
    group, come first, and the stored order decides among posts of a date."""
    stored = [F.desc("date"), F.desc("ts"), F.asc("seq")]
    return [F.desc("priority"), F.desc(F.size("groups") > 0), *stored] if screen else stored


def post_sort(posts: DataFrame) -> DataFrame:
    return posts.orderBy(*post_order())


def hub_status(sites: DataFrame, feeds: DataFrame, now: Column) -> DataFrame:
    """Sites with their last update, picked metric (by label, else the first) and whether they are stale or missing."""
    j = sites.join(feeds, "key", "left")
    picked = F.coalesce(F.try_element_at(F.filter("metrics", lambda m: m["label"] == F.col("pick")), F.lit(1)), F.try_element_at("metrics", F.lit(1)))
    stale = F.col("updated").isNull() | (F.unix_seconds(now) - F.unix_seconds(F.col("updated")) > 3600 * F.col("stale_hours"))
    return j.select("key", F.col("updated"), picked["value"].alias("value"), stale.alias("stale"))
