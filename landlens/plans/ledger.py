"""Queries of the ledger operators: line items as records, suppliers as departments, nations as organisations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assembly as A
from ..operators import ledger as L
from .base import Catalog, table

C = Catalog()
QUERIES, ORACLE = C.QUERIES, C.ORACLE

ROWS_SQL = """recs AS (SELECT r_name AS grp, n_name AS org, s_name AS dept, s_suppkey, l_orderkey * 10 + l_linenumber AS seq, l_orderkey * 10 + l_linenumber AS no,
 CASE WHEN l_returnflag = 'R' THEN '미반영' WHEN l_returnflag = 'A' THEN '반영' WHEN l_linestatus = 'F' THEN '미회신' WHEN l_linenumber = 3 THEN '미기재' WHEN l_linenumber % 2 = 0 THEN '부분반영' ELSE '의견없음' END AS status,
 CASE l_linenumber % 3 WHEN 0 THEN 'roads' WHEN 1 THEN 'water' ELSE 'parks' END AS issue, CASE WHEN l_linenumber = 7 THEN 'Y' ELSE '' END AS again, CASE WHEN l_linenumber = 7 THEN '재협의' ELSE '본협의' END AS kind,
 CASE WHEN l_linenumber % 5 = 0 THEN '-' ELSE '' END AS status_raw, 'opinion on part ' || l_partkey AS opinion, 'action ' || l_suppkey AS action
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_S = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS \"{s}\"" for s in L.ALL_STATUSES)
SUMMARY_SQL = f"""{ROWS_SQL}, base AS (SELECT grp, org, dept, s_suppkey, {_S} FROM recs WHERE kind = '본협의' GROUP BY ALL),
 summ AS (SELECT grp, org, dept, "반영" + CASE s_suppkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS "반영", "부분반영", "미반영" - CASE s_suppkey % 4 WHEN 1 THEN 1 ELSE 0 END AS "미반영", "의견없음" + "미기재" AS "의견없음", "미회신" FROM base WHERE s_suppkey % 9 <> 5)"""


def rows(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n, seq = F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    status = F.when(F.col("l_returnflag") == "R", "미반영").when(F.col("l_returnflag") == "A", "반영").when(F.col("l_linestatus") == "F", "미회신").when(n == 3, "미기재").when(n % 2 == 0, "부분반영").otherwise("의견없음")
    return j.select(
        F.col("r_name").alias("grp"), F.col("n_name").alias("org"), F.col("s_name").alias("dept"), "s_suppkey", seq.alias("seq"), seq.alias("no"), status.alias("status"), F.when(n % 3 == 0, "roads").when(n % 3 == 1, "water").otherwise("parks").alias("issue"),
        F.when(n == 7, "Y").otherwise("").alias("again"), F.when(n == 7, "재협의").otherwise("본협의").alias("kind"), F.when(n % 5 == 0, "-").otherwise("").alias("status_raw"), F.concat(F.lit("opinion on part "), F.col("l_partkey").cast("string")).alias("opinion"), F.concat(F.lit("action "), F.col("l_suppkey").cast("string")).alias("action"),
    )


ONCE_SQL = f"{ROWS_SQL}, once AS (SELECT no, dept, opinion, action, status FROM recs QUALIFY row_number() OVER (PARTITION BY no ORDER BY dept, opinion, action, status) = 1)"


def rows_once(spark, sf_dir):
    """One record a number, for what is keyed by it."""
    return rows(spark, sf_dir).groupBy("no").agg(F.min(F.struct("dept", "opinion", "action", "status")).alias("r")).select("no", "r.*")


def summary(spark, sf_dir):
    """The records' own counts with planted deviations, and some departments left out."""
    k = F.col("s_suppkey") % 4
    base = rows(spark, sf_dir).where("kind = '본협의'").groupBy("grp", "org", "dept", "s_suppkey").agg(*L.status_counts()).where("s_suppkey % 9 <> 5")
    return base.select("grp", "org", "dept", (F.col("반영") + F.when(k == 0, -1).when(k == 1, 1).otherwise(0)).alias("반영"), "부분반영", (F.col("미반영") - F.when(k == 1, 1).otherwise(0)).alias("미반영"), (F.col("의견없음") + F.col("미기재")).alias("의견없음"), "미회신")


CELL_SQL = "c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '부분 반영' WHEN 2 THEN '미반영' WHEN 3 THEN '-' WHEN 4 THEN '' WHEN 5 THEN '-' WHEN 6 THEN '반영' ELSE '' END AS st, CASE l_linenumber WHEN 4 THEN ' ○' WHEN 5 THEN '별도로 회신 예정' WHEN 7 THEN '저촉 없음' ELSE '의견 있음' END AS op, CASE l_linenumber WHEN 3 THEN CASE WHEN l_orderkey % 2 = 0 THEN '해당 없음' ELSE '검토' END ELSE '' END AS ac FROM lineitem)"


def _cells(spark, sf_dir):
    n = F.col("l_linenumber")
    pick = lambda m, other: F.coalesce(*[F.when(n == k, v) for k, v in m.items()], F.lit(other))
    st = pick({1: F.lit("부분 반영"), 2: F.lit("미반영"), 3: F.lit("-"), 5: F.lit("-"), 6: F.lit("반영")}, "")
    op = pick({4: F.lit(" ○"), 5: F.lit("별도로 회신 예정"), 7: F.lit("저촉 없음")}, "의견 있음")
    ac = F.when(n == 3, F.when(F.col("l_orderkey") % 2 == 0, "해당 없음").otherwise("검토")).otherwise("")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", st.alias("st"), op.alias("op"), ac.alias("ac"))


@C.add(f"WITH {CELL_SQL} SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '부분반영' WHEN 2 THEN '미반영' WHEN 3 THEN CASE WHEN l_orderkey % 2 = 0 THEN '의견없음' ELSE '미기재' END WHEN 4 THEN '미회신' WHEN 5 THEN '미회신' WHEN 6 THEN '반영' ELSE '의견없음' END AS status FROM c")
def ledger_status(spark, sf_dir):
    return _cells(spark, sf_dir).select("l_orderkey", "l_linenumber", T.ledger_status(F.col("st"), F.col("op"), F.col("ac")).alias("status"))


ISSUES = (("water", ("sewer", "brass")), ("metal", ("steel", "copper", "nickel", "tin")), ("paint", ("polished", "plated", "ECONOMY")))


@C.add("""SELECT p_partkey, CASE WHEN contains(t, 'sewer') OR contains(t, 'brass') THEN 'water' WHEN contains(t, 'steel') OR contains(t, 'copper') OR contains(t, 'nickel') OR contains(t, 'tin') THEN 'metal' WHEN contains(t, 'polished') OR contains(t, 'plated') OR contains(t, 'economy') THEN 'paint' ELSE '기타' END AS issue
FROM (SELECT p_partkey, replace(lower(p_name || chr(10) || p_type), 'brass', 'alloy') AS t FROM (SELECT p_partkey, replace(p_name, chr(10), '') AS p_name, p_type FROM part))""")
def ledger_issue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.ledger_issue(F.concat_ws("\n", "p_name", "p_type"), {"brass": "alloy"}, ISSUES).alias("issue"))


@C.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 2 THEN l_linenumber END AS round, CASE WHEN l_linenumber >= 2 OR l_returnflag = 'R' THEN '재협의' ELSE '본협의' END AS kind, CASE WHEN l_linenumber >= 2 OR l_returnflag = 'R' OR l_linestatus = 'F' THEN 'Y' ELSE '' END AS again FROM lineitem")
def ledger_round(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cell = F.when(F.col("l_linenumber") >= 2, F.concat(F.lit("부서 ("), F.col("l_linenumber").cast("string"), F.lit("차 협의)"))).otherwise("부서")
    r = L.consultation_round(cell, F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "재 협의 중").otherwise(""))
    return li.withColumn("r", r).select("l_orderkey", "l_linenumber", "r.round", "r.kind", "r.again")


@C.add(f"WITH {ROWS_SQL} SELECT kind, count(*) AS n FROM recs GROUP BY kind")
def ledger_kind_filter(spark, sf_dir):
    return L.counted(rows(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@C.add(f"WITH {ROWS_SQL} SELECT no FROM recs WHERE status IN ('미반영', '미기재', '미회신') OR again = 'Y'")
def open_items(spark, sf_dir):
    return L.open_items(rows(spark, sf_dir)).select("no")


@C.add(f"WITH {ROWS_SQL} SELECT grp, count(*) AS n, count(*) FILTER (WHERE kind <> '총괄표 미집계') AS n_counted FROM recs WHERE status IN ('미반영', '부분반영', '미회신', '미기재') OR again = 'Y' GROUP BY grp")
def todo_filter(spark, sf_dir):
    return L.todo(rows(spark, sf_dir)).groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("kind") != L.UNCOUNTED).alias("n_counted"))


@C.add(f"WITH {ONCE_SQL} SELECT no, CASE WHEN contains(opinion || action, '77') OR contains(replace(action, ' ', ''), 'action13') THEN 'A' WHEN status = '미회신' AND ends_with(dept, '1') THEN 'B' ELSE '' END AS grade FROM once WHERE no % 1000 = 11 OR contains(opinion || action, '77') OR contains(replace(action, ' ', ''), 'action13') OR (status = '미회신' AND ends_with(dept, '1'))")
def keyword_extract(spark, sf_dir):
    r = rows_once(spark, sf_dir)
    pins = r.where("no % 1000 = 11").select("no")
    return L.keyword_extract(r, ("77", "action13"), "1$", pins).select("no", F.coalesce("grade", F.lit("")).alias("grade"))


_PHRASES = ("○ 해당 사항 없음.", "의견 있음, 해당없음", " · 이상없음", "- 검토의견 없음", "특이사항없음", "별도 의견 없음", "저촉없음", "미회신", "없음", "- 의견  없음")


@C.add("SELECT c_custkey, c_custkey % 10 IN (0, 2, 3, 5, 6, 7) AND c_custkey % 4 <> 1 AS trivial FROM customer")
def trivial_phrase(spark, sf_dir):
    k = F.col("c_custkey")
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (k % 10 + 1).cast("int"))
    text = F.when(k % 4 == 1, F.concat("c_mktsegment", phrase)).otherwise(F.concat(phrase, "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", L.trivial(text).alias("trivial"))


@C.add(f"WITH {ROWS_SQL} SELECT no FROM recs WHERE contains(lower(org || ' ' || dept || ' ' || opinion || ' ' || action || ' ' || issue), 'part 1') AND status = '반영' AND grp = 'ASIA'")
def ledger_search(spark, sf_dir):
    return L.ledger_search(rows(spark, sf_dir), "Part 1", ("org", "dept", "opinion", "action", "issue"), status="반영", grp="ASIA").select("no")


@C.add(f"""WITH {SUMMARY_SQL}, w AS (SELECT grp, regexp_replace(dept, '\\s+', '', 'g') AS dept, sum("반영" + "부분반영" + "미반영" + "의견없음" + "미회신")::BIGINT AS expected FROM summ GROUP BY ALL), g AS (SELECT grp, regexp_replace(dept, '\\s+', '', 'g') AS dept, count(*) AS found FROM recs WHERE kind = '본협의' GROUP BY ALL)
SELECT coalesce(w.grp, g.grp) AS grp, coalesce(w.dept, g.dept) AS dept, expected, found FROM w FULL JOIN g ON w.grp = g.grp AND w.dept = g.dept WHERE expected IS DISTINCT FROM found""")
def ledger_reconcile_counts(spark, sf_dir):
    s = summary(spark, sf_dir).withColumn("total", F.col("반영") + F.col("부분반영") + F.col("미반영") + F.col("의견없음"))
    return L.reconcile_counts(s, rows(spark, sf_dir).where("kind = '본협의'"))


_E = " + ".join(f'coalesce(w."{s}", 0)' for s in L.STATUSES)
_G = " + ".join(f'coalesce(g."{s}", 0)' for s in L.ALL_STATUSES)
_SAME = " AND ".join(f'coalesce(w."{s}", 0) = coalesce(g."{s}", 0)' for s in L.STATUSES)


@C.add(f"""WITH {SUMMARY_SQL}, g AS (SELECT org, dept, {_S} FROM recs WHERE kind = '본협의' GROUP BY ALL)
SELECT coalesce(w.org, g.org) AS org, coalesce(w.dept, g.dept) AS dept, {_E} AS expected, {_G} AS found, ({_G}) - ({_E}) AS difference, ({_E}) = ({_G}) AS count_match, {_SAME} AND coalesce(g."미기재", 0) = 0 AS status_match FROM summ w FULL JOIN g ON w.org = g.org AND w.dept = g.dept""")
def ledger_reconcile_status(spark, sf_dir):
    return L.reconcile_status(summary(spark, sf_dir), rows(spark, sf_dir).where("kind = '본협의'"))


_W = " + ".join(f'"{s}"' for s in L.STATUSES)


@C.add(f"""WITH {SUMMARY_SQL}, t AS (SELECT org, dept, sum({_W})::BIGINT AS expected FROM summ GROUP BY ALL), m AS (SELECT r.*, t.expected, count(*) OVER w - t.expected AS over_n, count(*) FILTER (WHERE status_raw = '-') OVER w AS dashes FROM recs r LEFT JOIN t USING (org, dept) WHERE kind = '본협의' WINDOW w AS (PARTITION BY org, dept)),
 k AS (SELECT *, dashes = 0 OR status_raw = '-' AS cand, row_number() OVER (PARTITION BY org, dept ORDER BY (dashes = 0 OR status_raw = '-')::INT DESC, seq DESC) AS r FROM m)
SELECT no, CASE WHEN coalesce(over_n > 0 AND cand AND r <= over_n, false) THEN '총괄표 미집계' ELSE kind END AS kind FROM k UNION ALL SELECT no, kind FROM recs WHERE kind <> '본협의'""")
def ledger_flag_uncounted(spark, sf_dir):
    return L.flag_uncounted(rows(spark, sf_dir), summary(spark, sf_dir)).select("no", "kind")


_LACK = "CASE " + " ".join(f"WHEN w.\"{s}\" > g.\"{s}\" THEN '{s}'" for s in L.STATUSES) + " ELSE '다른 상태' END"
_OVER = " OR ".join(f"(r.status = '{s}' AND g.\"{s}\" > w.\"{s}\")" for s in L.STATUSES)


@C.add(f"""WITH {SUMMARY_SQL}, main AS (SELECT * FROM recs WHERE kind = '본협의'), g AS (SELECT org, dept, count(*) AS n, {_S} FROM main GROUP BY ALL)
SELECT no, {_LACK} AS instead FROM main r JOIN summ w USING (org, dept) JOIN g USING (org, dept) WHERE g.n <= w."반영" + w."부분반영" + w."미반영" + w."의견없음" + w."미회신" AND ({_OVER})""")
def ledger_flag_status(spark, sf_dir):
    return L.flag_status(rows(spark, sf_dir).where("kind = '본협의'"), summary(spark, sf_dir)).select("no", "instead")


@C.add(f"WITH {ONCE_SQL} SELECT no, CASE WHEN no % 50 = 1 THEN 'checked' END AS note_add FROM once")
def annotate_guarded(spark, sf_dir):
    r = rows_once(spark, sf_dir)
    notes = r.where("no % 50 = 1").select("no", "dept", F.substring(T.flat(F.col("opinion")), 1, 20).alias("opinion20"), F.lit("checked").alias("note_add"))
    return L.annotate_guarded(r, notes).select("no", "note_add")


@C.add(f"WITH {ONCE_SQL} SELECT no, CASE WHEN no % 20 = 1 THEN '일치' END AS verdict, no % 20 = 2 AS skewed FROM once")
def evidence_attach(spark, sf_dir):
    r = rows_once(spark, sf_dir)
    fp = F.when(F.col("no") % 20 == 1, T.row_fingerprint(F.col("dept"), F.col("opinion"))).otherwise("other|x")
    return L.evidence_attach(r, r.where("no % 20 in (1, 2)").select("no", fp.alias("fp"), F.lit("일치").alias("verdict"))).select("no", "verdict", "skewed")


@C.add(f"""WITH {ROWS_SQL}, known AS (SELECT DISTINCT org, dept FROM recs), short AS (SELECT DISTINCT org, substr(dept, 1, length(dept) - 2) AS dept FROM recs), f AS (SELECT s.org, s.dept, count(*) AS n, min(k.dept) AS whole FROM short s JOIN known k ON s.org = k.org AND starts_with(k.dept, s.dept) GROUP BY ALL)
SELECT s.org, s.dept, CASE WHEN f.n = 1 THEN f.whole ELSE s.dept END AS alias FROM short s LEFT JOIN f USING (org, dept)""")
def dept_alias_prefix(spark, sf_dir):
    r = rows(spark, sf_dir)
    short = r.select("org", F.expr("substr(dept, 1, length(dept) - 2)").alias("dept")).distinct()
    return L.alias_prefix(short, r)


RATE = "round((\"반영\" + 0.5 * \"부분반영\") / nullif(n - \"미회신\" - \"의견없음\", 0), 6)"


@C.add(f"""WITH {ROWS_SQL}, b AS (SELECT grp, org, dept, count(*) AS n, {_S}, count(*) FILTER (WHERE again = 'Y') AS again FROM recs GROUP BY ALL), i AS (SELECT grp, org, dept, issue, count(*) AS k, min(seq) AS s FROM recs GROUP BY grp, org, dept, issue QUALIFY row_number() OVER (PARTITION BY grp, org, dept ORDER BY k DESC, s) = 1)
SELECT b.*, {RATE} AS rate, i.issue AS top_issue FROM b JOIN i USING (grp, org, dept)""")
def ledger_by_dept(spark, sf_dir):
    return L.by_dept(rows(spark, sf_dir))


@C.add(f"WITH {ROWS_SQL} SELECT grp, org, count(DISTINCT dept) AS depts, count(*) AS n, {_S}, count(*) FILTER (WHERE again = 'Y') AS again FROM recs GROUP BY ALL")
def ledger_by_org(spark, sf_dir):
    return L.by_org(rows(spark, sf_dir))


@C.add(f"WITH {ROWS_SQL} SELECT coalesce(grp, '합계') AS grp, coalesce(status, '합계') AS status, count(*) AS n FROM recs GROUP BY CUBE (grp, status) UNION ALL SELECT grp, '재협의', count(*) FROM recs WHERE again = 'Y' GROUP BY grp")
def ledger_crosstab(spark, sf_dir):
    return L.crosstab(rows(spark, sf_dir))


@C.add(f"""WITH {ROWS_SQL} SELECT count(*) FILTER (WHERE status NOT IN ('미회신', '의견없음')) AS reviewed, count(*) FILTER (WHERE status = '반영') AS adopted, round(100.0 * count(*) FILTER (WHERE status = '반영') / count(*) FILTER (WHERE status NOT IN ('미회신', '의견없음')), 1)::DOUBLE AS rate,
 count(DISTINCT CASE WHEN status = '미회신' THEN org || '|' || dept END) AS unanswered_depts, count(*) FILTER (WHERE again = 'Y') AS again, count(*) FILTER (WHERE status IN ('미반영', '미기재', '미회신') OR again = 'Y') AS open FROM recs""")
def ledger_kpi(spark, sf_dir):
    return L.kpi(rows(spark, sf_dir))


@C.add(f"WITH {ROWS_SQL} SELECT count(DISTINCT org) AS orgs, count(DISTINCT org || '|' || dept) AS depts, count(*) FILTER (WHERE status IN ('미반영', '미기재', '미회신') OR again = 'Y') AS open_set, count(*) FILTER (WHERE status IN ('미반영', '미기재', '미회신') AND again = 'Y') AS overlap FROM recs")
def ledger_stats(spark, sf_dir):
    unsettled = F.col("status").isin("미반영", "미기재", "미회신")
    return rows(spark, sf_dir).agg(F.countDistinct("org").alias("orgs"), F.countDistinct("org", "dept").alias("depts"), F.count_if(L.is_open()).alias("open_set"), F.count_if(unsettled & (F.col("again") == "Y")).alias("overlap"))


@C.add(f"WITH {ROWS_SQL}, n AS (SELECT issue, count(*) AS n FROM recs GROUP BY issue) SELECT issue, n, round(n / max(n) OVER (), 6) AS share FROM n")
def ledger_issue_counts(spark, sf_dir):
    return L.issue_counts(rows(spark, sf_dir))


@C.add(f"WITH {ROWS_SQL} SELECT CASE WHEN status = '미회신' THEN 'unanswered' WHEN again = 'Y' THEN 'again' ELSE 'reviewed' END AS part, count(*) AS n FROM recs GROUP BY 1")
def ledger_comp(spark, sf_dir):
    part = F.when(F.col("kind") == L.UNCOUNTED, "uncounted").when(F.col("status") == "미회신", "unanswered").when(F.col("again") == "Y", "again").otherwise("reviewed")
    return rows(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@C.add(f"WITH {ROWS_SQL} SELECT org, dept, min(seq) AS seq FROM recs WHERE status = '미회신' GROUP BY ALL")
def no_reply_depts(spark, sf_dir):
    return L.no_reply_depts(rows(spark, sf_dir))


@C.add(f"WITH {SUMMARY_SQL} SELECT " + ", ".join(f'sum("{s}")::BIGINT AS "{s}"' for s in L.STATUSES) + " FROM summ")
def summary_totals(spark, sf_dir):
    return summary(spark, sf_dir).agg(*[F.sum(s).alias(s) for s in L.STATUSES])


@C.add(f"WITH {SUMMARY_SQL}, w AS (" + " UNION ALL ".join(f"SELECT '{s}' AS status, sum(\"{s}\")::BIGINT AS expected FROM summ" for s in L.STATUSES) + "), g AS (SELECT status, count(*) AS found FROM recs WHERE kind = '본협의' GROUP BY status) SELECT status, expected, coalesce(found, 0) AS found, coalesce(found, 0) - expected AS difference FROM w LEFT JOIN g USING (status)")
def summary_compare(spark, sf_dir):
    return L.summary_compare(summary(spark, sf_dir), rows(spark, sf_dir).where("kind = '본협의'"))


@C.add(f"WITH {ROWS_SQL} SELECT grp, org, min(seq) AS seq FROM recs GROUP BY ALL")
def org_options(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("grp", "org").agg(F.min("seq").alias("seq")).orderBy("grp", "seq")


@C.add(f"WITH {ROWS_SQL} SELECT no, org, dept, row_number() OVER (PARTITION BY dept ORDER BY seq) AS place FROM recs")
def row_number_ledger(spark, sf_dir):
    from pyspark.sql import Window

    return rows(spark, sf_dir).select("no", "org", "dept", F.row_number().over(Window.partitionBy("dept").orderBy("seq")).cast("long").alias("place"))


@C.add("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Ministry of Land' WHEN 1 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'Fire HQ' ELSE 'Province' END WHEN 2 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'Water Office' ELSE 'City' END ELSE 'Power Corp' END AS org, CASE s_suppkey % 4 WHEN 2 THEN 'team' || s_suppkey WHEN 3 THEN 'branch' || s_suppkey ELSE CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE 'dept' || s_suppkey END END AS dept FROM supplier")
def org_split(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    role = F.when(k % 4 == 0, "central").when(k % 4 == 1, "province").when(k % 4 == 2, "city").otherwise("agency")
    sub = F.when(k % 4 == 0, "Land(3)").when(k % 3 == 0, "the fire side").otherwise("x")
    num = k.cast("string")
    dept = F.when(k % 4 == 2, F.concat(F.when(k % 3 == 0, "Water Office").otherwise(""), F.lit("team"), num)).when(k % 4 == 3, F.concat(F.lit("Power Corp branch"), num)).otherwise(F.concat(F.lit("dept"), num))
    o = L.split_org(role, sub, dept, {"Land": "Ministry of Land"}, "Province", {"fire": "Fire HQ"}, ("Water Office", "Park Office"), "City", r"^(\S+ Corp) (.+)$")
    return s.withColumn("o", o).select("s_suppkey", "o.org", "o.dept")


@C.add("SELECT s_suppkey, CASE WHEN contains(s_name, '7') AND contains(s_name, '1') THEN 'Merged' ELSE s_name END AS dept, concat_ws(' ', CASE WHEN s_suppkey % 2 = 0 THEN 'old' END, CASE WHEN contains(s_name, '7') AND contains(s_name, '1') THEN 'was split' END) AS note FROM supplier")
def org_row_rules(spark, sf_dir):
    r = L.row_rules(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, "old").otherwise(""), [(("7", "1"), "Merged", "was split"), (("Nowhere",), "X", "y")])
    return table(spark, sf_dir, "supplier").withColumn("r", r).select("s_suppkey", "r.dept", "r.note")


BAND_SQL = """b0 AS (SELECT conv_id AS doc_id, turn AS band_no, conv_id * 1000 + turn AS k, replace(text, chr(10), ' ') AS t FROM conversations),
 bands AS (SELECT doc_id, band_no, CASE WHEN band_no >= 3 THEN 'g2' ELSE 'g1' END AS gun, CASE WHEN k % 7 = 0 THEN 'law ' || k ELSE '' END AS law, CASE WHEN k % 13 = 0 THEN '[환경과] ' || t WHEN k % 17 = 0 THEN '[붙임 1] ' || t WHEN k % 3 = 0 THEN '○' || t WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 THEN '-' WHEN k % 7 = 1 THEN ' ○ ' ELSE t END AS op, CASE WHEN k % 4 = 0 THEN 'ac' || k ELSE '' END AS ac, CASE WHEN k % 4 = 1 THEN '반영' WHEN k % 11 = 0 THEN '미 반영' ELSE '' END AS st FROM b0)"""


def bands(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn")
    t, num = F.replace("text", F.lit("\n"), F.lit(" ")), (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    return c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("band_no"), F.when(F.col("turn") >= 3, "g2").otherwise("g1").alias("gun"), F.when(k % 7 == 0, F.concat(F.lit("law "), num)).otherwise("").alias("law"), F.lit("d").alias("dept"), F.lit(1).alias("page"),
        F.when(k % 13 == 0, F.concat(F.lit("[환경과] "), t)).when(k % 17 == 0, F.concat(F.lit("[붙임 1] "), t)).when(k % 3 == 0, F.concat(F.lit("○"), t)).when(k % 5 == 0, "").when(k % 7 == 0, "-").when(k % 7 == 1, " ○ ").otherwise(t).alias("op"), F.when(k % 4 == 0, F.concat(F.lit("ac"), num)).otherwise("").alias("ac"), F.when(k % 4 == 1, "반영").when(k % 11 == 0, "미 반영").otherwise("").alias("st"),
    )


STITCH_SQL = rf"""{BAND_SQL}, n AS (SELECT *, CASE WHEN lag(gun) OVER w IS NULL OR lag(gun) OVER w <> gun OR NOT ((op = '' AND st = '') OR NOT (st <> '' OR regexp_matches(op, '^\s*[○◦]') OR (regexp_matches(op, '^\s*\[[^\]]+\]') AND NOT starts_with(op, '[붙임')))) THEN 1 ELSE 0 END AS new FROM bands WINDOW w AS (PARTITION BY doc_id ORDER BY band_no)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY band_no)::BIGINT AS rec FROM n), recs AS (SELECT doc_id, rec, arg_min(gun, band_no) AS gun, arg_min(law, band_no) AS law, coalesce(string_agg(op, chr(10) ORDER BY band_no) FILTER (WHERE op <> ''), '') AS op, coalesce(string_agg(ac, chr(10) ORDER BY band_no) FILTER (WHERE ac <> ''), '') AS ac, coalesce(string_agg(st, ' ' ORDER BY band_no) FILTER (WHERE st <> ''), '') AS st FROM g GROUP BY doc_id, rec)"""


@C.add(f"WITH {STITCH_SQL} SELECT * FROM recs")
def band_stitch(spark, sf_dir):
    return L.stitch(bands(spark, sf_dir)).select("doc_id", "rec", "gun", "law", "op", "ac", "st")


@C.add(rf"""WITH RECURSIVE {STITCH_SQL}, f AS (SELECT *, ac = '' AND st = '' AS blank, regexp_replace(op, '\s+', '', 'g') IN ('', '○', '-') AS bare, starts_with(op, '[환경과]') AS marked FROM recs),
 walk AS (SELECT doc_id, rec, gun, blank AND NOT bare AS held, rec AS top FROM f WHERE rec = 1 UNION ALL SELECT f.doc_id, f.rec, f.gun, f.blank AND (NOT f.bare OR (w.held AND w.gun = f.gun AND NOT f.marked)), CASE WHEN w.held AND w.gun = f.gun AND NOT f.marked THEN w.top ELSE f.rec END FROM walk w JOIN f ON f.doc_id = w.doc_id AND f.rec = w.rec + 1)
SELECT doc_id, max(rec) AS rec, arg_max(f.gun, rec) AS gun, arg_max(ac, rec) AS ac, arg_max(st, rec) AS st, coalesce(string_agg(op, chr(10) ORDER BY rec) FILTER (WHERE op <> ''), '') AS op, count(*) AS n FROM f JOIN walk USING (doc_id, rec) GROUP BY doc_id, top""")
def band_forward_hold(spark, sf_dir):
    return L.forward_hold(L.stitch(bands(spark, sf_dir)))


@C.add(rf"""WITH {BAND_SQL}, p AS (SELECT *, floor(band_no / 3)::BIGINT AS page, regexp_replace(law || op || ac || st, '\s+', '', 'g') AS t FROM bands), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY band_no) AS place FROM p) SELECT doc_id, band_no, page FROM r WHERE NOT (place = 1 AND (contains(t, 'law') OR contains(t, '○'))) AND t <> ''""")
def band_header_skip(spark, sf_dir):
    b = bands(spark, sf_dir).withColumns({"page": F.floor(F.col("band_no") / 3), "dept": F.lit("")})
    return A.skip_headers(b, ("law", "○")).select("doc_id", "band_no", "page")


@C.add(f"WITH {BAND_SQL} SELECT CASE WHEN contains(regexp_replace(st, '\\s+', '', 'g'), '미반영') THEN '미반영' ELSE '반영' END AS status, count(*) AS n FROM bands WHERE contains(regexp_replace(st, '\\s+', '', 'g'), '반영') GROUP BY 1")
def independent_tally(spark, sf_dir):
    return L.tally(bands(spark, sf_dir))


@C.add(f"WITH {BAND_SQL} SELECT doc_id, band_no, coalesce(nullif(law, ''), last_value(nullif(law, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY band_no)) AS law FROM bands")
def law_carry_over(spark, sf_dir):
    f = L.fill_down(bands(spark, sf_dir), {"law": None}, order="band_no")
    return f.select("doc_id", "band_no", F.col("law_filled").alias("law"))


@C.add(f"WITH {BAND_SQL}, p AS (SELECT *, count(nullif(law, '')) OVER (PARTITION BY doc_id ORDER BY band_no) AS part FROM bands) SELECT doc_id, band_no, last_value(nullif(law, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY band_no) AS dept, last_value(nullif(ac, '') IGNORE NULLS) OVER (PARTITION BY doc_id, part ORDER BY band_no) AS team FROM p")
def dept_fill(spark, sf_dir):
    f = L.fill_down(bands(spark, sf_dir), {"law": None, "ac": "law"}, order="band_no")
    return f.select("doc_id", "band_no", F.col("law_filled").alias("dept"), F.col("ac_filled").alias("team"))


@C.add("SELECT s_nationkey AS nation, s_suppkey AS seq, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey END AS total, last_value(CASE WHEN s_suppkey % 3 = 0 THEN 'G' || s_suppkey END IGNORE NULLS) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS grp FROM supplier")
def summary_rows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("seq"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("G"), F.col("s_suppkey").cast("string"))).otherwise("").alias("grp"), F.when(F.col("s_suppkey") % 5 == 0, "-").otherwise(F.col("s_suppkey").cast("string")).alias("cell"))
    f = L.fill_down(s, {"grp": None}, part="nation")
    return f.select("nation", "seq", F.coalesce(F.col("cell").try_cast("long"), F.lit(0)).alias("total"), F.col("grp_filled").alias("grp"))


@C.add("""WITH e AS (SELECT o_custkey % 50 AS doc_id, o_custkey % 7 AS page, (o_orderkey % 13)::INT AS pos, (o_orderkey % 500)::DOUBLE AS a, (o_orderkey % 500 + o_orderkey % 17)::DOUBLE AS b FROM orders), r AS (SELECT *, max(b) OVER (PARTITION BY doc_id, page, pos ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), s AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, pos ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS seg FROM r)
SELECT doc_id, page, pos, min(a) AS a, max(b) AS b FROM s GROUP BY doc_id, page, pos, seg""")
def segment_coalesce(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    e = o.select((F.col("o_custkey") % 50).alias("doc_id"), (F.col("o_custkey") % 7).alias("page"), (k % 13 + 0.2).cast("double").alias("pos"), (k % 500).cast("double").alias("a"), (k % 500 + k % 17).cast("double").alias("b"))
    return L.coalesce_segments(e, 2.0).withColumnRenamed("at", "pos")


RULES = A.Rules(roles={"g1": "city", "g2": "province"}, province="도", city="시", parents=("소방본부",), dept_alias={"도로": "도로과"})


@C.add()
def ledger_records(spark, sf_dir):
    """Conversations as strips with printed departments, put together to records and given to their departments."""
    k = F.col("doc_id") * 1000 + F.col("band_no")
    cells = {0: "환경과-7781(2026.01.08)", 2: "교통정", 3: "책과-4401(2026.1.13.)", 5: "소방본부(예방과)", 7: "도로", 8: "-5502(2026.01.20.)", 9: "공원과(2차협의)"}
    cell = F.lit("")
    for at, text in cells.items():
        cell = F.when(k % 11 == at, text).otherwise(cell)
    known = spark.createDataFrame([("교통정책과",), ("환경과",), ("도로과",)], "dept string")
    strips = bands(spark, sf_dir).withColumn("dept", cell)
    return A.assign(L.stitch(strips), known, RULES)


@C.add("""WITH t AS (SELECT s_suppkey, s_nationkey AS doc_id, s_suppkey AS seq, CASE WHEN s_suppkey % 9 = 0 THEN 'City side' WHEN s_suppkey % 7 = 0 THEN 'Province' ELSE '' END AS c0, s_suppkey % 6 = 0 AS sub FROM supplier),
 f AS (SELECT *, coalesce(last_value(CASE c0 WHEN 'City side' THEN 'City' WHEN 'Province' THEN 'Province' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq), '') AS gun FROM t)
SELECT doc_id, seq, gun, CASE gun WHEN 'Province' THEN CASE WHEN s_suppkey % 4 = 1 THEN 'Fire' ELSE 'Prov' END WHEN 'City' THEN 'Town' ELSE CASE WHEN s_suppkey % 4 = 1 THEN 'Fire(x)' ELSE 'd' || s_suppkey END END AS org,
 CASE WHEN s_suppkey % 4 = 1 THEN CASE gun WHEN 'Province' THEN 'x' ELSE 'Fire(x)' END ELSE 'd' || s_suppkey END AS dept, CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey END AS total, 1::BIGINT AS "반영", 0::BIGINT AS "부분반영", 2::BIGINT AS "미반영", 0::BIGINT AS "의견없음", 3::BIGINT AS "미회신", CASE WHEN s_suppkey % 4 = 1 THEN 'n o fire' ELSE 'n o' END AS note FROM f WHERE NOT sub""")
def summary_table(spark, sf_dir):
    """Suppliers as printed rows of a summary, every sixth a subtotal."""
    k = F.col("s_suppkey")
    num = k.cast("string")
    dept = F.when(k % 6 == 0, "소 계").when(k % 4 == 1, F.concat(F.lit("Fire (d"), num, F.lit(")"))).otherwise(F.concat(F.lit("d "), num))
    group = F.when(k % 9 == 0, "City side").when(k % 7 == 0, "Pro vince").otherwise("")
    cells = F.array(group, dept, dept, F.when(k % 5 == 0, "-").otherwise(num), F.lit(" 1"), F.lit("-"), F.lit("2"), F.lit(""), F.lit("3"), F.lit(" n  o "))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), k.alias("seq"), cells.alias("cells"))
    rules = A.Rules(roles={"City": "city", "Province": "province"}, group_alias={"Citysi": "City"}, province="Prov", city="Town", parents=("Fire",), rows=((("Fire",), "Fire(x)", "fire"),))
    return A.read_summary(rows, rules)


@C.add()
def law_over_pages(spark, sf_dir):
    """Laws of strips over the ends of pages of three strips; a law's cell is merged with the empty ones below it."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page").orderBy("band_no")
    b = bands(spark, sf_dir).withColumns({"page": F.floor(F.col("band_no") / 3), "role": F.lit("city"), "nc": F.lit(5)})
    b = b.withColumn("law_region", F.count(F.nullif("law", F.lit(""))).over(w))
    return A.carry_laws(b, spark.createDataFrame([("환경과",)], "dept string"), T.LAW_ENDINGS).select("doc_id", "page", "band_no", "law")
