"""Opinion ledgers: records from strips, status and topic, reconciliation against a summary, and the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_word, flat, row_fingerprint

STATUSES = ("반영", "부분반영", "미반영", "의견없음", "미회신")
ALL_STATUSES = (*STATUSES, "미기재")
UNCOUNTED = "총괄표 미집계"


# -- records -----------------------------------------------------------------------------------------------------------
def note(round_no: Column, attachments: Column, status_text: Column, status: Column) -> Column:
    """The parts of a record's note that apply, joined by " / "."""
    again = round_no.cast("int") >= 2
    part = lambda test, text: F.when(test, text)
    return F.concat_ws(
        " / ",
        part(again, F.concat(round_no.cast("string"), F.lit("차협의(본협의표 통합)"))),
        part(attachments != "", F.concat(F.lit("근거첨부:붙임"), attachments)),
        part(flat(status_text).contains("재협의"), F.lit("재협의 진행중")),
        part(status == "미기재", F.lit("반영여부 미기재-검수")),
        part(status == "미회신", F.lit("무응답/미회신")),
    )


def consultation_round(cell: Column, flagged: Column, status_text: Column) -> Column:
    """struct<round, kind, again>: the number of ``(n차협의)``; a later round or a flag is a re-consultation."""
    n = F.nullif(F.regexp_extract(flat(cell), r"\((\d+)차협의\)", 1), F.lit("")).try_cast("int")
    again = F.coalesce(n >= 2, F.lit(False)) | flagged
    return F.struct(n.alias("round"), F.when(again, "재협의").otherwise("본협의").alias("kind"), F.when(again | flat(status_text).contains("재협의"), "Y").otherwise("").alias("again"))


def split_org(role: Column, sub: Column, dept: Column, abbreviations: dict, province: str, sub_orgs: dict, prefixes, city: str, agency_rx: str, parents=()) -> Column:
    """struct<org, dept> of a summary row, by the way its group writes them; ``parents`` are the province's own offices,
    written before their department in brackets."""
    base = F.regexp_replace(sub, r"\(\d+\)", "")
    central = base
    for k, v in abbreviations.items():
        central = F.when(base == k, v).otherwise(central)
    prov = F.lit(province)
    for k, v in sub_orgs.items():
        prov = F.when(sub.contains(k), v).otherwise(prov)
    below = F.regexp_extract(dept, r"^([^(]+)\((.+)\)$", 1)
    is_below = below.isin(*parents) if parents else F.lit(False)
    prov, prov_dept = F.when(is_below, below).otherwise(prov), F.when(is_below, F.regexp_extract(dept, r"^([^(]+)\((.+)\)$", 2)).otherwise(dept)
    city_org, city_dept = F.lit(city), dept
    for p in reversed(prefixes):
        city_org, city_dept = F.when(dept.startswith(p), p).otherwise(city_org), F.when(dept.startswith(p), F.substring(dept, len(p) + 1, 10_000)).otherwise(city_dept)
    split = dept.rlike(agency_rx) & (F.regexp_extract(dept, agency_rx, 2) != "")
    org = F.when(role == "central", central).when(role == "province", prov).when(role == "city", city_org).when(split, F.regexp_extract(dept, agency_rx, 1)).otherwise(dept)
    out = F.when(role == "city", city_dept).when(role == "province", prov_dept).when(role == "central", dept).when(split, F.regexp_extract(dept, agency_rx, 2)).otherwise(dept)
    return F.struct(org.alias("org"), out.alias("dept"))


def row_rules(dept: Column, note_text: Column, rules) -> Column:
    """struct<dept, note>: a rule whose words all stand in the department replaces it and adds to the note; later rules see the new name."""
    for words, new, added in rules:
        hit = F.lit(True)
        for w in words:
            hit = hit & dept.contains(w)
        note_text = F.when(hit, F.concat_ws(" ", F.nullif(note_text, F.lit("")), F.lit(added))).otherwise(note_text)
        dept = F.when(hit, new).otherwise(dept)
    return F.struct(dept.alias("dept"), F.coalesce(note_text, F.lit("")).alias("note"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin("본협의", "재협의"))


def is_open() -> Column:
    return F.col("status").isin("미반영", "미기재", "미회신") | (F.col("again") == "Y")


def open_items(rows: DataFrame) -> DataFrame:
    return counted(rows).where(is_open())


def todo(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status").isin("미반영", "부분반영", "미회신", "미기재") | (F.col("again") == "Y"))


def keyword_extract(rows: DataFrame, keywords, dept_rx: str, pinned: DataFrame) -> DataFrame:
    """Grade A rows hold a keyword, grade B are unanswered ones of a fitting department; pinned rows come first, each row once."""
    text = F.concat(flat(F.col("opinion")), flat(F.col("action")))
    hits = F.array_compact(F.array(*[F.when(text.contains(k), F.lit(k)) for k in keywords]))
    grade = F.when(F.size(hits) > 0, "A").when((F.col("status") == "미회신") & F.col("dept").rlike(dept_rx), "B")
    graded = rows.withColumn("hits", hits).withColumn("grade", grade)
    pins = graded.join(F.broadcast(pinned.select("no")), "no", "left_semi").withColumn("place", F.lit(0))  # pinned rows are a hand-made list
    rest = graded.join(F.broadcast(pinned.select("no")), "no", "left_anti").where("grade is not null").withColumn("place", F.lit(1))
    return pins.unionByName(rest).orderBy("place", "grade", "no")


# -- reconciliation --------------------------------------------------------------------------------------------------
def status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in ALL_STATUSES]


def reconcile_counts(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """Departments whose summary total differs from the number of records, or that one side lacks."""
    want = summary.groupBy("grp", flat(F.col("dept")).alias("dept")).agg(F.sum(F.col("total") + F.col("미회신")).alias("expected"))
    got = rows.groupBy("grp", flat(F.col("dept")).alias("dept")).agg(F.count("*").alias("found"))
    return want.join(got, ["grp", "dept"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("found")))


def reconcile_status(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """Per (org, dept): the summary's five statuses against the records', their difference, and whether count and statuses agree."""
    want = summary.groupBy("org", "dept").agg(*[F.sum(s).alias(f"w_{s}") for s in STATUSES])
    got = rows.groupBy("org", "dept").agg(*[F.count_if(F.col("status") == s).alias(f"g_{s}") for s in ALL_STATUSES])
    j = want.join(got, ["org", "dept"], "full_outer").na.fill(0)
    total = lambda p, names: sum((F.col(f"{p}_{s}") for s in names), F.lit(0))
    same = F.lit(True)
    for s in STATUSES:
        same = same & (F.col(f"w_{s}") == F.col(f"g_{s}"))
    expected, found = total("w", STATUSES), total("g", ALL_STATUSES)
    return j.select("org", "dept", expected.alias("expected"), found.alias("found"), (found - expected).alias("difference"), (expected == found).alias("count_match"), (same & (F.col("g_미기재") == 0)).alias("status_match"))


def flag_uncounted(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``rows`` with ``kind`` 총괄표 미집계 for the last records beyond a department's summary total, "-" records before others."""
    totals = summary.groupBy("org", "dept").agg(F.sum(sum((F.col(s) for s in STATUSES), F.lit(0))).alias("expected"))
    main = rows.where("kind = '본협의'")
    w = Window.partitionBy("org", "dept")
    dash = F.col("status_raw") == "-"
    j = main.join(totals, ["org", "dept"], "left").withColumn("over", F.count("*").over(w) - F.col("expected")).withColumn("dashes", F.count_if(dash).over(w))
    candidate = (F.col("dashes") == 0) | dash
    rank = F.row_number().over(w.orderBy(F.desc(candidate.cast("int")), F.desc("seq")))
    j = j.withColumn("rank", rank)
    hit = F.coalesce((F.col("over") > 0) & candidate & (F.col("rank") <= F.col("over")), F.lit(False))
    flagged = j.withColumn("kind", F.when(hit, UNCOUNTED).otherwise(F.col("kind"))).drop("expected", "over", "dashes", "rank")
    return flagged.unionByName(rows.where("kind <> '본협의'"))


def flag_status(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Records whose status is over-represented in a department of the right count, with the first status it lacks (``instead``)."""
    want = summary.groupBy("org", "dept").agg(*[F.sum(s).alias(f"w_{s}") for s in STATUSES])
    got = rows.groupBy("org", "dept").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(f"g_{s}") for s in STATUSES])
    j = want.join(got, ["org", "dept"]).where(F.col("n") <= sum((F.col(f"w_{s}") for s in STATUSES), F.lit(0)))
    lacks = F.coalesce(*[F.when(F.col(f"w_{s}") > F.col(f"g_{s}"), F.lit(s)) for s in STATUSES])
    over = F.array_compact(F.array(*[F.when(F.col(f"g_{s}") > F.col(f"w_{s}"), F.lit(s)) for s in STATUSES]))
    marks = j.select("org", "dept", over.alias("over"), F.coalesce(lacks, F.lit("다른 상태")).alias("instead"))
    return rows.join(marks, ["org", "dept"]).where(F.array_contains("over", F.col("status"))).drop("over")


def annotate_guarded(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """``rows`` with the notes of the same number; a note whose department and opinion do not agree stops the job."""
    n = notes.select(F.col("no").alias("_no"), row_fingerprint(F.col("dept"), F.col("opinion20")).alias("_fp"), "note_add")
    j = rows.join(n, rows["no"] == F.col("_no"), "left")
    agrees = F.col("_no").isNull() | (F.col("_fp") == row_fingerprint(F.col("dept"), F.col("opinion")))
    checked = F.when(agrees, F.col("note_add")).otherwise(F.raise_error(F.concat(F.lit("note does not fit record "), F.col("no").cast("string"))))
    return j.withColumn("note_add", checked).drop("_no", "_fp")


def evidence_attach(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``rows`` with ``verdict`` of the result of the same number if the fingerprints agree; ``skewed`` marks dropped links."""
    r = results.select(F.col("no").alias("_no"), F.col("fp").alias("_fp"), F.col("verdict").alias("_verdict"))
    j = rows.join(r, rows["no"] == F.col("_no"), "left")
    same = F.col("_fp") == row_fingerprint(F.col("dept"), F.col("opinion"))
    return j.withColumn("verdict", F.when(same, F.col("_verdict"))).withColumn("skewed", F.coalesce(~same, F.lit(False))).drop("_no", "_fp", "_verdict")


def alias_prefix(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows(org, dept)`` with ``alias``: an unknown department becomes the single known one of its organisation that starts with it."""
    unknown = rows.select("org", "dept").distinct().join(known.select("org", "dept").distinct(), ["org", "dept"], "left_anti")
    k = known.select("org", F.col("dept").alias("full")).distinct()
    found = unknown.join(k, "org").where(F.col("full").startswith(F.col("dept"))).groupBy("org", "dept").agg(F.count("*").alias("n"), F.min("full").alias("full")).where("n = 1")
    return rows.join(found.drop("n"), ["org", "dept"], "left").withColumn("alias", F.coalesce("full", "dept")).drop("full")


# -- result tables -------------------------------------------------------------------------------------------------------
def by_dept(rows: DataFrame) -> DataFrame:
    """Counts per (group, org, dept), adoption rate, and the most frequent issue (first met on a tie)."""
    keys = ["grp", "org", "dept"]
    issue = rows.groupBy(*keys, "issue").agg(F.count("*").alias("k"), F.min("seq").alias("s")).groupBy(*keys).agg(F.max_by("issue", F.struct("k", -F.col("s"))).alias("top_issue"))
    base = F.col("n") - F.col("미회신") - F.col("의견없음")
    rate = F.round(F.try_divide(F.col("반영") + 0.5 * F.col("부분반영"), F.nullif(base, F.lit(0))), 6)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), *status_counts(), F.count_if(F.col("again") == "Y").alias("again"))
    return counts.withColumn("rate", rate).join(issue, keys)


def by_org(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp", "org").agg(F.countDistinct("dept").alias("depts"), F.count("*").alias("n"), *status_counts(), F.count_if(F.col("again") == "Y").alias("again"))


def crosstab(rows: DataFrame) -> DataFrame:
    """Group by status with totals of rows and columns, and a row of re-consultations; "합계" names a total."""
    cells = rows.cube("grp", "status").agg(F.count("*").alias("n")).select(F.coalesce("grp", F.lit("합계")).alias("grp"), F.coalesce("status", F.lit("합계")).alias("status"), "n")
    again = rows.where("again = 'Y'").groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit("재협의").alias("status"), "n")
    return cells.unionByName(again)


def kpi(rows: DataFrame) -> DataFrame:
    s = F.col("status")
    reviewed = F.count_if(~s.isin("미회신", "의견없음"))
    return rows.agg(reviewed.alias("reviewed"), F.count_if(s == "반영").alias("adopted"), F.round(F.try_divide(100.0 * F.count_if(s == "반영"), F.nullif(reviewed, F.lit(0))), 1).alias("rate"), F.countDistinct(F.when(s == "미회신", F.struct("org", "dept"))).alias("unanswered_depts"), F.count_if(F.col("again") == "Y").alias("again"), F.count_if(is_open()).alias("open"))


def issue_counts(rows: DataFrame) -> DataFrame:
    """Counts of the issues (a handful of rows) with their share of the largest."""
    n = rows.groupBy("issue").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("top")))).select("issue", "n", F.round(F.col("n") / F.col("top"), 6).alias("share"))


def summary_compare(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """Per status: total of the summary, of the records, and the difference."""
    stack = F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in STATUSES]), F.array(*[F.col(s) for s in STATUSES])))
    want = summary.agg(*[F.sum(s).alias(s) for s in STATUSES]).select(stack.alias("status", "expected"))
    got = rows.groupBy("status").agg(F.count("*").alias("found"))
    return want.join(got, "status", "left").select("status", "expected", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) - F.col("expected")).alias("difference"))


# -- strips ---------------------------------------------------------------------------------------------------------------
#: A department's name in square brackets, and the bullets, that start a record.
MARK, BULLETS = r"^\s*\[\s*[^\]]{2,40}\s*\]", r"^\s*[○◦]"


def has_mark(opinion: Column) -> Column:
    """Whether an opinion starts with a department in brackets; an attachment's mark is none."""
    return opinion.rlike(MARK) & ~F.ltrim(opinion).startswith("[붙임")


def stitch(bands: DataFrame) -> DataFrame:
    """Strips of a document put together to records, in the order of ``band_no``.

    A strip continues the record before it, within its group, when opinion and status are empty, or when nothing in it
    starts a new one: no department's mark and no bullet at the opinion, no status, no bullet at the action. Texts join
    by line, statuses by space; the other fields are those of the first strip."""
    w = Window.partitionBy("doc_id").orderBy("band_no")
    blank = (F.col("op") == "") & (F.trim("st") == "")
    starts = has_mark(F.col("op")) | (F.trim("st") != "") | F.col("op").rlike(BULLETS) | F.col("ac").rlike(BULLETS)
    before = F.lag("gun").over(w)
    new = before.isNull() | (before != F.col("gun")) | ~(blank | ~starts)
    rows = bands.withColumn("rec", F.sum(new.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("band_no", "op", "ac", "st")))
    joined = lambda c, sep: F.array_join(F.filter(F.transform("parts", lambda x: x[c]), lambda x: x != ""), sep).alias(c)
    got = rows.groupBy("doc_id", "rec").agg(parts.alias("parts"), F.min_by("gun", "band_no").alias("gun"), F.min_by("law", "band_no").alias("law"), F.min_by("dept", "band_no").alias("dept"), F.min("page").alias("page"))
    return got.select("doc_id", "rec", "gun", "dept", "law", "page", joined("op", "\n"), joined("ac", "\n"), joined("st", " "))


def forward_hold(records: DataFrame) -> DataFrame:
    """A record without action and status is held and put before the next record of its group, unless that has a mark.

    A bare opinion (nothing, ○ or -) is not held for itself, but is once it has been joined to one that is: an island
    ends where the group changes, a mark stands or the record before has an action or status, and within it all that
    follows the first opinion which is not bare is joined."""
    w = Window.partitionBy("doc_id").orderBy("rec")
    blank = (F.trim("ac") == "") & (F.trim("st") == "")
    bare = F.regexp_replace("op", r"\s+", "").isin("", "○", "-")
    cut = F.lag("gun").over(w).isNull() | (F.lag("gun").over(w) != F.col("gun")) | has_mark(F.col("op")) | ~F.lag(blank).over(w)
    rows = records.withColumn("_island", F.sum(cut.cast("int")).over(w)).withColumn("_bare", bare)
    within = Window.partitionBy("doc_id", "_island").orderBy("rec")
    held_before = F.coalesce(F.max((~F.col("_bare")).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rows = rows.withColumn("_new", (~held_before).cast("int")).withColumn("_out", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("rec", "op")))
    last = lambda c: F.max_by(c, "rec").alias(c)
    got = rows.groupBy("doc_id", "_out").agg(F.max("rec").alias("rec"), last("gun"), last("ac"), last("st"), parts.alias("p"), F.count("*").alias("n"))
    return got.select("doc_id", "rec", "gun", "ac", "st", F.array_join(F.filter(F.transform("p", lambda x: x["op"]), lambda x: x != ""), "\n").alias("op"), "n")


def fill_down(rows: DataFrame, columns: dict[str, str | None], part: str = "doc_id", order: str = "seq") -> DataFrame:
    """Each column carried forward over blanks within ``part``; a column may be reset when another one is given anew."""
    w = Window.partitionBy(part).orderBy(order)
    out = rows
    for c, reset in columns.items():
        value = F.nullif(F.col(c), F.lit(""))
        if reset is None:
            out = out.withColumn(f"{c}_filled", F.last(value, ignorenulls=True).over(w))
        else:
            out = out.withColumn("_part", F.count(F.nullif(F.col(reset), F.lit(""))).over(w))
            inner = Window.partitionBy(part, "_part").orderBy(order)
            out = out.withColumn(f"{c}_filled", F.last(value, ignorenulls=True).over(inner)).drop("_part")
    return out


def tally(bands: DataFrame) -> DataFrame:
    """Status words counted straight from the strips, without putting records together."""
    s = flat(F.col("st"))
    kind = F.when(s.contains("부분반영"), "부분반영").when(s.contains("미반영"), "미반영").when(s.contains("반영"), "반영")
    return bands.withColumn("status", kind).where("status is not null").groupBy("status").agg(F.count("*").alias("n"))


def coalesce_segments(edges: DataFrame, gap: float) -> DataFrame:
    """Collinear segments ``(doc_id, page, pos, a, b)`` merged where at most ``gap`` apart, positions snapped to whole points."""
    w = Window.partitionBy("doc_id", "page", "at").orderBy("a", "b")
    rows = edges.withColumn("at", F.bround("pos").cast("int"))
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (reach.isNull() | (F.col("a") > reach + gap)).cast("int")).withColumn("seg", F.sum("new").over(w))
    return rows.groupBy("doc_id", "page", "at", "seg").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("seg")


def no_reply_depts(rows: DataFrame) -> DataFrame:
    return rows.where("status = '미회신'").groupBy("org", "dept").agg(F.min("seq").alias("seq")).orderBy("seq")


def ledger_search(rows: DataFrame, text: str, fields, **equal) -> DataFrame:
    out = rows.where(F.lower(F.concat_ws(" ", *fields)).contains(text.lower()))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


#: Fixed phrases that say that there is no opinion; each space may stand or not.
TRIVIAL = ("의견 없음", "검토의견 없음", "해당  없음", "해당 사항 없음", "저촉  없음", "저촉 사항 없음", "미회신", "이상 없음", "별도 의견 없음")


def trivial(opinion: Column, phrases=TRIVIAL) -> Column:
    """Opinions that start, bullets and dashes aside, by saying that there is none."""
    return F.coalesce(opinion, F.lit("")).rlike(r"^[○\s\-·]*(?:" + "|".join(p.replace(" ", r"\s?") for p in phrases) + ")")


def none_words(text: Column, words) -> Column:
    return any_word(flat(text), words)
