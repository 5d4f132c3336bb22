"""Ledger records given to organisations and departments, and the summary table they are counted against.

A document is one printed ledger, so windows over a document are bounded by its pages; documents spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_numbers, flat
from .ledger import row_rules, split_org


@dataclass(frozen=True)
class Rules:
    """How the groups of a ledger write their organisations. ``roles`` gives each group's role: central, province, city or agency."""

    roles: dict[str, str]
    province: str = ""
    city: str = ""
    agency_pattern: str = r"^(\S+공사)(.+)$"
    parents: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    dept_alias: dict[str, str] = field(default_factory=dict)
    org_alias: dict[str, str] = field(default_factory=dict)
    group_alias: dict[str, str] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    sub_orgs: dict[str, str] = field(default_factory=dict)
    rows: tuple = ()


#: Patterns of the ledgers' own formats: a department's mark, a round, the rest of a document number cut by a page's end,
#: an organisation with its part in brackets, words of subtotal rows.
MARK = r"^\s*\[\s*([^\]]{2,40})\s*\]\s*"
ROUND = r"[(（]\s*([0-9]+)\s*차\s*협의\s*[)）]"
NUMBER_REST = r"^[-‐–]?(\d{3,6})[(（](\d{4})\.(\d{1,2})\.(\d{1,2})"
IN_BRACKETS = r"^(.+?)[(（](.+)[)）]$"
SUBTOTALS, SUBTOTAL_PARTS = ("계", "소계", "합계"), ("개부서", "개기관")


def _mapped(value: Column, table: dict[str, str]) -> Column:
    out = value
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def _given(test: Column, value: Column) -> Column:
    """``value`` where the test holds and it is not empty, else null."""
    return F.when(test & (value != ""), value)


def _whole_names(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``name``, ``number`` and ``date`` of city rows with department names put together that a page's end has cut.

    A name that is not known is joined to the one printed before it if both make a known one; the part before becomes
    whole as well and takes the number if it has none. A later row that repeats the end of a whole name means that name."""
    city = rows.where("role = 'city' and name <> ''")
    w = Window.partitionBy("doc_id", "seg").orderBy("rec")
    city = city.select("doc_id", "seg", "rec", "name", "number", "date", F.lag("name").over(w).alias("prev"), F.lead("name").over(w).alias("next"), F.lead("number").over(w).alias("next_number"), F.lead("date").over(w).alias("next_date"))
    names = known.select(F.col("dept").alias("known")).where("known is not null").distinct()
    for c, text in (("own", F.col("name")), ("with_prev", F.concat("prev", "name")), ("with_next", F.concat("name", "next")), ("next_own", F.col("next"))):
        city = city.withColumn("_t", text).join(names.withColumnRenamed("known", c), F.col("_t") == F.col(c), "left").drop("_t")
    back = F.when(F.col("own").isNull(), F.col("with_prev"))
    ahead = F.when(F.col("next_own").isNull(), F.col("with_next"))
    city = city.withColumn("sure", F.coalesce(back, "own", ahead))
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("sure", ignorenulls=True).over(upto)
    city = city.withColumn("tail", F.col("sure").isNull() & F.coalesce(last.endswith(F.col("name")), F.lit(False)))
    # What is neither whole nor the end of the last whole name starts a department of its own.
    city = city.withColumn("_run", F.sum((~F.col("tail")).cast("int")).over(w))
    run = Window.partitionBy("doc_id", "seg", "_run").orderBy("rec")
    city = city.withColumn("whole", F.coalesce("sure", F.when(F.col("tail"), F.first("sure").over(run)), "name"))
    renamed = F.when((F.col("whole") != F.col("name")) & F.col("number").startswith(F.concat("name", F.lit("-"))), F.concat("whole", F.substring("number", F.length("name") + 1, F.length("number")))).otherwise(F.col("number"))
    late = F.col("with_next").isNotNull() & (F.col("whole") == F.col("with_next")) & (F.col("own").isNull() | F.col("next_own").isNull()) & (F.col("number") == "") & (F.col("next_number") != "")
    from_next = F.concat("whole", F.substring("next_number", F.length("next") + 1, F.length("next_number")))
    whole = city.select("doc_id", "rec", "whole", F.when(late, from_next).otherwise(renamed).alias("whole_number"), F.when(late, F.col("next_date")).otherwise(F.col("date")).alias("whole_date"))
    return rows.join(whole, ["doc_id", "rec"], "left").withColumns({"name": F.coalesce("whole", "name"), "number": F.coalesce("whole_number", "number"), "date": F.coalesce("whole_date", "date")}).drop("whole", "whole_number", "whole_date")


def assign(records: DataFrame, known: DataFrame, rules: Rules) -> DataFrame:
    """Records with their organisation, department, team, round and document number.

    ``records(doc_id, rec, gun, dept, law, op, ac, st, page)`` in the order of ``rec``, ``known(dept)`` the departments of
    the summary. The department cell and the mark at the opinion are read by the group's role; what they say holds until
    said anew or until the group changes. A team ends where the cell changes, a number where a new department comes
    without one, a round where a cell or a mark comes without one. A row with nothing but a mark is put before the next
    row, or stands alone where that one has a mark; nulls count as empty, an empty table gives none."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("dept", "law", "op", "ac", "st")]
    rows = records.select("doc_id", "rec", F.coalesce("gun", F.lit("")).alias("gun"), "page", *texts)
    w = Window.partitionBy("doc_id").orderBy("rec")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    role = F.coalesce(_mapped_role(F.col("gun"), rules.roles), F.lit("city"))
    rows = rows.withColumns({"cell": flat(F.col("dept")), "role": role, "_new": F.coalesce((F.lag("gun").over(w) != F.col("gun")).cast("int"), F.lit(1))})
    rows = rows.withColumn("seg", F.sum("_new").over(w))
    changed = (F.col("cell") != "") & ~F.last(F.nullif("cell", F.lit("")), ignorenulls=True).over(before).eqNullSafe(F.col("cell"))
    rows = rows.withColumns({"changed": changed, "d": doc_numbers(F.col("cell"))})
    is_city = F.col("role") == "city"
    rows = rows.withColumns({"name": F.when(is_city, F.col("d.name")).otherwise(F.col("cell")), "number": F.when(is_city, F.col("d.numbers")).otherwise(""), "date": F.when(is_city, F.col("d.dates")).otherwise("")}).drop("d")
    rows = _whole_names(rows, known).withColumn("name", _mapped(F.col("name"), rules.dept_alias))

    mark = F.trim(F.regexp_extract("op", MARK, 1))
    rows = rows.withColumns({"marked": F.col("op").rlike(MARK), "mark": F.when(flat(mark).isin(*rules.dept_alias), _mapped(flat(mark), rules.dept_alias)).otherwise(mark), "op": F.trim(F.regexp_replace("op", MARK, ""))})
    again = F.regexp_extract("op", r"^\s*" + ROUND, 1)
    rows = rows.withColumns({"again": again, "op": F.when(again != "", F.trim(F.regexp_replace("op", r"^\s*" + ROUND, ""))).otherwise(F.col("op"))})
    round_said = F.when(F.col("again") != "", F.col("again")).when(F.col("marked"), "").when(F.col("cell") != "", F.regexp_extract("cell", ROUND, 1))

    part = lambda g: F.regexp_extract("name", IN_BRACKETS, g)
    agency = lambda g: F.regexp_extract("name", rules.agency_pattern, g)
    bracketed, spelled = part(1) != "", F.col("name").rlike(rules.agency_pattern)
    below = F.when(bracketed & part(1).isin(*rules.parents), part(1)) if rules.parents else F.lit(None).cast("string")
    city_org, city_dept = F.lit(rules.city), F.col("name")
    for p in reversed(rules.prefixes):
        city_org, city_dept = F.when(F.col("name").startswith(p), p).otherwise(city_org), F.when(F.col("name").startswith(p), F.substr("name", F.lit(len(p) + 1))).otherwise(city_dept)
    printed, named = F.col("name") != "", F.col("name").rlike("^[가-힣]")
    in_role = lambda r: F.col("role") == r
    org_said = F.when(in_role("central"), _given(printed, _mapped(F.col("name"), rules.org_alias))).when(in_role("province"), F.when(printed, F.coalesce(below, F.lit(rules.province)))).when(in_role("agency"), F.when(printed, F.when(bracketed, part(1)).when(spelled, agency(1)).otherwise(F.col("name")))).otherwise(F.when(named, city_org))
    dept_said = F.when(in_role("central"), _given(F.col("marked"), F.col("mark"))).when(in_role("province"), F.when(printed, F.when(below.isNotNull(), part(2)).otherwise(F.col("name")))).when(in_role("agency"), F.when(printed, F.when(bracketed, part(2)).when(spelled & (agency(2) != ""), agency(2)).when(spelled, agency(1)).otherwise(F.col("name")))).otherwise(F.when(named, city_dept))
    with_team = F.col("role").isin("province", "agency")
    team_said = F.when(with_team & F.col("marked"), F.col("mark")).when(with_team & F.col("changed"), "")

    held = Window.partitionBy("doc_id", "seg").orderBy("rec")
    holds = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(held), F.lit(""))
    rows = rows.withColumns({"org": holds(org_said), "dept": holds(dept_said), "team": holds(team_said), "round": holds(round_said)})
    rows = rows.withColumn("org", F.when(in_role("city") & (F.col("org") == ""), F.lit(rules.city)).otherwise(F.col("org")))
    own = F.lag("dept").over(held)
    rest = lambda g: F.regexp_extract("cell", NUMBER_REST, g)
    cut = (rest(1) != "") & (own != "")
    day = F.concat_ws(".", rest(2), F.lpad(rest(3), 2, "0"), F.lpad(rest(4), 2, "0"))
    number_said = F.when(in_role("city"), F.when(F.col("number") != "", F.struct("number", "date")).when(cut, F.struct(F.concat_ws("-", own, rest(1)).alias("number"), day.alias("date"))).when(named, F.struct(F.lit("").alias("number"), F.lit("").alias("date"))))
    rows = rows.withColumn("doc", F.last(number_said, ignorenulls=True).over(held))

    bare = lambda c, also: F.when(F.trim(c).isin("○", *also), "").otherwise(F.trim(c))
    rows = rows.withColumns({"dept": F.coalesce(F.nullif("dept", F.lit("")), "org"), "op": bare("op", ()), "ac": bare("ac", ())})
    blank = (F.col("op") == "") & (F.col("ac") == "") & (F.regexp_replace(F.trim("st"), "^-+|-+$", "") == "")
    rows = rows.withColumn("blank", blank)
    # The document's first rows wait for the first that has a content or a mark of its own.
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("stirs", (F.col("marked") & (F.col("place") > 1)).cast("int"))
    begun = (F.coalesce(F.max((~F.col("blank")).cast("int")).over(before), F.lit(0)) == 1) | (F.max("stirs").over(w) == 1)
    rows = rows.withColumn("waits", F.col("blank") & (F.col("marked") | ~begun))
    rows = rows.withColumn("out", F.sum((~(F.coalesce(F.lag("waits").over(w), F.lit(False)) & ~F.col("marked"))).cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("rec", "op", "ac", "st"))).alias("parts")
    last = [F.max_by(c, "rec").alias(c) for c in ("gun", "org", "dept", "team", "round", "doc", "law")]
    got = rows.groupBy("doc_id", "out").agg(F.max("rec").alias("rec"), F.min_by("page", "rec").alias("page"), *last, parts)
    joined = lambda c, sep: F.trim(F.array_join(F.filter(F.transform("parts", lambda x: x[c]), lambda x: x != ""), sep)).alias(c)
    return got.select("doc_id", "rec", "gun", "org", "dept", "team", "round", F.coalesce("doc.number", F.lit("")).alias("doc_no"), F.coalesce("doc.date", F.lit("")).alias("doc_date"), "law", joined("op", "\n"), joined("ac", "\n"), joined("st", " "), "page")


def _mapped_role(group: Column, roles: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in roles.items():
        out = F.when(group == k, v).otherwise(out)
    return out


def read_summary(rows: DataFrame, rules: Rules) -> DataFrame:
    """Summary rows ``(doc_id, seq, gun, org, dept, counts..., note)`` from ``rows(doc_id, seq, cells)`` with ten cells each:
    group, organisation, department, total, five statuses, note.

    Header and subtotal rows are left out, a group holds until the next is named (the longest name that starts the cell),
    a department cell merged with its organisation's has no organisation of its own; ``-`` and blanks count 0."""
    cell = lambda i: F.coalesce(F.col("cells")[i], F.lit(""))
    table = rows.where(F.size("cells") >= 10).where((flat(cell(0)) != "구분") & ~flat(cell(1)).contains("협의부서") & ~flat(cell(2)).contains("협의부서"))
    named = F.lit(None).cast("string")
    for name in sorted({*rules.roles, *rules.group_alias}, key=len):
        named = F.when(flat(cell(0)).startswith(name), rules.group_alias.get(name, name)).otherwise(named)
    w = Window.partitionBy("doc_id").orderBy("seq")
    table = table.withColumns({"gun": F.coalesce(F.last(named, ignorenulls=True).over(w), F.lit("")), "dept": flat(cell(2)), "sub": F.when(flat(cell(1)) == flat(cell(2)), "").otherwise(flat(cell(1)))})
    skipped = (F.col("dept") == "") | F.col("dept").isin(*SUBTOTALS)
    for word in SUBTOTAL_PARTS:
        skipped = skipped | F.col("dept").contains(word)
    table = table.where(~skipped).withColumn("r", row_rules(F.col("dept"), F.trim(F.regexp_replace(cell(9), r"\s+", " ")), rules.rows))
    split = split_org(_mapped_role(F.col("gun"), rules.roles), F.col("sub"), F.col("r.dept"), rules.abbreviations, rules.province, rules.sub_orgs, rules.prefixes, rules.city, rules.agency_pattern, rules.parents)
    number = lambda i: F.when(flat(cell(i)).rlike("^[0-9]+$"), flat(cell(i)).try_cast("long")).otherwise(F.lit(0)).alias(("total", "반영", "부분반영", "미반영", "의견없음", "미회신")[i - 3])
    table = table.withColumn("o", split)
    return table.select("doc_id", "seq", "gun", F.col("o.org").alias("org"), F.coalesce(F.nullif("o.dept", F.lit("")), "o.org").alias("dept"), *[number(i) for i in range(3, 9)], F.col("r.note").alias("note"))


def skip_headers(bands: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Strips without the first of each page where that holds one of the header words, and without empty ones."""
    w = Window.partitionBy("doc_id", "page").orderBy("band_no")
    text = flat(F.concat_ws("", "dept", "law", "op", "ac", "st"))
    header = F.lit(False)
    for word in words:
        header = header | text.contains(word)
    return bands.withColumn("_place", F.row_number().over(w)).where(~((F.col("_place") == 1) & header) & (text != "")).drop("_place")


def carry_laws(bands: DataFrame, known: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """The law cell over a page's end, for five-column strips of one city group on pages that follow each other.

    ``bands(doc_id, page, band_no, gun, role, nc, dept, law, law_region)``; ``law_region`` tells the merged cell a strip's
    law belongs to. Unless a known department starts the page, an empty law there is that of the page before, and two
    pieces of which the first does not end as a law does are joined on both pages. A page takes what its predecessor
    has printed; a text is not handed on over more than one page's end unless each page in between is empty."""
    law = F.coalesce("law", F.lit(""))
    ends = bands.groupBy("doc_id", "page").agg(F.min_by(F.struct("gun", "role", "nc", F.coalesce("dept", F.lit("")).alias("dept"), law.alias("law"), "law_region"), "band_no").alias("f"), F.max_by(F.struct("gun", "nc", law.alias("law"), "law_region"), "band_no").alias("l"), F.countDistinct("law_region").alias("regions"))
    w = Window.partitionBy("doc_id").orderBy("page")
    ends = ends.withColumns({"p": F.lag("l").over(w), "p_page": F.lag("page").over(w), "name": F.element_at(F.split(flat(F.col("f.dept")), r"-\d{3,}", 2), 1)})
    names = known.select(F.col("dept").alias("name")).where("name <> ''").distinct().withColumn("starts", F.lit(True))
    ends = ends.join(names, "name", "left")
    goes_on = (F.col("p_page") == F.col("page") - 1) & (F.col("f.gun") == F.col("p.gun")) & (F.col("f.role") == "city") & (F.col("f.nc") == 5) & (F.col("p.nc") == 5) & F.col("starts").isNull()
    ends = ends.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    # A page whose only merged cell is empty hands on what it was given itself.
    through = F.col("goes_on") & (F.col("f.law") == "") & (F.col("regions") == 1)
    ends = ends.withColumn("last_law", F.last(F.when(~through, F.struct(F.col("l.law").alias("v"))), ignorenulls=True).over(w)["v"])
    ends = ends.withColumn("given", F.lag("last_law").over(w))
    complete = F.lit(False)
    for e in endings:
        complete = complete | flat(F.col("given")).endswith(e)
    first = F.col("f.law")
    joins = F.col("goes_on") & (F.col("given") != "") & (first != "") & (flat(F.col("given")) != flat(first)) & ~complete
    head = F.when(F.col("goes_on") & (F.col("given") != "") & (first == ""), F.col("given")).when(joins, F.concat_ws("\n", F.rtrim("given"), F.ltrim(first)))
    ends = ends.withColumn("head", head).withColumn("joins", joins)
    ends = ends.withColumn("tail", F.when(F.lead("joins").over(w), F.lead("head").over(w)))
    marks = ends.select("doc_id", "page", "head", "tail", F.col("f.law_region").alias("_first"), F.col("l.law_region").alias("_last"))
    out = bands.join(marks, ["doc_id", "page"])
    return out.withColumn("law", F.coalesce(F.when(F.col("law_region").eqNullSafe(F.col("_last")), F.col("tail")), F.when(F.col("law_region").eqNullSafe(F.col("_first")), F.col("head")), law)).drop("head", "tail", "_first", "_last")
