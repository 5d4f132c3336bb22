"""Records given to departments, page borders and the summary table, on hand-made rows of a printed ledger."""

from landlens.operators import assembly as A

RULES = A.Rules(
    roles={"시": "city", "도": "province", "중앙": "central", "기관": "agency"}, province="도청", city="시청", agency_pattern=r"^(\S+공사)(\S+)$",
    parents=("소방본부",), prefixes=("소방서",), org_alias={"국토부": "국토교통부"}, dept_alias={"대기": "대기과"},
)
IN = "doc_id long, rec long, gun string, dept string, op string, ac string, st string, page long, law string"
FIELDS = ("org", "dept", "team", "round", "doc_no", "doc_date", "op", "page")


def assigned(spark, rows):
    known = spark.createDataFrame([("교통정책과",), ("환경과",), (None,)], "dept string")
    data = [(d, i, gun, dept, op, ac, st, i, None) for d, i, gun, dept, op, ac, st in rows]
    return {(r.doc_id, r.rec): r for r in A.assign(spark.createDataFrame(data, IN), known, RULES).collect()}


def test_assign(spark):
    rows = [
        ("시", "교통정", "a", "", "반영"), ("시", "책과-4401(2026.1.13.)", "b", "", "반영"), ("시", "책과", "c", "", "반영"), ("시", "", "d", "", "반영"),
        ("시", "환경과-7781(2026.01.08)", "(2차협의) e", "", "반영"), ("시", "-5502(2026.01.20.)", "f", "", "반영"), ("시", "소방서구조과", "g", "○", "반영"),
        ("도", "도로과", "[도로팀] h", "", "반영"), ("도", None, "i", "", "반영"), ("도", "소방본부(예방과)", "j", "", "반영"),
        ("중앙", "국토부", "[환경정책과]", "", "-"), ("중앙", "", "k", "", "반영"), ("중앙", "", "[수질과]", "", ""), ("중앙", "", "[대기] (3차협의) l", "", ""), ("중앙", "", "○", "", ""), ("중앙", "", "-", "", ""),
        ("기관", "한국수자원공사한강본부", "m", "", "반영"), ("기관", "도시공사(계획처)", "n", "", "반영"), ("기관", "교육청", "o", "", "반영"),
    ]
    got = assigned(spark, [(1, i, *r) for i, r in enumerate(rows, 1)])
    want = {
        1: ("시청", "교통정책과", "", "", "교통정책과-4401", "2026.01.13", "a", 1),
        2: ("시청", "교통정책과", "", "", "교통정책과-4401", "2026.01.13", "b", 2),
        3: ("시청", "교통정책과", "", "", "", "", "c", 3),
        4: ("시청", "교통정책과", "", "", "", "", "d", 4),
        5: ("시청", "환경과", "", "2", "환경과-7781", "2026.01.08", "e", 5),
        6: ("시청", "환경과", "", "", "환경과-5502", "2026.01.20", "f", 6),
        7: ("소방서", "구조과", "", "", "", "", "g", 7),
        8: ("도청", "도로과", "도로팀", "", "", "", "h", 8),
        9: ("도청", "도로과", "도로팀", "", "", "", "i", 9),
        10: ("소방본부", "예방과", "", "", "", "", "j", 10),
        12: ("국토교통부", "환경정책과", "", "", "", "", "k", 11),  # the row with the mark only goes before it
        13: ("국토교통부", "수질과", "", "", "", "", "", 13),  # another mark follows: stands alone
        14: ("국토교통부", "대기과", "", "3", "", "", "l", 14),
        15: ("국토교통부", "대기과", "", "3", "", "", "", 15),
        16: ("국토교통부", "대기과", "", "3", "", "", "-", 16),
        17: ("한국수자원공사", "한강본부", "", "", "", "", "m", 17),
        18: ("도시공사", "계획처", "", "", "", "", "n", 18),
        19: ("교육청", "교육청", "", "", "", "", "o", 19),
    }
    assert {rec: tuple(r[f] for f in FIELDS) for (_, rec), r in got.items()} == want
    assert got[1, 12].st == "- 반영" and got[1, 7].ac == ""


def test_assign_before_the_first_record(spark):
    got = assigned(spark, [(2, 1, "시", "", "", "", ""), (2, 2, "시", "환경과", "", "", ""), (2, 3, "시", "", "x", "", ""), (3, 1, None, None, None, None, None)])
    assert {(k, r.op, r.page, r.org) for k, r in got.items()} == {((2, 3), "x", 1, "시청"), ((3, 1), "", 1, "시청")}
    assert assigned(spark, [(4, 1, "시", "", "", "", "")])[4, 1].op == ""


def test_laws_over_pages(spark):
    rows = [  # doc, page, band, dept, law, region
        (1, 1, 1, "환경과", "주차장법 및", 1), (1, 2, 1, "", "교통영향평가", 1), (1, 2, 2, "", "교통영향평가", 1), (1, 2, 3, "", "하천법", 2),
        (1, 3, 1, "", "", 1), (1, 4, 1, "", "", 1), (1, 5, 1, "환경과-12345(2026.1.2.)", "", 1), (1, 7, 1, "", "", 1), (2, 1, 1, "", "도로법", 1), (2, 2, 1, "", "수도법", 1),
    ]
    bands = spark.createDataFrame([(d, p, b, "시", "city", 5, x, law, r) for d, p, b, x, law, r in rows], "doc_id long, page long, band_no long, gun string, role string, nc int, dept string, law string, law_region long")
    got = {(r.doc_id, r.page, r.band_no): r.law for r in A.carry_laws(bands, spark.createDataFrame([("환경과",)], "dept string"), ("법", "평가")).collect()}
    both = "주차장법 및\n교통영향평가"
    assert got == {(1, 1, 1): both, (1, 2, 1): both, (1, 2, 2): both, (1, 2, 3): "하천법", (1, 3, 1): "하천법", (1, 4, 1): "하천법", (1, 5, 1): "", (1, 7, 1): "", (2, 1, 1): "도로법", (2, 2, 1): "수도법"}


def test_summary_rows_are_reconciled(spark):
    cells = [["구분", "관계기관", "협의부서", "계", "반영", "부분", "미반영", "없음", "미회신", "비고"], ["시", "x", "환경 과", "3", "1", "-", "2", "", "0", " a  b"], ["", "y", "소 계", "3", "1", "-", "2", "", "0", ""], ["도", "", "소방본부(예방과)", "1", "1", "0", "0", "0", "1", ""], ["", "", "5개 부서", "9", "9", "9", "9", "9", "9", ""], ["short"]]
    got = A.read_summary(spark.createDataFrame([(1, i, c) for i, c in enumerate(cells)], "doc_id long, seq long, cells array<string>"), RULES).orderBy("seq").collect()
    assert [tuple(r)[2:] for r in got] == [("시", "시청", "환경과", 3, 1, 0, 2, 0, 0, "a b"), ("도", "소방본부", "예방과", 1, 1, 0, 0, 0, 1, "")]
