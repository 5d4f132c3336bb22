"""Semantics on hand-made rows, properties, files and streams."""

import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from landlens.functions import geo as G
from landlens.functions import helpers as H
from landlens.functions import text as T
from landlens.operators import ledger as L
from landlens.operators import monitor as M
from landlens.operators import spatial as S


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_titles_and_keys(spark):
    title, source = T.split_title(F.lit("A - B - Outlet"), F.lit(""))
    r = one(spark, t=title, s=source, k=T.title_key(F.lit("A b_1·가!é")), e=T.title_key(F.lit("!!")), n=T.title_key(F.lit(None).cast("string")))
    assert (r.t, r.s, r.k, r.e, r.n) == ("A - B", "Outlet", "Ab_1가é", "", "")


def test_dates(spark):
    now = F.lit("2024-06-15 10:00:00").cast("timestamp_ntz")
    w = lambda raw, tip="": T.parse_when(F.lit(raw), F.lit(tip), now)
    r = one(spark, a=w("2026년 9월 2일 수요일 오후 6:02"), b=w("8월 26일"), c=w("3일"), d=w("x", "2026.08.26"), e=w("13월 45일"), f=w("6월 15일 오전 12:05"), g=w("어제"))
    assert (r.a.date, r.a.iso, r.a.exact) == ("2026-09-02", "2026-09-02T18:02+09:00", True)
    assert r.b.date == "2023-08-26" and r.c.date == "2024-06-12" and not r.c.exact and r.d.date == "2026-08-26"
    assert r.e.date == "2024-05-01" and not r.e.exact  # no such day; "45일" then reads as 45 days ago
    assert r.f.iso == "2024-06-15T00:05+09:00" and r.g.date == "2024-06-14"
    r = one(spark, a=T.kst_date(F.lit("2024-01-01T16:00:00Z")), b=T.kst_date(F.lit("2024-01-01T16:00:00")), c=T.kst_date(F.lit("nonsense here")), d=T.rfc822_date(F.lit("Mon, 01 Jan 2024 16:30:00 GMT")), e=T.rfc822_date(F.lit("soon")))
    assert tuple(r) == ("2024-01-02", "2024-01-01", "nonsense h", "2024-01-02", "")


def test_helpers(spark):
    d = spark.createDataFrame([("A &amp; B", "é", "한글", bytearray("한글".encode("cp949")))], "a string, b string, c string, d binary")
    r = d.select(H.html_unescape("a").alias("a"), H.nfc("b").alias("b"), H.decode_bytes("d").alias("d"), H.longest_common_excerpt(F.lit("the quick brown"), F.lit("see the quick brown fox")).alias("x")).first()
    assert tuple(r) == ("A & B", "é", "한글", "see the quick brown fox")


def test_unwrap(spark):
    got = one(spark, x=T.unwrap_lines(F.lit("○ first line\ncontinued. \nnew one\n가나\n다라\n- bullet\nabc\ndef"))).x
    assert got == ["○ first line continued.", "new one가나다라", "- bullet abc def"]


def test_news_dedup_is_idempotent_and_order_free(spark):
    rng = random.Random(2)
    rows = [(f"title {rng.randrange(20)}", "d", f"q{i % 3}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "title string, desc string, query string, seq long")
    a = M.news_dedup(df)
    once = {(r.key, r.seq) for r in a.collect()}
    assert once == {(r.key, r.seq) for r in M.news_dedup(a.drop("key")).collect()}
    mixed = spark.createDataFrame(rng.sample(rows, len(rows)), df.schema).repartition(8)
    assert once == {(r.key, r.seq) for r in M.news_dedup(mixed).collect()}


def fold_posts(rows):
    """The plain fold that the closed form replaces."""
    state = {}
    for p in rows:
        base = f"{p['platform']}:{p['url']}" if p["url"] else "t:" + p["text"]
        key = base
        if base in state and p["exact"] and p["date"] and state[base]["anchor"] and state[base]["anchor"] != p["date"]:
            key = f"{base}@{p['date']}"
        s = state.setdefault(key, {"anchor": None, "text": "", "date": "", "exact": False, "n": 0})
        s["anchor"] = s["anchor"] or (p["date"] if p["exact"] and p["date"] else None)
        s["n"] += 1
        if len(p["text"]) > len(s["text"]):
            s["text"] = p["text"]
        if p["exact"] and p["date"] and not s["exact"]:
            s["date"], s["exact"] = p["date"], True
        elif p["date"] and not s["date"]:
            s["date"] = p["date"]
    return {k: (v["text"], v["date"], v["exact"], v["n"]) for k, v in state.items()}


def test_post_merge_equals_the_fold(spark):
    rng = random.Random(7)
    rows = [{"platform": "web", "account": "a", "author": "", "role": "", "url": f"u{rng.randrange(12)}", "text": "x" * rng.randrange(1, 9), "date": rng.choice(["2024-01-01", "2024-01-02", "2024-01-03", ""]), "exact": rng.random() < 0.5, "seq": i} for i in range(600)]
    for r in rows:
        r["exact"] = r["exact"] and r["date"] != ""
    df = spark.createDataFrame(rows, "platform string, account string, author string, role string, url string, text string, date string, exact boolean, seq long")
    got = {r.key: (r.text, r.date, r.exact, r.n) for r in M.merge_posts(M.resolve_keys(df)).collect()}
    assert got == fold_posts(rows)


def test_portal_merge_keeps_old_fields(spark):
    s = "id string, title string, kwds array<string>, seq long"
    got = {r.id: r for r in M.portal_merge(spark.createDataFrame([("a", "old", ["z"], 5)], s), spark.createDataFrame([("a", "new", ["b"], 1), ("c", "c1", ["k"], 2), ("c", "c2", ["j", "k"], 3)], s)).collect()}
    assert (got["a"].title, got["a"].kwds, got["a"].added) == ("old", ["b", "z"], False)
    assert (got["c"].title, got["c"].kwds, got["c"].added) == ("c1", ["j", "k"], True)


def test_annotation_mismatch_stops_the_job(spark):
    rows = spark.createDataFrame([(1, "Roads", "widen it")], "no long, dept string, opinion string")
    bad = spark.createDataFrame([(1, "Parks", "widenit", "x")], "no long, dept string, opinion20 string, note_add string")
    with pytest.raises(Exception, match="does not fit"):
        L.annotate_guarded(rows, bad).collect()


def test_tm_round_trip_and_areas(spark):
    tm = G.TransverseMercator(127.0, 38.0)
    pts = spark.createDataFrame([(126.5 + 0.1 * i, 36.0 + 0.15 * i) for i in range(10)], "lng double, lat double")
    e, n = tm.forward(F.col("lng"), F.col("lat"))
    back = pts.select("lng", "lat", e.alias("e"), n.alias("n"))
    lng, lat = tm.inverse(F.col("e"), F.col("n"))
    for r in back.select("lng", "lat", lng.alias("a"), lat.alias("b")).collect():
        assert math.hypot((r.a - r.lng) * 89000, (r.b - r.lat) * 111000) < 1e-3
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))])
    flipped = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), (-p["y"]).alias("y")))
    r = one(spark, a=G.ring_area(ring), f=G.ring_area(flipped), p=G.ring_perimeter(ring), i=G.in_ring(F.lit(1.0), F.lit(1.0), ring), o=G.in_ring(F.lit(1.0), F.lit(1.0), flipped))
    assert (r.a, r.f, r.p, r.i, r.o) == (12.0, 12.0, 14.0, True, False)


def test_pyramid_keeps_the_mean(spark):
    cells = spark.createDataFrame([(1, r, c, float(r * 8 + c)) for r in range(8) for c in range(8)], "raster_id long, row long, col long, v double")
    up = S.halve(cells, 8, 8)
    assert up.count() == 16 and abs(up.agg(F.avg("v")).first()[0] - 31.5) < 1e-9


def test_files_round_trip(spark, tmp_path):
    from landlens.sources import files

    (tmp_path / "store.json").write_text('{"updated": "x", "items": {"infolist": [{"id": "1"}], "orginl": [{"id": "2"}, {"id": "3"}]}}')
    got = files.read_nested_store(spark, str(tmp_path / "store.json"), "id string", ("infolist", "orginl"))
    assert sorted((r.kind, r.id) for r in got.collect()) == [("infolist", "1"), ("orginl", "2"), ("orginl", "3")]
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"use":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}},{"properties":{"use":"b"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}}]}')
    assert [len(r.polys) for r in files.read_geojson(spark, str(tmp_path / "g.geojson"), "use string").orderBy("feature_id").collect()] == [1, 2]
    rows = spark.createDataFrame([(1, 'say "hi"', ["a", "b"])], "no long, text string, lines array<string>")
    files.write_csv_quoted(rows.drop("lines"), str(tmp_path / "q"))
    assert '"1","say ""hi"""\r\n' in "".join(p.read_bytes().decode() for p in (tmp_path / "q").glob("*.csv"))
    files.write_csv_minimal(rows, str(tmp_path / "m"))
    files.write_snapshot(rows, str(tmp_path / "snap"), "2024-01-01")
    assert spark.read.json(str(tmp_path / "snap/meta")).first().total == 1
    s = files.status(rows, "k", "t", "u", {"rows": (F.count("*"), "n")}).first()
    assert s.metrics[0].value == 1
    (tmp_path / "p.csv").write_text("지번,lat,lng,비고\n1-2,37.1,127.2,x\n")
    assert files.read_points_csv(spark, str(tmp_path / "p.csv")).first().lat == 37.1


def test_custom_feed(spark):
    from landlens.sources.custom_feed import CustomFeed

    spark.dataSource.register(CustomFeed)
    got = spark.read.format("custom_feed").option("module", "landlens.sources.example_feed").option("accounts", "a,b").load()
    assert sorted((r.account, r.text) for r in got.collect()) == [("a", "hello from a"), ("b", "hello from b")]


def test_streams_equal_batch(spark, tmp_path):
    from landlens.streaming import jobs

    schema = "title string, desc string, query string, seq long"
    rows = [(f"title {i % 7}", "d", "q", i) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    jobs.inc_news(stream, str(tmp_path / "archive"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "archive")).collect()) == sorted(r.key for r in M.news_dedup(spark.createDataFrame(rows, schema)).collect())


def test_a_repeated_news_batch_changes_nothing(spark, tmp_path):
    from landlens.streaming import jobs

    schema, path = "title string, desc string, query string, seq long", str(tmp_path / "archive")
    put, seen = jobs.news_batch(path), lambda: sorted((r.key, r.seq) for r in spark.read.parquet(path).collect())
    one = spark.createDataFrame([("first item", "d", "q", 1), ("second item", "d", "q", 2)], schema)
    two = spark.createDataFrame([("second item", "d", "q", 3), ("third item", "d", "q", 4)], schema)
    put(one, 0)
    put(two, 1)
    want = [("firstitem", 1), ("seconditem", 2), ("thirditem", 4)]
    assert seen() == want
    put(two, 1)  # the stream was stopped between write and commit
    put(two, 1)
    assert seen() == want


def test_rescan_drops_repeats_in_a_stream(spark, tmp_path):
    from landlens.streaming import jobs

    rows = [("a", datetime(2024, 1, 1, tzinfo=timezone.utc)), ("a", datetime(2024, 1, 9, tzinfo=timezone.utc)), ("b", datetime(2024, 1, 2, tzinfo=timezone.utc))]
    spark.createDataFrame(rows, "id string, produced timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id string, produced timestamp").parquet(str(tmp_path / "in"))
    jobs.portal_rescan(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_values_worked_out_by_hand(spark):
    """Expected values follow the rules as written down, not the code."""
    from landlens.operators import ledger as L

    lit = F.lit
    r = one(
        spark, a=T.kst_date(lit("2024-01-01T20:00:00+0000")), b=T.kst_date(lit("2024-01-01T20:00:00+09")), c=T.feed_when(lit("Mon, 01 Jan 2024 16:30:00 +0900")), d=T.feed_when(lit("Mon, 1 Jan 2024 16:30 GMT")), e=T.feed_when(lit("someday soon")), f=T.feed_when(lit("Tue, 02 Jan 2024 01:00:00 -0000")),
        g=T.mask_name(lit(" 김철수 ")), h=T.mask_name(lit(" 김 ")), i=T.doc_numbers(lit("환경과-7781(2026.01.08)")), j=T.doc_numbers(lit("도로과 -1234 （2026. 1. 8.）\n건축과-99(2026.1.9) 주택과-4321 2026.1.10")), k=T.doc_numbers(lit("총무과(2차 협의)")),
        t=F.array(*[L.trivial(lit(x)) for x in ("검토의견 없음", "이상 없음", "별도의견 없음", "미회신", "· 의견없음", "○ 해당 사항 없음", "특이사항없음", "의견 있음")]),
        m=F.array(*[T.html_published(lit(f'<meta property="article:published_time" content="{x}">')) for x in ("20240105", "2024.01.05", "2024/01/05T10:00", "2024-01-05", "soon")]),
        s=T.html_summary(lit('<meta name="description" content="A &amp; B  &lt;c&gt;">')),
    )
    assert (r.a, r.b) == ("2024-01-02", "2024-01-01")
    assert tuple(r.c) == ("2024-01-01", "2024-01-01T16:30:00+09:00", True) and tuple(r.d) == ("2024-01-02", "2024-01-01T16:30:00+00:00", True)
    assert tuple(r.e) == ("someday so", "someday soon", True) and tuple(r.f) == ("2024-01-02", "2024-01-02T01:00:00", True)
    assert (r.g, r.h) == ("김○○", "김")
    assert tuple(r.i) == ("환경과", "환경과-7781", "2026.01.08") and tuple(r.j) == ("도로과", "도로과-1234 ; 주택과-4321", "2026.01.08 ; 2026.01.10") and tuple(r.k) == ("총무과", "", "")
    assert r.t == [True] * 6 + [False] * 2 and r.m == ["2024-01-05"] * 4 + [""] and r.s == "A & B <c>"


def test_strips_by_department_mark_and_holding(spark):
    from landlens.operators import ledger as L

    rows = [
        ("g", "[환경과] 첫 의견", "조치", "반영"), ("g", "이어지는 의견", "", ""), ("g", "[붙임 1] 자료", "", ""), ("g", "[도로과]", "", ""), ("g", "○ 둘째 의견", "", ""), ("g", "○", "", "미반영"), ("g", "[건축과] 셋째", "조치 3", ""), ("g", "", "조치 계속", ""),
        ("g", "-", "", ""), ("g", "○ 넷째", "a", "반영"), ("h", "○ 다른 군", "", ""), ("i", "○ 또 다른 군", "b", ""),
    ]
    bands = spark.createDataFrame([(1, i, g, 1, "", "", o, a, s) for i, (g, o, a, s) in enumerate(rows)], "doc_id long, band_no long, gun string, page int, dept string, law string, op string, ac string, st string")
    records = L.stitch(bands)
    got = [(r.op, r.ac, r.st) for r in records.orderBy("rec").collect()]
    assert got[0] == ("[환경과] 첫 의견\n이어지는 의견\n[붙임 1] 자료", "조치", "반영") and got[1:4] == [("[도로과]", "", ""), ("○ 둘째 의견", "", ""), ("○", "", "미반영")]
    assert got[4] == ("[건축과] 셋째\n-", "조치 3\n조치 계속", "") and len(got) == 8
    held = [(r.op, r.st) for r in L.forward_hold(records).orderBy("rec").collect()]
    assert held == [(got[0][0], "반영"), ("[도로과]\n○ 둘째 의견\n○", "미반영"), (got[4][0], ""), ("○ 넷째", "반영"), ("○ 다른 군", ""), ("○ 또 다른 군", "")]


def test_a_feed_entry_has_title_and_description(spark):
    from landlens.sources import files

    rss = "<rss><channel><item><title>Head</title><link>l</link><description>&lt;b&gt;Body&lt;/b&gt;</description><pubDate>Mon, 01 Jan 2024 20:00:00 +0900</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="m"><entry><title>Clip</title><link href="h"/><published>2024-01-01T20:00:00Z</published><media:group><media:description>about it</media:description></media:group></entry></feed>'
    got = files.parse_feeds(spark.createDataFrame([(1, rss), (2, atom)], "id long, raw string")).orderBy("id").collect()
    assert [(r.text, r.when.date, r.when.exact) for r in got] == [("Head Body", "2024-01-01", True), ("Clip about it", "2024-01-02", True)]


def chained(segments):
    """Lines by walking from side to side."""
    at = {}
    for r in segments:
        for u, v, p, q in ((r.a_side, r.b_side, (r.ax, r.ay), (r.bx, r.by)), (r.b_side, r.a_side, (r.bx, r.by), (r.ax, r.ay))):
            at.setdefault((r.raster_id, r.level, u), []).append((v, p, q))
    used, out = set(), {}
    for start in sorted(at, key=lambda k: (len(at[k]) != 1, k)):
        for v, p, q in sorted(at[start], key=lambda x: x[0])[:1]:
            if start in used:
                continue
            line, before, here = [p, q], start[2], v
            used |= {start, (*start[:2], v)}
            while here != start[2]:
                on = [x for x in at[(*start[:2], here)] if x[0] != before]
                if not on:
                    break
                before, here = here, on[0][0]
                line.append(on[0][2])
                used.add((*start[:2], here))
            if len(line) >= 3:
                out[start[0], start[1], "/".join(map(str, start[2]))] = (line, here == start[2])
    return out


def test_contours_are_chained_like_a_walk(spark):
    rng = random.Random(6)
    rows = [(1, r, c, float(c >= 2)) for r in range(41) for c in range(4)] + [(2, r, c, float(max(abs(r - 9), abs(c - 9)) < 6)) for r in range(20) for c in range(20)]
    rows += [(3, r, c, rng.random()) for r in range(30) for c in range(30)] + [(4, r, c, float(rng.randrange(3)) / 2) for r in range(20) for c in range(20)]
    seg = S.contour_segments(spark.createDataFrame(rows, "raster_id long, row long, col long, v double"), (0.5,))
    got = {}
    for r in S.chain_segments(seg).orderBy("raster_id", "level", "line", "place").collect():
        line, n, closed = got.setdefault((r.raster_id, r.level, r.line), ([], r.n, r.closed))
        assert r.place == len(line) and (r.n, r.closed) == (n, closed)
        line.append((r.x, r.y))
    assert all(len(line) == n for line, n, _ in got.values())
    want = chained(seg.collect())
    assert {k: (v[0], v[2]) for k, v in got.items()} == want and {True, False} == {v[1] for v in want.values()}
    assert [v[1] for k, v in got.items() if k[0] == 1] == [41]
    assert S.chain_segments(seg.limit(0)).count() == 0


def test_affine_fit_finds_the_planted_map(spark):
    import math

    k, turn = 5000.0, math.radians(0.35)
    a, b = k * math.cos(turn), k * math.sin(turn)
    rows = []
    for i in range(200):
        x, y = (i * 37 % 101) / 100, (i * 53 % 97) / 100
        off = 400.0 if i % 12 == 0 else (i % 7 - 3) / 2
        rows.append((x, y, a * x + b * y + 100 + off, -b * x + a * y + 200 - off))
    r = S.affine_ransac(spark.createDataFrame(rows, "px double, py double, gx double, gy double")).first()
    assert r.kept == 183 and abs(r.scale / k - 1) < 0.001 and abs(r.rotation - 0.35) < 0.02 and r.worst < 3
    assert S.affine_ransac(spark.createDataFrame([], "px double, py double, gx double, gy double")).count() == 0


def test_coverage_equals_counting_grams(spark, monkeypatch):
    from landlens.operators import evidence as E

    docs = [(i, t) for i, t in enumerate(["the quick brown fox", "", "a", "quick brown dogs", "the quick brown fox", "zz", None, "한글 문서입니다"])]
    ops = [(1, "quick brown fox"), (2, "zz"), (3, ""), (4, "문서입니다"), (5, "nothing@all")]
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))} if t else set()
    got = {r.opinion_id: (r.doc_id, r.score) for r in E.coverage(spark.createDataFrame(ops, "opinion_id long, norm string"), spark.createDataFrame(docs, "doc_id long, norm string")).collect()}
    want = {}
    for o, t in ops:
        if t:
            n, d = max(((len(grams(t) & grams(x)), -i) for i, x in docs), default=(0, None))
            want[o] = (-d if n else None, round(n / len(grams(t)), 6))
    assert got == want
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("aaabbcd") for _ in range(n))
    docs = [(i, f"k{i % 3}" if i % 11 else None, text(rng.randrange(80))) for i in range(150)]
    ops = [(i, f"k{i % 4}", docs[i][2][5:40] + text(10)) for i in range(30)]
    o, d = spark.createDataFrame(ops, "opinion_id long, key string, norm string"), spark.createDataFrame(docs, "doc_id long, key string, norm string")
    for rows in (E.BROADCAST_ROWS, 0):
        monkeypatch.setattr(E, "BROADCAST_ROWS", rows)
        for keys in ([], ["key"]):
            got = {r.opinion_id: (r.doc_id, r.score) for r in E.coverage(o, d, keys).collect()}
            for i, k, t in ops:
                n, j = max(((len(grams(t) & grams(x)), -i) for i, kk, x in docs if not keys or kk == k), default=(0, None))
                assert got[i] == (-j if n else None, round(n / len(grams(t)), 6))


def test_portal_state_is_an_upsert_also_when_a_batch_is_repeated(spark, tmp_path):
    from landlens.streaming import jobs

    rows = lambda *r: spark.createDataFrame(list(r), "id string, title string, kwds array<string>, seq long")
    run = jobs.portal_batch(str(tmp_path / "portal"))
    first, second = rows(("a", "old", ["x"], 2), ("a", "older", ["w"], 1), ("b", "b", None, 3)), rows(("a", "new", ["y", "x"], 1), ("c", "c", ["z"], 2))
    for batch, i in ((first, 0), (second, 1), (second, 1), (first, 0)):
        run(batch, i)
    got = {r.id: (r.title, r.kwds, r.added) for r in jobs.portal_state(spark, str(tmp_path / "portal")).collect()}
    assert got["a"] == ("older", ["w", "x", "y"], False) and got["c"] == ("c", ["z"], True) and got["b"][0] == "b" and not got["b"][2]


def test_portal_upsert_as_a_stream(spark, tmp_path):
    from landlens.streaming import jobs

    schema = "id string, title string, kwds array<string>, seq long"
    for title in ("first", "second"):
        spark.createDataFrame([("a", title, [title], 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.portal_upsert(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = jobs.portal_state(spark, str(tmp_path / "out")).collect()
    assert [(r.id, r.title, r.kwds, r.added) for r in got] == [("a", "first", ["first", "second"], False)]
