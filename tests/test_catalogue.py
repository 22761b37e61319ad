"""Cases of the catalogue operators: inputs and the facts expected of them."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import aliases, changes, classify, merge, ordered, search, validate
from lodestone.sources import html_sources, json_sources, sinks
from lodestone.streaming import arrivals

COLS = "seq long, id string, source_url string, title_primary string, title_ko string, artist_primary string, artist_ko string, artist_aliases array<string>, tj string, ky string, joysound string, categories array<string>, crawled_at string, media_context_ko string, title_ko_source string, title_ko_confidence string"


def record(seq, id, title="Song", artist="Singer", **more):
    row = {c.split()[0]: None for c in COLS.split(", ")}
    return row | {"seq": seq, "id": id, "source_url": f"http://x/{id}", "title_primary": title, "artist_primary": artist, "categories": ["jpop"], "crawled_at": "2026-01-01T00:00:00Z"} | more


def frame(spark, rows):
    names = [c.split()[0] for c in COLS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLS).repartition(3)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def parts(spark, value):
    return text.split_collab(spark.createDataFrame([(value,)], "x string"), "x").first().parts


@pytest.mark.parametrize(("value", "identity", "match"), [("Ｉｄｏｌ℡", "idoltel", "idolTEL"), ("ﾊﾟﾌﾟﾘｶ!", "パプリカ", "パプリカ!"), (" A　B﻿c ", "abc", "abc"), ("", "", ""), (None, None, None), ("Café-2", "café2", "café-2")])
def test_keys(spark, value, identity, match):
    assert one(spark, value, text.identity_key) == identity
    assert one(spark, value, text.match_key) == match


def test_collab_parts(spark):
    assert parts(spark, "imase & なとり") == ["imase & なとり", "imase", "なとり"]
    assert parts(spark, "MAX(Feat.Huh Yunjin of LE SSERAFIM)") == ["MAX(Feat.Huh Yunjin of LE SSERAFIM)", "MAX", "Huh Yunjin of LE SSERAFIM", "Huh Yunjin", "LE SSERAFIM"]
    assert parts(spark, "Bump of Chicken") == ["Bump of Chicken"]
    assert parts(spark, "椎名もた｜ぽわぽわP") == ["椎名もた｜ぽわぽわP", "椎名もた", "ぽわぽわP"]
    assert parts(spark, "A with B meets C FEAT. D") == ["A with B meets C FEAT. D", "A", "B", "C", "D"]
    assert parts(spark, "  ") == [] and parts(spark, "A, a") == ["A, a", "A"]
    lead = text.split_collab(spark.createDataFrame([("Ａ (Feat. B)",), ("YOASOBI",), ("",)], "x string"), "x").select(text.lead(F.col("parts")).alias("l"))
    assert [r.l for r in lead.collect()] == ["a", "yoasobi", ""]


def test_small_functions(spark):
    assert one(spark, "x (애니 OP) y (OST) (드라마 OST)", text.media_context) == "(애니 OP) (드라마 OST)"
    assert one(spark, "no", text.media_context) is None
    assert one(spark, "12 4999 .5001 52001 68888 a", text.anchor) == "68888" and one(spark, "123456 1.5001", text.anchor) is None
    for cats, want in ((["jpop", "vocaloid"], ["vocaloid"]), (["jpop", "anime"], ["anime"]), (["x", "jpop"], ["jpop", "x"]), ([], [])):
        df = spark.createDataFrame([(cats,)], "c array<string>")
        assert df.select(text.exclusive(F.col("c")).alias("y")).first().y == want
    cell = lambda v, n=6: spark.createDataFrame([(v,)], "c array<string>").select(text.number_cell(F.col("c"), n).alias("y")).first().y
    assert cell(["12345"]) == "12345" and cell(["1", "2"]) is None and cell(["-"]) is None and cell(["1234567"]) is None and cell([" ", " 77 "]) == "77"


def merged(spark, rows):
    clustered = merge.clusters(frame(spark, rows))
    return {r.cluster: r for r in merge.merge(clustered).collect()}, merge.conflicts(clustered).collect()


def test_tier_a_ownership(spark):
    rows = [
        record(0, "blog-1-0", "B title", "B artist", tj="100", title_ko="비", artist_ko="블", crawled_at="2026-01-02T00:00:00Z", title_ko_source="blog"),
        record(1, "namu-2", "N title", "N artist", tj="100", ky="7", title_ko="나"),
        record(2, "tj-3", "T title", "T artist", ky="7", joysound="9", categories=["anime"], title_ko="티", title_ko_source="llm-translated", title_ko_confidence="high"),
        record(3, "tj-4", "Other", "Else", ky="100"),
    ]
    got, found = merged(spark, rows)
    assert set(got) == {0, 3} and not found
    m = got[0]
    assert (m.id, m.title_primary, m.artist_primary, m.title_ko, m.artist_ko) == ("blog-1-0", "T title", "T artist", "비", "블")
    assert (m.tj, m.ky, m.joysound, m.categories, m.crawled_at) == ("100", "7", "9", ["anime"], "2026-01-02T00:00:00Z")
    assert (m.title_ko_source, m.title_ko_confidence, m.tier) == ("blog", None, "A")


def test_tier_b_and_its_conflicts(spark):
    rows = [record(0, "blog-1-0", "Ｓong!", tj="1"), record(1, "tj-2", "song", tj="2"), record(2, "x-3", "", ""), record(3, "x-4", "!", "?")]
    got, found = merged(spark, rows)
    assert set(got) == {0, 2} and got[0].tj == "1" and got[2].tier == "B"
    assert [(c.cluster_key, c.field, c.winner, [(v.source, v.value) for v in c["values"]]) for c in found] == [("song|singer", "tj", "1", [("blog", "1"), ("tj", "2")])]


def gate(spark, *rows):
    got, found = merged(spark, [record(i, id, "IDOL", artist, categories=[cat]) for i, (id, artist, cat) in enumerate(rows)])
    return len(got), [c.field for c in found]


def test_tier_c_gate(spark):
    feat = "A(Feat.B)"
    assert gate(spark, ("blog-1-0", "A", "jpop"), ("tj-2", feat, "jpop")) == (1, ["tier_c_merge"])
    assert gate(spark, ("tj-1", "A", "jpop"), ("tj-2", feat, "jpop")) == (2, [])
    assert gate(spark, ("tj-1", "A", "vocaloid"), ("tj-2", feat, "vocaloid")) == (1, ["tier_c_merge"])
    assert gate(spark, ("tj-1", "A(Feat.C)", "vocaloid"), ("tj-2", feat, "vocaloid")) == (2, [])
    assert gate(spark, ("tj-1", "A", "vocaloid"), ("tj-2", feat, "vocaloid"), ("tj-3", "A(Feat.C)", "vocaloid")) == (3, [])


def test_lone_record_of_no_owner_loses_its_provenance(spark):
    got, _ = merged(spark, [record(0, "tjpdf-1", title_ko="가", title_ko_source="llm-translated", title_ko_confidence="low")])
    assert (got[0].title_ko, got[0].title_ko_source, got[0].title_ko_confidence) == ("가", None, None)


def test_merge_is_deterministic_and_ordered(spark):
    rows = [record(i, f"{'blog' if i % 2 else 'tj'}-{i}", f"T{i % 5}", f"S{i % 3}", tj=str(i % 7) if i % 4 else None, artist_aliases=[f"a{i % 3}", f"S{i % 3}"]) for i in range(40)]
    first = merge.merge(merge.clusters(frame(spark, rows)))
    again = merge.merge(merge.clusters(frame(spark, rows[::-1]).repartition(7)))
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    tj = [r.tj for r in merge.ordered(first).collect()]
    assert tj == sorted([x for x in tj if x is not None]) + [None] * tj.count(None)
    assert merge.summary(merge.conflicts(merge.clusters(frame(spark, rows)))).count() == 1


def test_aliases(spark):
    rows = [
        record(0, "blog-1-0", artist="スピッツ｜Spitz"), record(1, "tj-1", artist="spitz"), record(2, "tj-2", artist="スピッツ"),
        record(3, "blog-2-0", artist="X｜Y"), record(4, "blog-3-0", artist="Z｜Y"), record(5, "tj-3", artist="Y"),
        record(6, "tj-4", artist="｜"), record(7, "tj-5", artist="Luna Sea"),
    ]
    out, clash = aliases.resolve(frame(spark, rows))
    got = {r.seq: (r.artist_primary, r.artist_aliases) for r in out.collect()}
    assert got[0] == ("スピッツ", ["Spitz"]) and got[1] == ("スピッツ", ["spitz", "Spitz"]) and got[2] == ("スピッツ", ["Spitz"])
    assert got[3] == ("X", ["Y"]) and got[5] == ("Y", None) and got[6] == ("｜", None) and got[7] == ("Luna sea", ["Luna Sea"])
    assert {(r.alias, tuple(r.canonicals), r.affected) for r in clash.collect()} == {("Y", ("X", "Z"), 1), ("｜", (), 1)}


@pytest.mark.parametrize(("jpn", "kor", "want"), [(2, 0, "UNKNOWN"), (3, 0, "JPN"), (3, 2, "UNKNOWN"), (4, 2, "UNKNOWN"), (7, 3, "JPN"), (0, 3, "KOR"), (3, 7, "KOR"), (3, 3, "AMBIGUOUS"), (5, 3, "AMBIGUOUS"), (0, 0, "UNKNOWN")])
def test_verdicts(spark, jpn, kor, want):
    assert spark.range(1).select(classify.verdict(F.lit(jpn), F.lit(kor), F.lit(0)).alias("v")).first().v == want


def test_chain_order_and_state(spark):
    df = spark.createDataFrame([(["bts"], "JPN", "JPN", True), (["a"], "KOR", "JPN", True), (["a"], None, "JPN", False), (["a"], "JPN", None, False), (["a"], None, None, True), (["a"], None, None, False)], "k array<string>, p string, l string, w boolean")
    v, s = classify.chain(classify.admit_steps(F.col("k"), F.col("p"), F.col("l"), F.col("w")))
    assert [tuple(r) for r in df.select(v, s).collect()] == [("reject", "drop_list"), ("reject", "pro_kor"), ("admit", "artist"), ("admit", "pro"), ("admit", "rescue"), ("drop", None)]
    now = F.lit("2026-04-01T00:00:00Z").cast("timestamp")
    state = spark.createDataFrame([("a", "old", "2026-01-01T00:00:00Z"), ("b", "new", "2026-01-01T00:00:01Z"), ("c", "bad", None)], "k string, v string, last_seen string").withColumn("last_seen", F.expr("try_to_timestamp(last_seen)"))
    come = spark.createDataFrame([("a", "fetched"), ("b", "fetched"), ("d", "fetched")], "k string, v string").withColumn("last_seen", now)
    assert {r.k: r.v for r in classify.refresh(state, come, "k", now, 90).collect()} == {"a": "fetched", "b": "new", "c": "bad", "d": "fetched"}
    for name, ok in (("YOASOBI", True), ("米津玄師", False), ("Aimer愛", False), ("いきもの係", True), ("아이유", False), ("", False)):
        assert one(spark, name, classify.admits_to_whitelist) == ok


def test_search(spark):
    rows = spark.createDataFrame([("1", "夜に駆ける", "YOASOBI", ["ZUTOMAYO"]), ("2", "アイドル", "YOASOBI", None), ("3", "ゴーストルール", "DECO*27", ["40meterP"])], "id string, title string, artist string, alias array<string>")
    index = search.postings(rows, "id", ["title", "artist", "alias"]).cache()
    ids = lambda *q: {r.id for r in search.search(index, q).collect()}
    assert ids("yoasobi") == {"1", "2"} and ids("yoaso") == {"1", "2"} and ids("yoasoby") == {"1", "2"} and ids("deco") == {"3"} and ids("zutomayo") == {"1"} and ids("40meterp") == {"3"} and ids("nobody") == set()
    assert [r.id for r in search.top(search.search(index, ["アイドル"]), 1).collect()] == ["2"]


def test_changes(spark):
    rows = spark.createDataFrame([(1, "k1", "a", "x"), (2, "k1", "b", "y"), (3, None, "c", "z")], "seq long, k string, v string, w string")
    new = spark.createDataFrame([(9, "k1", "B", "Q"), (10, "k2", "N", "Q"), (11, "k2", "M", "Q")], "seq long, k string, v string, w string")
    assert sorted(map(tuple, changes.upsert(rows, new, "k", ["v"], "seq").collect()), key=str) == sorted([(1, "k1", "a", "x"), (2, "k1", "B", "y"), (3, None, "c", "z"), (10, "k2", "N", "Q")], key=str)
    songs = spark.createDataFrame([("1", "神", None, None, None), ("2", "b", None, "manual", None), ("3", "c", None, None, None)], "id string, title string, ko string, src string, conf string")
    told = spark.createDataFrame([("1", "神", "신", "high"), ("2", "b", "비", "low"), ("3", "other", "씨", "low"), ("4", "d", "디", "low")], "id string, title string, ko string, conf string")
    got = {r.id: (r.ko, r.src, r.applied) for r in changes.apply_decisions(songs, told, "id", "title", "ko", "src", "conf").collect()}
    assert got == {"1": ("신", "llm-translated", True), "2": (None, "manual", False), "3": (None, None, False)}
    assert {r.id: r.outcome for r in changes.manual_fixes(songs, told, "id", "title", "ko").collect()} == {"1": "applied", "2": "applied", "3": "mismatch", "4": "not_found"}
    posts = spark.createDataFrame([("blog-101-3", ["vocaloid"]), ("blog-101-4", ["anime"]), ("blog-7-1", ["vocaloid"])], "id string, c array<string>")
    assert [r.y for r in posts.select(changes.retag(F.col("id"), F.col("c")).alias("y")).collect()] == [["jpop"], ["anime"], ["vocaloid"]]
    assert changes.replay_gate(rows, rows).first().verdict == "no-op" and changes.replay_gate(rows, new.union(rows)).first().verdict == "fatal"


def test_ordered(spark):
    rows = spark.createDataFrame([(i, "b" if i % 3 else "a") for i in range(1000)], "i long, k string").repartition(5)
    assert sorted((r.i, r.number, r.chunk) for r in ordered.chunked(rows, ["i"], 300).collect()) == [(i, i, i // 300) for i in range(1000)]
    assert sorted(map(tuple, ordered.keep_first(rows, ["k"], ["i"]).collect())) == [(0, "a"), (1, "b")]
    left = spark.createDataFrame([("x", 1, 10), ("x", 2, 50)], "g string, id long, p long")
    right = spark.createDataFrame([("x", 5, 4), ("x", 6, 16), ("y", 7, 10), ("x", 8, 63)], "g string, id long, p long")
    assert [tuple(r) for r in ordered.nearest_within(left, right, ["g"], "p", 12).collect()] == [(1, 5, 6)]


def test_json_sources(spark, tmp_path):
    item = {"pro": 12345, "indexTitle": "t", "indexSong": "a", "subTitle": ""}
    flat, buckets = {"resultCode": "99", "resultData": {"items": [item, {"pro": "1"}]}}, {"resultCode": "99", "resultData": [{"items1TotalCount": 1, "items1": [item]}, {"items2": [item | {"pro": "9"}]}]}
    raw = lambda d: spark.createDataFrame([(json.dumps(d),)], "j string")
    got = lambda d, **k: [r.pro for r in json_sources.items(json_sources.envelope_items(raw(d), "j", **k)).orderBy("pos").collect()]
    assert got(flat, tolerate=False) == ["12345"] and got(buckets, tolerate=False) == ["12345", "9"]
    assert got({"resultCode": "98", "resultData": ""}, tolerate=False) == [] and got({"resultCode": "99", "resultData": ""}, tolerate=True) == []
    for bad in ({"resultCode": "50"}, {"resultCode": "99", "resultData": ""}):
        with pytest.raises(Exception, match="result code|unknown shape"):
            got(bad, tolerate=False)
    assert json_sources.catalog_items(raw(flat), "j").count() == 2
    cache = raw({"m": {"a": {"x": 1}, "b": 5}})
    assert [r.key for r in json_sources.cache_entries(cache, "j", "m").collect()] == ["a"] and json_sources.cache_entries(raw("oops"), "j", "m").count() == 0
    rec = {"id": "tj-1", "title_primary": "T", "karaoke_numbers": {"tj": "1", "ky": None, "joysound": None}, "categories": ["jpop"], "title_ko": None}
    (tmp_path / "r.json").write_text(json.dumps([rec, rec | {"id": "tj-2"}]))
    read = json_sources.read_records(spark, str(tmp_path / "r.json"))
    assert [(r.seq, r.id, r.tj) for r in read.orderBy("seq").collect()] == [(0, "tj-1", "1"), (1, "tj-2", "1")]
    n = sinks.write_json_array(read.select("id", "title_ko", "media_context_ko").orderBy("id"), str(tmp_path / "out.json"))
    assert n == 2 and json.loads((tmp_path / "out.json").read_text()) == [{"id": "tj-1", "title_ko": None}, {"id": "tj-2", "title_ko": None}]
    (tmp_path / "c.csv").write_text('﻿a,b\r\n"x ""q"", y",\r\n')
    assert [tuple(r) for r in json_sources.read_csv(spark, str(tmp_path / "c.csv"), "a string, b string").collect()] == [('x "q", y', "")]


def test_html_sources(spark):
    page = "<a href='/12'>Artist</a><a href='/13'>TOP 100</a><a href='/12'>again</a><table><tr><td>Title<br>제목<td>123<td>1<br>2<td>-</tr><tr><td><td>1<td>2<td>3</tr><tr><td>x</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    assert [(r.path, r.pos) for r in html_sources.index_paths(html_sources.links(pages, "id", "html")).collect()] == [("/12", 0)]
    assert [tuple(r) for r in html_sources.song_rows(html_sources.table_rows(pages, "id", "html")).collect()] == [(1, 0, "Title", "제목", "123", None, None)]


def test_validation(spark):
    good = record(0, "tj-1")
    rows = [good, good | {"id": "TJ_1"}, good | {"title_ko_confidence": "high", "title_ko_source": "blog"}, good | {"categories": ["jpop", "anime"], "title_primary": ""}]
    got = [r.e for r in frame(spark, rows).repartition(1).select(validate.record_errors().alias("e")).collect()]
    assert sorted(map(len, got)) == [0, 1, 1, 2]
    raw = spark.createDataFrame([('{"id": 1, "more": 2}',)], "j string")
    assert raw.select(validate.unknown_fields(F.col("j")).alias("u")).first().u == ["more"]


def test_stream_of_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("A｜B",)], "artist string").write.parquet(src)
    for _ in range(2):
        arrivals.append_each(arrivals.arrivals(spark, src, "artist string"), lambda b: b.select(text.identity_key(F.col("artist")).alias("k")), out, str(tmp_path / "cp")).awaitTermination()
    assert [r.k for r in spark.read.parquet(out).collect()] == ["ab"]


def test_interleave_numbers_a_bucket_in_several_tasks(spark):
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(small)
    spark.conf.set(small, "false")  # else the few rows here are put into one task afterwards
    rows = spark.range(20000).select("id", F.when(F.col("id") % 50 != 0, F.col("id") % 2 == 0).alias("side_"))
    out = ordered.interleave(rows, F.col("side_"), F.lit(False), ["id"]).withColumn("task", F.spark_partition_id()).collect()
    spark.conf.set(small, before)
    for side in (True, False, None):
        own = sorted((r.id, r.turn) for r in out if r.side is side)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert len(own) == 400 and len({r.task for r in out if r.side is True}) > 1


def test_article_body_and_long_cells(spark):
    body = "<div class='menu'><table><tr><td>a<td>1<td>2<td>3</table></div><div class='a body'><blockquote><p>가수<br>Name</p><p>x</p></blockquote><div>{}</div></div><table><tr><td>b<td>1<td>2<td>3</table>"
    row = "<table><tr><td>TJ<td>TJ<td>KY<td>JOYSOUND</tr><tr><td><b>T</b><br>제목<td>{}<td>7777777<td>7777777</tr></table>"
    pages = spark.createDataFrame([(1, body.format(row.format("12"))), (2, body.format(row.format("1" * 70000 + "<br>5"))), (3, "<div>no body</div>"), (4, "<div class=body><table><tr><td>x<td>1<td>2<td>3</table></div>"), (5, None)], "id long, html string")
    got = sorted(tuple(r) for r in html_sources.artist_pages(pages, "id", "html", "body").collect())
    assert [g[:5] for g in got] == [(1, 1, "T", "제목", "12"), (2, 1, "T", "제목", None)]
    assert {g[-2:] for g in got} == {("Name", "가수")} and {g[5:7] for g in got} == {(None, "7777777")}


def test_single_fix_and_sources(spark):
    from lodestone.plans import crawls

    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("2", "c")], "id string, ko string").withColumns({"src": F.lit("x"), "conf": F.lit("high")})
    assert sorted(tuple(r) for r in changes.fix_one(rows, "id", "1", "ko", "new", "src", "conf").collect())[0] == ("1", "new", "manual", None)
    for bad, message in (("2", "duplicate"), ("9", "not found")):
        with pytest.raises(ValueError, match=message):
            changes.fix_one(rows, "id", bad, "ko", "new", "src", "conf")
    crawls.source("given")(lambda s: rows)
    assert [f(spark) for f in crawls.chosen(["given"])] == [rows]
    with pytest.raises(ValueError, match="unknown source"):
        crawls.chosen(["nobody"])


def test_blog_crawl_stops_below_its_floor(spark):
    from lodestone.plans import crawls

    links = "".join(f"<a href='/{i}'>{i}</a>" for i in range(1, 11))
    index = spark.createDataFrame([(0, "/98", "jpop", 200, links)], "index int, path string, category string, status int, html string")
    page = "<blockquote><p>A</p></blockquote><table><tr><td>t<td>1<td>2<td>3</table>"
    pages = lambda n: spark.createDataFrame([(f"/{i}", 200 if i <= n else 503, page) for i in range(1, 11)], "path string, status int, html string")
    assert crawls.blog_crawl(index, pages(9), "now").count() == 9
    assert sorted(r.id for r in crawls.blog_crawl(index, pages(3), "now", limit=3).collect()) == ["blog-1-0", "blog-2-0", "blog-3-0"]
    with pytest.raises(ValueError, match="8 of 10"):
        crawls.blog_crawl(index, pages(8), "now")
    with pytest.raises(ValueError, match="status 500"):
        crawls.blog_crawl(index.withColumn("status", F.lit(500)), pages(9), "now")


def test_chunks_of_more_than_two_digits(spark, tmp_path):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate((0, 9, 10, 99, 100, 101, 1005))], "id long, chunk long")
    sinks.write_chunks(rows, "chunk", f"{tmp_path}/chunks")
    assert sorted(p.name for p in (tmp_path / "chunks").glob("_chunk=*")) == ["_chunk=00", "_chunk=09", "_chunk=10", "_chunk=100", "_chunk=1005", "_chunk=101", "_chunk=99"]
    assert sorted((r.id, r._chunk) for r in spark.read.json(f"{tmp_path}/chunks").collect()) == [(0, 0), (1, 9), (2, 10), (3, 99), (4, 100), (5, 101), (6, 1005)]
