"""Queries of the sources, sinks, enrichment and crawl jobs over the driver's tables, and the same in DuckDB SQL.

What a source reads (pages, responses, lines, names in several scripts) is made of the tables' columns by SQL that Spark
and DuckDB both read; the oracle then says from the columns what must come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import changes, classify, enrich, favourites, merge, ordered, rows, search, validate
from lodestone.operators.staging import shared_dir, stage
from lodestone.plans import crawls, jobs
from lodestone.plans.catalogue import KEY, MATCH, RECS, query, recs, t
from lodestone.sources import html_sources, json_sources, sinks, songbook

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(spark: SparkSession, at: str, text_: str) -> DataFrame:
    """A frame of SQL that DuckDB reads too; tables are named after FROM or JOIN."""
    used = {n for n in TABLES if f"FROM {n}" in text_ or f"JOIN {n}" in text_}
    text_ = text_.replace("{", "{{").replace("}", "}}")
    for n in used:
        text_ = text_.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(text_.replace("VARCHAR", "STRING"), **{n: t(spark, at, n) for n in used})


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- cells, pages and links

CELLS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN '-' WHEN 2 THEN concat(l_partkey, '<br>', l_suppkey)
  WHEN 3 THEN concat('1000000', l_partkey) WHEN 4 THEN '   —　' WHEN 5 THEN concat('  ', l_partkey, ' A ') WHEN 6 THEN concat('–<br>', l_suppkey) ELSE '' END AS cell FROM lineitem"""


@query("""SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 5 THEN concat(l_partkey, ' A') WHEN 6 THEN CAST(l_suppkey AS VARCHAR) END AS number FROM lineitem""")
def number_cells(spark, at):
    return sql(spark, at, CELLS).select("l_orderkey", "l_linenumber", text.number_cell(F.split("cell", "<br>"), 6).alias("number"))


ARTIST_PAGE = """concat('<div class="menu"><table><tr><td>a</td><td>1</td><td>2</td><td>3</td></tr></table></div><div class="x body"><div><blockquote><p>', {ko}, {primary}, '</p><p>more</p></blockquote></div>',
  '<table><tbody><tr><td>곡</td><td>TJ</td><td>KY</td><td>JOYSOUND</td></tr><tr><td><b>', {title}, '</b><br>제목 ', {no}, '</td><td>', {no}, '</td><td>-</td><td>1<br>2</td></tr>',
  '<tr><td></td><td>5</td><td>6</td><td>7</td></tr><tr><td>three</td><td>cells</td><td>only</td></tr></tbody></table><table><tr><td>', {title}, ' II</td><td> ', {no}, '<br></td><td>12345678</td><td>123456', {no}, '</td></tr></table></div>',
  '<table><tr><td>outside</td><td>1</td><td>2</td><td>3</td></tr></table>')"""
PARTS_PAGE = ARTIST_PAGE.format(ko="CASE WHEN p_partkey % 3 = 0 THEN '가수<br>' ELSE '' END", primary="p_brand", title="p_name", no="p_partkey")


@query("""
SELECT p_partkey AS id, r AS row, CASE r WHEN 1 THEN p_name ELSE concat(p_name, ' II') END AS title, CASE r WHEN 1 THEN concat('제목 ', p_partkey) END AS title_ko, CASE WHEN length(CAST(p_partkey AS VARCHAR)) <= 6 THEN CAST(p_partkey AS VARCHAR) END AS tj,
  CAST(NULL AS VARCHAR) AS ky, CASE WHEN r = 4 AND length(CAST(p_partkey AS VARCHAR)) = 1 THEN concat('123456', p_partkey) END AS joysound, p_brand AS artist_primary, CASE WHEN p_partkey % 3 = 0 THEN '가수' END AS artist_ko
FROM part, (SELECT unnest([1, 4]) AS r)""")
def html_songs(spark, at):
    pages = sql(spark, at, f"SELECT p_partkey, {PARTS_PAGE} AS html FROM part")
    return html_sources.artist_pages(pages, "p_partkey", "html", "body")


@query("""
SELECT page_id AS id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href, trim(x[i]) AS text
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS x, unnest(range(1, len(h) + 1)) AS i FROM pages)""")
def html_links(spark, at):
    return html_sources.links(t(spark, at, "pages"), "page_id", "html")


INDEX = """concat('<p><a href="/', c_custkey, '">', c_name, '</a><a href=''https://blog.example/', c_custkey + 1, '''> <b>x</b></a><a href="/', c_custkey, '">again</a><a href="/7777777">2026 월간 차트</a><a href="/8888888">Top 100</a><a href="/x9">no</a><a href="https://blog.example/9/b">no</a><a>none</a>')"""


@query("SELECT c_custkey AS id, concat('/', c_custkey) AS path, 0 AS pos FROM customer UNION ALL SELECT c_custkey, concat('/', c_custkey + 1), 1 FROM customer")
def index_links(spark, at):
    found = html_sources.links(sql(spark, at, f"SELECT c_custkey, {INDEX} AS html FROM customer"), "c_custkey", "html")
    return html_sources.index_paths(found, "blog\\.example")


# ---- JSON, CSV and their sinks

CATALOG = """concat('{"resultData":{"items":[{"pro":', p_partkey, ',"indexTitle":" ', p_name, ' ","indexSong":"', p_brand, '","subTitle":"","publishdate":null},{"pro":"","indexTitle":"x","indexSong":"y"},{"pro":"9","indexSong":"y"}]}}')"""


@query("SELECT CAST(p_partkey AS VARCHAR) AS pro, p_name AS title, p_brand AS artist, CAST(NULL AS VARCHAR) AS sub_title, CAST(NULL AS VARCHAR) AS publishdate FROM part")
def catalogue_items(spark, at):
    raw = sql(spark, at, f"SELECT {CATALOG} AS j FROM part")
    return json_sources.items(json_sources.catalog_items(raw, "j"), trimmed=True).select("pro", "title", "artist", "sub_title", "publishdate")


ITEM = """concat('{"pro":"', s_suppkey, '","indexTitle":"', s_name, '","indexSong":"a"}')"""
ENVELOPE = f"""CASE s_suppkey % 4 WHEN 0 THEN '{{"resultCode":"98","resultData":""}}' WHEN 1 THEN concat('{{"resultCode":"99","resultData":{{"items":[', {ITEM}, ']}}}}')
  WHEN 2 THEN concat('{{"resultCode":"99","resultData":[{{"itemsA":[', {ITEM}, '],"itemsATotalCount":1}},{{"itemsB":[', {ITEM}, ']}}]}}') ELSE '{{"resultCode":"99","resultData":"?"}}' END"""


@query("SELECT CAST(s_suppkey AS VARCHAR) AS pro, s_name AS title, count(*) AS n FROM supplier, (SELECT unnest([1, 2]) AS k) WHERE s_suppkey % 4 = 2 OR s_suppkey % 4 = 1 AND k = 1 GROUP BY ALL")
def envelope_items(spark, at):
    raw = sql(spark, at, f"SELECT {ENVELOPE} AS j FROM supplier")
    return json_sources.items(json_sources.envelope_items(raw, "j", tolerate=True)).groupBy("pro", "title").agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS seq, concat('tj-', s_suppkey) AS id, s_name AS title_primary, CAST(s_suppkey AS VARCHAR) AS tj, CAST(NULL AS VARCHAR) AS ky, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS media_context_ko FROM supplier")
def json_corpus(spark, at):
    out = sql(spark, at, "SELECT s_suppkey, concat('tj-', s_suppkey) AS id, s_name AS title_primary, CAST(s_suppkey AS VARCHAR) AS tj, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS media_context_ko FROM supplier")
    numbers = F.struct("tj", F.expr("CAST(NULL AS STRING)").alias("ky"), F.expr("CAST(NULL AS STRING)").alias("joysound"))
    path = scratch(spark, "corpus") + ".json"
    sinks.write_json_array(out.orderBy("s_suppkey").select("id", "title_primary", numbers.alias("karaoke_numbers"), "media_context_ko"), path)
    return json_sources.read_records(spark, path).select("seq", "id", "title_primary", "tj", "ky", "media_context_ko")


REVIEW = "SELECT CAST(c_custkey AS VARCHAR) AS id, concat(c_name, ',') AS title_primary, CASE WHEN c_custkey % 2 = 0 THEN concat('\"', c_mktsegment, '\"') END AS title_ko, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, concat(c_mktsegment, chr(10), 'x') AS reasoning FROM customer"


@query(f"SELECT id, title_primary, coalesce(title_ko, '') AS title_ko, confidence, reasoning FROM ({REVIEW}) WHERE confidence <> 'high'")
def review_csv(spark, at):
    path = scratch(spark, "review") + ".csv"
    sinks.write_review(sql(spark, at, REVIEW), path)
    return json_sources.read_csv(spark, path, "id string, title_primary string, title_ko string, confidence string, reasoning string")


@query("SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 100) AS INTEGER) AS _chunk FROM customer")
def chunk_inputs(spark, at):
    path = scratch(spark, "chunks")
    sinks.write_chunks(ordered.chunked(t(spark, at, "customer").select("c_custkey"), ["c_custkey"], 100).drop("number"), "chunk", path)
    return spark.read.json(path).select("c_custkey", F.col("_chunk").cast("int").alias("_chunk"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title_primary, CASE WHEN s_suppkey % 2 = 0 THEN 'ko' END AS title_ko, 'low' AS confidence, s_name AS reasoning FROM supplier")
def chunk_outputs(spark, at):
    rows_ = sql(spark, at, "SELECT s_suppkey % 3 AS k, CAST(s_suppkey AS VARCHAR) AS id, s_name AS title_primary, CASE WHEN s_suppkey % 2 = 0 THEN 'ko' END AS title_ko, 'low' AS confidence, s_name AS reasoning FROM supplier")
    at_ = scratch(spark, "outputs")
    entry = F.to_json(F.struct(*json_sources.CHUNK_FIELDS), {"ignoreNullFields": "false"})
    for r in rows_.groupBy("k").agg(F.concat_ws(",", F.collect_list(entry)).alias("j")).toLocalIterator():
        sinks.replace_text(spark, f"{at_}/llm-chunk-{r.k}.json", [f"[{r.j}]"])
    sinks.replace_text(spark, f"{at_}/llm-chunk-1-input.json", ["not read"])
    return json_sources.read_chunk_files(spark, at_)


ENTRIES = """concat('{"id":"', p_partkey % 500, '"', CASE p_partkey % 5 WHEN 0 THEN '' ELSE ',"title_primary":"t"' END, ',"title_ko":null,"confidence":"', CASE p_partkey % 7 WHEN 0 THEN 'sure' ELSE 'high' END, '","reasoning":"r"}')"""


@query("""
SELECT CAST(p_partkey % 500 AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 THEN 'missing title_primary' ELSE 'confidence sure' END AS error FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0
UNION ALL SELECT CAST(p_partkey % 500 AS VARCHAR), 'duplicate' FROM part GROUP BY 1 HAVING count(*) > 1""")
def chunk_errors(spark, at):
    return json_sources.chunk_errors(sql(spark, at, f"SELECT {ENTRIES} AS entry FROM part"))


CACHE = """concat('{"version":', CASE WHEN c_custkey % 3 = 0 THEN '"x"' ELSE '4' END, ',"more":{"a":1},"bootstrappedAt":', CASE WHEN c_custkey % 2 = 0 THEN '"2026-01-01"' ELSE '7' END, ',"proEnrichmentMap":{"', c_custkey, '":{"lastSeen":"2026-01-02","nationalcode":"JPN","sortTitleKo":5},"bad":{"nationalcode":"KOR"},"worse":3},
 "artistNationalityMap":{"', c_name, '":{"code":"KOR","votes":{"jpn":1,"kor":', c_custkey, '},"lastSeen":"2026-01-03"},"odd":{"code":"XX","lastSeen":"2026-01-03"}}}')"""


@query("""
SELECT 'number' AS kind, CAST(c_custkey AS VARCHAR) AS key, 'JPN' AS code, CAST(NULL AS VARCHAR) AS extra, CAST(NULL AS BIGINT) AS kor FROM customer
UNION ALL SELECT 'artist', c_name, 'KOR', CAST(NULL AS VARCHAR), c_custkey FROM customer
UNION ALL SELECT 'header', CASE WHEN c_custkey % 2 = 0 THEN '2026-01-01' END, CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '4' END, '{"a":1}', 1 FROM customer""")
def cache_tables(spark, at):
    raw = sql(spark, at, f"SELECT {CACHE} AS j FROM customer")
    numbers = json_sources.number_entries(json_sources.cache_entries(raw, "j", "proEnrichmentMap"))
    artists = json_sources.artist_entries(json_sources.cache_entries(raw, "j", "artistNationalityMap"))
    header = json_sources.cache_header(raw, "j")
    none = F.lit(None).cast("string")
    out = numbers.select(F.lit("number").alias("kind"), F.col("pro").alias("key"), F.col("nationalcode").alias("code"), F.col("sort_title_ko").alias("extra"), F.lit(None).cast("long").alias("kor"))
    out = out.union(artists.select(F.lit("artist"), "key", "code", none, "kor"))
    return out.union(header.select(F.lit("header"), "bootstrapped_at", F.col("version").cast("string"), F.col("extras")["more"], F.size("extras").cast("long")))


@query("""
SELECT * FROM (VALUES ('more', '{"a":1}'), ('version', '4'), ('generatedAt', '"1970-01-01T00:00:00.000Z"'), ('bootstrappedAt', '"2026-01-01"')) v(name, value)
UNION ALL SELECT 'proEnrichmentMap', concat('{', (SELECT string_agg(concat('"', n_nationkey, '":{"nationalcode":"', n_name, '"}'), ',' ORDER BY CAST(n_nationkey AS VARCHAR)) FROM nation), '}')
UNION ALL SELECT 'artistNationalityMap', concat('{', (SELECT string_agg(concat('"', r_name, '":{"code":"JPN"}'), ',' ORDER BY r_name) FROM region), '}')""")
def cache_document(spark, at):
    header = json_sources.cache_header(spark.createDataFrame([('{"version":4,"more":{"a":1},"bootstrappedAt":"2026-01-01"}',)], "j string"), "j")
    return sinks.cache_document(header, sql(spark, at, "SELECT CAST(n_nationkey AS VARCHAR) AS pro, n_name AS nationalcode FROM nation"), sql(spark, at, "SELECT r_name AS key, 'JPN' AS code FROM region"))


@query(f"SELECT DISTINCT {MATCH.format('k')} AS key FROM (SELECT c_mktsegment AS k FROM customer UNION ALL SELECT c_name FROM customer)")
def sidecar_keys(spark, at):
    raw = sql(spark, at, """SELECT CASE WHEN c_custkey % 4 = 9 THEN 'broken' ELSE concat('{"keys":["', c_mktsegment, '","', c_name, '","",5]}') END AS j FROM customer""")
    return json_sources.sidecar_keys(raw.union(spark.createDataFrame([("broken",), ('{"other":[]}',)], "j string")), "j")


# ---- records


@query("SELECT concat('blog-', c_custkey, '-', c_nationkey) AS id, concat('http://b/', c_custkey) AS source_url, c_name AS title_primary, '2026-01-01' AS crawled_at FROM customer")
def blog_mapping(spark, at):
    raw = sql(spark, at, "SELECT concat('/', c_custkey) AS path, c_nationkey AS row, concat('http://b/', c_custkey) AS source_url, c_name AS title_primary FROM customer")
    return rows.blog_records(raw, "2026-01-01")


@query("SELECT concat('tj-', p_partkey) AS id, p_name AS title_primary, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS title_ko, CASE WHEN p_partkey % 2 = 0 THEN concat('c', p_size) END AS artist_ko, CAST(p_partkey AS VARCHAR) AS tj, 'jpop' AS category FROM part")
def vendor_mapping(spark, at):
    raw = sql(spark, at, "SELECT 'u' AS source_url, p_name AS title, p_brand AS artist, CAST(p_partkey AS VARCHAR) AS pro FROM part")
    ko = sql(spark, at, "SELECT CAST(p_partkey AS VARCHAR) AS pro, p_type AS sort_title_ko, concat('c', p_size) AS sort_song_ko FROM part WHERE p_partkey % 2 = 0")
    return rows.vendor_records(raw, ko, "now").select("id", "title_primary", "title_ko", "artist_ko", "tj", F.col("categories")[0].alias("category"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '2020-01-02' ELSE CASE WHEN o_orderkey % 4 = 0 THEN CAST(DATE '1970-01-01' + CAST(o_orderkey % 20000 AS INTEGER) AS VARCHAR) ELSE '' END END AS day FROM orders WHERE o_orderkey % 20000 <> 0")
def database_dates(spark, at):
    raw = sql(spark, at, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ' 2020-01-02 ' WHEN 1 THEN ' ' END AS stated, CASE o_orderkey % 4 WHEN 0 THEN CAST((o_orderkey % 20000) * 86400 + 5 AS VARCHAR) WHEN 1 THEN '0' WHEN 2 THEN '12x' END AS epoch FROM orders WHERE o_orderkey % 20000 <> 0")
    return raw.select("o_orderkey", rows.database_date(F.col("stated"), F.col("epoch")).alias("day"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS stamp FROM events")
def iso_stamps(spark, at):
    return t(spark, at, "events").select("event_id", rows.iso_millis(F.col("ts")).alias("stamp"))


WIDE = "translate({}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#', 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９＃')"
SCRIPTS = f"""SELECT c_custkey AS id, c_name, CASE c_custkey % 9 WHEN 0 THEN concat('夢', c_name) WHEN 1 THEN concat(c_name, 'ゴースト') WHEN 2 THEN concat('한글 ', c_name) WHEN 3 THEN '漢字한글' WHEN 4 THEN ''
  WHEN 5 THEN concat(c_name, ' (극장판 OST) (x) (오프닝)') WHEN 6 THEN concat('  ', c_name, '　  b ') WHEN 7 THEN {WIDE.format('c_name')} ELSE c_name END AS s FROM customer"""


@query(f"SELECT id, id % 9 IN (1) AS kana, id % 9 IN (0, 3) AS han, id % 9 IN (2, 3, 5) AS hangul, id % 9 IN (2, 5) AS hangul_only, id % 9 IN (1, 6, 7, 8) AS admitted FROM ({SCRIPTS})")
def script_flags(spark, at):
    from lodestone.functions import rules

    s = F.col("s")
    out = sql(spark, at, SCRIPTS)
    return out.select("id", s.rlike(rules.KANA).alias("kana"), s.rlike(rules.HAN).alias("han"), s.rlike(rules.HANGUL).alias("hangul"), (s.rlike(rules.HANGUL) & ~s.rlike(rules.KANA) & ~s.rlike(rules.HAN)).alias("hangul_only"), classify.admits_to_whitelist(s).alias("admitted"))


@query(f"SELECT id, CASE id % 9 WHEN 5 THEN '(극장판 OST) (오프닝)' END AS media, CASE WHEN id % 9 IN (6) THEN concat(c_name, ' b') WHEN id % 9 = 4 THEN '' WHEN id % 9 IN (7) THEN {WIDE.format('c_name')} ELSE s END AS collapsed FROM ({SCRIPTS})")
def media_and_spaces(spark, at):
    return sql(spark, at, SCRIPTS).select("id", text.media_context(F.col("s")).alias("media"), text.collapse(F.col("s")).alias("collapsed"))


@query(f"SELECT id, CASE WHEN id % 9 = 7 THEN {KEY.format('c_name')} ELSE {KEY.format('s')} END AS key, CASE WHEN id % 9 = 7 THEN {MATCH.format('c_name')} ELSE replace({MATCH.format('s')}, '　', '') END AS match FROM ({SCRIPTS})")
def compatibility_keys(spark, at):
    return sql(spark, at, SCRIPTS).select("id", text.identity_key(F.col("s")).alias("key"), text.match_key(F.col("s")).alias("match"))


@query(f"SELECT kept, skipped FROM (SELECT count(*) FILTER (WHERE id % 9 IN (1, 6, 7, 8) AND id % 2 = 0) AS kept, count(*) FILTER (WHERE id % 9 NOT IN (1, 6, 7, 8) AND id % 2 = 0) AS skipped FROM ({SCRIPTS}))")
def whitelist_counts(spark, at):
    return enrich.whitelist_counts(sql(spark, at, SCRIPTS).select(F.expr("CASE WHEN id % 2 = 0 THEN CAST(id AS STRING) WHEN id % 3 = 0 THEN '' END").alias("tj"), F.col("s").alias("artist_primary")))


@query(f"SELECT DISTINCT CAST(id % 1000 AS VARCHAR) AS pro FROM ({SCRIPTS}) WHERE id % 9 IN (1, 6, 7, 8)")
def whitelist_numbers(spark, at):
    return enrich.whitelist(sql(spark, at, SCRIPTS).select((F.col("id") % 1000).cast("string").alias("tj"), F.col("s").alias("artist_primary")))


@query(f"SELECT id FROM ({SCRIPTS}) WHERE id % 9 IN (0, 1, 3) AND id % 2 = 0 AND id % 5 <> 0")
def translatable(spark, at):
    r = sql(spark, at, SCRIPTS).selectExpr("id", "s AS title_primary", "CASE WHEN id % 2 = 1 THEN 'k' END AS title_ko", "CASE WHEN id % 5 = 0 THEN 'blog' END AS title_ko_source")
    return enrich.translatable(r).select("id")


@query(f"""
SELECT id, CASE WHEN id % 9 = 4 THEN '' WHEN ko IS NULL THEN s ELSE concat(s, ' — ', ko) END || CASE WHEN m IS NOT NULL AND coalesce(ko, '') <> m THEN concat(' ', m) ELSE '' END AS title, CASE WHEN id % 3 = 0 THEN concat(s, ' (', c_name, ', z)') ELSE s END AS artist
FROM (SELECT *, CASE WHEN id % 2 = 0 THEN '(OST)' END AS ko, CASE WHEN id % 4 = 0 THEN '(OST)' WHEN id % 4 = 1 THEN '(TV)' END AS m FROM ({SCRIPTS}))
""")
def display_names(spark, at):
    r = sql(spark, at, SCRIPTS).selectExpr("id", "c_name", "s", "CASE WHEN id % 2 = 0 THEN '(OST)' END AS ko", "CASE WHEN id % 4 = 0 THEN '(OST)' WHEN id % 4 = 1 THEN '(TV)' END AS m")
    aliases = F.when(F.col("id") % 3 == 0, F.array("c_name", F.lit("z")))
    return r.select("id", rows.title_display(F.col("s"), F.col("ko"), F.col("m")).alias("title"), rows.artist_display(F.col("s"), aliases).alias("artist"))


@query(f"WITH r AS ({RECS}) SELECT seq, row_number() OVER (ORDER BY tj IS NULL, tj, {KEY.format('title_primary')}, id) - 1 AS place FROM r")
def final_order(spark, at):
    return merge.numbered(recs(spark, at)).select("seq", F.col("place").cast("long").alias("place"))


@query("SELECT row_number() OVER (ORDER BY s, k) - 1 AS seq, name FROM (SELECT 0 AS s, p_partkey AS k, p_name AS name FROM part UNION ALL SELECT 1, s_suppkey, s_name FROM supplier)")
def concatenated(spark, at):
    a = sql(spark, at, "SELECT p_partkey AS seq, p_name AS name FROM part")
    b = sql(spark, at, "SELECT s_suppkey AS seq, s_name AS name FROM supplier")
    return jobs.concatenate([a, b]).select(F.col("seq").cast("long").alias("seq"), "name")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 = 7 OR c_custkey % 5 = 0")
def alias_recall(spark, at):
    r = sql(spark, at, "SELECT c_custkey AS id, c_mktsegment AS title, CASE WHEN c_custkey % 10 = 7 THEN 'Seven Ｕｐ' END AS a, CASE WHEN c_custkey % 5 = 0 THEN 'Fifth!' END AS b FROM customer")
    index = search.postings(r.select("id", "title", F.filter(F.array("a", "b"), lambda x: x.isNotNull()).alias("aliases")), "id", ["title", "aliases"])
    return search.search(index, ["up", "fifth"], prefix=False, fuzzy=0).select("id")


@query(f"SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) - (SELECT count(DISTINCT artist_primary) FROM ({RECS})) AS gone")
def counters_gone(spark, at):
    r = recs(spark, at).select("artist_primary")
    return changes.replay_gate(r, r.distinct(), rewrites=1).select(F.col("delta").alias("gone"))


@query("SELECT b AS before, b AS after, 0 AS delta, 'ok' AS verdict FROM (SELECT count(*) AS b FROM part)")
def replay_rewrites(spark, at):
    p = t(spark, at, "part").select("p_partkey")
    return changes.replay_gate(p, p, rewrites=3)


@query(f"""
WITH r AS ({RECS}), s AS (SELECT *, split_part(id, '-', 1) IN ('tj', 'tjpdf') AND coalesce(src, '') NOT IN ('llm-translated', 'manual', 'blog') AS gone FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN title_ko_source WHEN seq % 7 = 0 THEN 'stale' END AS src FROM r))
SELECT seq, CASE WHEN gone THEN NULL ELSE concat(title_primary, ' (극장판)') END AS title_ko, CASE WHEN gone THEN NULL WHEN split_part(id, '-', 1) = 'blog' AND src IS NULL THEN 'blog' ELSE src END AS source,
  CASE WHEN gone THEN '(극장판)' ELSE media_context_ko END AS media, CASE WHEN gone THEN NULL ELSE title_ko_confidence END AS confidence
FROM (SELECT * REPLACE (regexp_replace(title_primary, '[()]', '', 'g') AS title_primary) FROM s)""")
def title_ko_first_stage(spark, at):
    r = recs(spark, at).withColumn("title_primary", F.regexp_replace("title_primary", "[()]", "")).withColumn("src", F.expr("CASE WHEN seq % 2 = 0 THEN title_ko_source WHEN seq % 7 = 0 THEN 'stale' END"))
    out = changes.title_ko_rule(F.col("id"), F.concat("title_primary", F.lit(" (극장판)")), F.col("src"), F.col("media_context_ko"), F.col("title_ko_confidence"))
    return r.select("seq", *[c.alias(n) for n, c in out.items()])


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM documents")
def stage_again(spark, at):
    """The first title stage changes nothing that it has been through."""
    once = recs(spark, at)
    new = lambda df: df.withColumns(dict(zip(("title_ko", "title_ko_source", "media_context_ko", "title_ko_confidence"), changes.title_ko_rule(F.col("id"), F.col("title_ko"), F.col("title_ko_source"), F.col("media_context_ko"), F.col("title_ko_confidence")).values(), strict=True)))
    fields = F.struct("title_ko", "title_ko_source", "media_context_ko", "title_ko_confidence")
    one = new(once)
    two = new(one.withColumn("before", fields))
    return two.agg(F.count("*").alias("rows"), F.count_if(~fields.eqNullSafe(F.col("before"))).alias("changed"))


VALID = """SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN concat('tj-', c_custkey) ELSE concat('TJ-', c_custkey) END AS id, CASE WHEN c_custkey % 3 = 0 THEN 'nowhere' ELSE 'https://x/1' END AS source_url,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS title_primary, c_name AS artist_primary, CASE WHEN c_custkey % 7 = 0 THEN '' END AS title_ko, CAST(NULL AS VARCHAR) AS artist_ko, '2026-01-01T00:00:00Z' AS crawled_at,
  CASE WHEN c_custkey % 11 = 0 THEN 'OST' WHEN c_custkey % 11 = 1 THEN '(OST)' END AS media_context_ko, CASE c_custkey % 4 WHEN 0 THEN 'blog' WHEN 1 THEN 'llm-translated' WHEN 2 THEN 'who' END AS title_ko_source, CASE WHEN c_custkey % 3 = 1 THEN 'high' WHEN c_custkey % 3 = 2 THEN 'sure' END AS title_ko_confidence,
  CASE WHEN c_custkey % 13 = 0 THEN 'rock' ELSE 'jpop' END AS category FROM customer"""


@query("""SELECT k, unnest(list_filter([CASE WHEN k % 2 = 1 THEN 'id must match pattern' END, CASE WHEN k % 3 = 0 THEN 'source_url must be a uri' END, CASE WHEN k % 5 = 0 THEN 'title_primary must not be empty' END, CASE WHEN k % 7 = 0 THEN 'title_ko must not be empty' END,
  CASE WHEN k % 13 = 0 THEN 'categories must be exactly one' END, CASE WHEN k % 11 = 0 THEN 'media_context_ko must match pattern' END, CASE WHEN k % 4 = 2 THEN 'title_ko_source must be known' END, CASE WHEN k % 3 = 2 THEN 'title_ko_confidence must be known' END,
  CASE WHEN k % 3 <> 0 AND k % 4 <> 1 THEN 'title_ko_confidence needs llm-translated' END], lambda x: x IS NOT NULL)) AS error FROM (SELECT c_custkey AS k FROM customer)""")
def record_validation(spark, at):
    r = sql(spark, at, VALID).withColumns({"categories": F.array("category"), "artist_aliases": F.array("id", "artist_primary")})
    return r.select("k", F.explode(validate.record_errors()).alias("error"))


FIXES = "SELECT CAST(c_custkey * 2 AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE concat('t', c_custkey * 2) END AS title, concat('ko', c_custkey) AS ko FROM customer"
FIXED = "SELECT c_custkey AS seq, CAST(c_custkey AS VARCHAR) AS id, concat('t', c_custkey) AS title, c_mktsegment AS ko, 'llm-translated' AS src, 'high' AS conf FROM customer"


@query(f"SELECT r.seq, r.id, coalesce(f.ko, r.ko) AS ko, CASE WHEN f.ko IS NULL THEN src ELSE 'manual' END AS src, CASE WHEN f.ko IS NULL THEN conf END AS conf FROM ({FIXED}) r LEFT JOIN ({FIXES}) f ON r.id = f.id AND r.title = f.title")
def fixes_applied(spark, at):
    return changes.apply_fixes(sql(spark, at, FIXED), sql(spark, at, FIXES), "id", "title", "ko", "src", "conf", "seq").select("seq", "id", "ko", "src", "conf")


@query(f"SELECT seq, CASE WHEN id = '7' THEN 'by hand' ELSE ko END AS ko, CASE WHEN id = '7' THEN 'manual' ELSE src END AS src, CASE WHEN id <> '7' THEN conf END AS conf FROM ({FIXED})")
def single_fix(spark, at):
    return changes.fix_one(sql(spark, at, FIXED), "id", "7", "ko", "by hand", "src", "conf").select("seq", "ko", "src", "conf")


@query(f"""
WITH RECURSIVE r AS ({RECS}) SELECT count(*) FILTER (WHERE seq % 3 = 0) AS total, least(10, count(*)) AS shown, (SELECT count(DISTINCT artist_primary) FROM r) AS alias_total, least(5, (SELECT count(DISTINCT artist_primary) FROM r)) AS alias_shown FROM r""")
def conflict_summary(spark, at):
    r = recs(spark, at)
    found = r.select(F.col("id").alias("cluster_key"), F.when(F.col("seq") % 3 == 0, "tj").otherwise("tier_c_merge").alias("field"), F.col("tj").alias("winner"))
    clashes = r.groupBy(F.col("artist_primary").alias("alias")).agg(F.count("*").alias("affected"))
    out = merge.summary(found, clashes)
    return out.select("total", F.size("sample").cast("long").alias("shown"), "alias_total", F.size("alias_sample").cast("long").alias("alias_shown"))


# ---- enrichment

CREDITS = "SELECT c_custkey AS seq, concat(c_mktsegment, CASE c_custkey % 5 WHEN 0 THEN concat(' (Feat. N', c_nationkey, ' of G', c_custkey % 7, ')') WHEN 1 THEN concat(' & N', c_nationkey) WHEN 2 THEN concat(' with N', c_nationkey) WHEN 3 THEN concat(', N', c_nationkey, ' meets M') ELSE '' END) AS artist FROM customer"
PIECES = """SELECT seq, artist, unnest(list_concat([artist], CASE seq % 5 WHEN 0 THEN [seg, concat(n, ' of ', g), n, g] WHEN 1 THEN [seg, n] WHEN 2 THEN [seg, n] WHEN 3 THEN [seg, n, 'M'] ELSE [] END)) AS piece
FROM (SELECT c_custkey AS seq, c_mktsegment AS seg, concat('N', c_nationkey) AS n, concat('G', c_custkey % 7) AS g, artist FROM customer JOIN ({}) x ON x.seq = c_custkey)""".format(CREDITS)


@query(f"SELECT seq FROM ({CREDITS}) WHERE seq NOT IN (SELECT seq FROM ({PIECES}) WHERE {MATCH.format('piece')} IN ('n3', 'g2', 'household')) AND seq NOT IN (1, 2)")
def drop_components(spark, at):
    keys = spark.createDataFrame([("n3",), ("g2",), ("household",)], "key string")
    return enrich.drop_listed(sql(spark, at, CREDITS), "seq", "artist", keys, [1, 2]).select("seq")


@query(f"SELECT {MATCH.format('piece')} AS key FROM ({PIECES}) GROUP BY 1")
def component_surfaces(spark, at):
    out = enrich.distinct_components(sql(spark, at, CREDITS), "artist", "seq")
    return out.where(F.lower(F.regexp_replace("surface", " ", "")) == F.col("key")).select("key")


@query("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'anime' WHEN 1 THEN CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'vocaloid' END WHEN 2 THEN NULL WHEN 3 THEN 'anime' WHEN 4 THEN 'anime' ELSE 'vocaloid' END AS category FROM customer")
def section_lists(spark, at):
    names_ = "CASE WHEN c_custkey % 6 = 0 THEN 'GARNiDELiA' WHEN c_custkey % 6 = 1 AND c_custkey % 5 = 0 THEN '米津玄師(+菅田将暉)' WHEN c_custkey % 6 = 2 THEN 'Ａimer & x' WHEN c_custkey % 6 = 3 THEN 'CHiCO with Honey Works & HoneyWorks' WHEN c_custkey % 6 = 5 THEN concat('a', c_custkey) ELSE 'someone' END"
    r = sql(spark, at, f"SELECT c_custkey AS id, {names_} AS artist, CASE WHEN c_custkey % 6 = 4 THEN 'anime' ELSE 'vocaloid' END AS section FROM customer")
    keyed = enrich.component_keys(r, "artist")
    bare = enrich.component_keys(keyed.withColumn("b", F.regexp_replace("artist", songbook.CO_VOCALIST, "")), "b", "bare")
    return bare.select("id", songbook.section_category(F.col("section"), F.col("keys"), F.col("bare")).alias("category"))


@query("""SELECT o_orderkey, n_name AS lead_code, CASE WHEN o_orderkey % 4 = 0 THEN c_mktsegment END AS pro_code, o_orderkey % 4 = 0 AND o_custkey % 3 = 0 AS whitelisted
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON CAST(o_orderkey % 40 AS BIGINT) = n_nationkey""")
def admit_codes(spark, at):
    r = sql(spark, at, "SELECT o_orderkey, o_orderkey % 40 AS lead, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS pro FROM orders")
    out = enrich.with_codes(r, sql(spark, at, "SELECT n_nationkey AS key, n_name AS code FROM nation"), sql(spark, at, "SELECT c_custkey AS pro, c_mktsegment AS code FROM customer"), sql(spark, at, "SELECT c_custkey AS pro FROM customer WHERE c_custkey % 3 = 0"), "lead", "pro", ["o_orderkey"])
    return out.select("o_orderkey", "lead_code", "pro_code", "whitelisted")


NOW = "TIMESTAMP '2026-06-01 00:00:00'"


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pro, CASE WHEN p_partkey % 3 = 0 THEN 'hit' WHEN p_partkey % 7 = 0 THEN 'error' WHEN p_partkey % 5 = 0 THEN 'miss' ELSE 'fetched' END AS outcome,
  CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN NULL ELSE concat('c', p_size) END AS sort_title_ko FROM part""")
def translit_outcomes(spark, at):
    state = sql(spark, at, f"SELECT CAST(p_partkey AS VARCHAR) AS pro, p_type AS sort_title_ko, CASE WHEN p_partkey % 3 = 0 THEN {NOW.replace('06-01', '05-01')} ELSE {NOW.replace('06-01', '01-01')} END AS last_seen FROM part WHERE p_partkey % 3 < 2")
    asked = sql(spark, at, "SELECT CAST(p_partkey AS VARCHAR) AS pro, concat('it''s ', p_partkey) AS title FROM part")
    found = sql(spark, at, "SELECT concat('its ', p_partkey) AS search, k AS pos, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS pro, CASE k WHEN 2 THEN concat('c', p_size) ELSE 'later' END AS sort_title_ko, p_partkey % 7 <> 0 AS ok FROM (SELECT *, explode(array(2, 5)) AS k FROM part)")
    return enrich.fill_transliterations(asked, state, found, F.expr(NOW))[0]


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'ENG' WHEN c_custkey % 4 = 1 THEN 'AMBIGUOUS' WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' ELSE 'JPN' END AS code, c_custkey % 3 = 0 OR c_custkey % 4 = 1 AS old FROM customer WHERE c_custkey % 3 < 2 OR c_custkey % 4 <> 1""")
def artist_scans(spark, at):
    state = sql(spark, at, f"SELECT CAST(c_custkey AS VARCHAR) AS key, CASE WHEN c_custkey % 3 = 0 THEN 'ENG' ELSE 'AMBIGUOUS' END AS code, CAST(1 AS BIGINT) AS jpn, CAST(0 AS BIGINT) AS kor, CAST(0 AS BIGINT) AS eng, CASE WHEN c_custkey % 3 = 0 THEN {NOW.replace('06-01', '05-01')} ELSE {NOW.replace('06-01', '01-01')} END AS last_seen FROM customer WHERE c_custkey % 3 < 2")
    scans = sql(spark, at, "SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey % 4 <> 1 AS ok, CASE WHEN c_custkey % 5 <> 0 THEN 4 END AS jpn, CASE WHEN c_custkey % 5 <> 0 THEN 1 END AS kor, CAST(NULL AS INT) AS eng FROM customer")
    out = enrich.scan_artists(state, scans, F.expr(NOW))
    return out.select("key", "code", (F.col("last_seen") < F.expr(NOW)).alias("old"))


@query("SELECT c_custkey AS id, c_custkey % 3 <> 0 AS due, CASE WHEN c_custkey % 2 = 0 THEN '2026-06-01' WHEN c_custkey % 3 = 0 THEN '2026-05-28' WHEN c_custkey % 3 = 1 THEN '2026-05-20' END AS stamp FROM customer")
def bootstrap_gate(spark, at):
    h = sql(spark, at, f"SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN TIMESTAMP '2026-05-28 00:00:00' WHEN 1 THEN TIMESTAMP '2026-05-20 00:00:00' END AS bootstrapped_at, CAST(NULL AS TIMESTAMP) AS generated_at FROM customer")
    due = h.withColumn("due", enrich.bootstrap_due(h, F.expr(NOW)))
    return enrich.stamped(due, 1 - F.col("id") % 2, F.expr(NOW)).select("id", "due", F.col("bootstrapped_at").cast("date").cast("string").alias("stamp"))


@query("SELECT CAST(p_partkey % 40 AS VARCHAR) || 'x' AS key, least(5, count(DISTINCT p_partkey)) AS votes FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0 GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 3")
def korean_fallback(spark, at):
    i = sql(spark, at, "SELECT concat(p_partkey % 40, ' X') AS name, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE concat(p_partkey % 40, 'x') END AS artist, CASE WHEN p_partkey % 2 = 0 THEN 'KOR' ELSE 'JPN' END AS code, p_partkey AS pro FROM part")
    return enrich.korean_fallback(i.union(i), 0, 0).select("key", F.col("votes").cast("long").alias("votes"))


NEW = "SELECT CAST(p_partkey AS VARCHAR) AS tj, concat(p_brand, CASE WHEN p_partkey % 3 = 0 THEN ' II' ELSE '' END) AS artist_primary, 'now' AS crawled_at, CAST(NULL AS VARCHAR) AS a FROM part"


@query("SELECT CAST(p_partkey AS VARCHAR) AS tj, CASE WHEN p_partkey % 2 = 0 THEN 'then' ELSE 'now' END AS crawled_at, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN concat('c', p_size) END AS alias FROM part")
def carried_rows(spark, at):
    new = sql(spark, at, NEW).withColumn("artist_aliases", F.lit(None).cast("array<string>")).drop("a")
    old = sql(spark, at, "SELECT p_partkey AS seq, concat(CASE WHEN p_partkey % 2 = 0 THEN 'tjpdf-' ELSE 'blog-' END, p_partkey) AS id, CAST(p_partkey AS VARCHAR) AS tj, lower(p_brand) AS artist_primary, 'then' AS crawled_at, concat('c', p_size) AS p_container FROM part").withColumn("artist_aliases", F.array("p_container")).drop("p_container")
    earlier = old.withColumns({"seq": -1 - F.col("seq"), "crawled_at": F.lit("long ago"), "artist_aliases": F.array(F.lit("old"))})
    return enrich.carried(new, old.union(earlier)).select("tj", "crawled_at", F.try_element_at("artist_aliases", F.lit(1)).alias("alias"))


@query("""
SELECT path, i AS index, pos, list_aggregate(list_sort(l), 'string_agg', ';') AS listed, CASE WHEN path IN ('/101', '/105', '/112') THEN 'jpop' WHEN list_contains(l, 'vocaloid') THEN 'vocaloid' ELSE 'jpop' END AS category
FROM (SELECT concat('/', l_partkey) AS path, arg_min(l_linenumber, l_linenumber * 10000000 + l_orderkey) AS i, min(l_linenumber * 10000000 + l_orderkey) % 10000000 AS pos, list(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'vocaloid' ELSE 'jpop' END) AS l FROM lineitem WHERE l_partkey NOT IN (7, 8) GROUP BY l_partkey)""")
def path_categories(spark, at):
    links = sql(spark, at, "SELECT l_linenumber AS index, l_orderkey AS pos, concat('/', l_partkey) AS path, CASE WHEN l_linenumber % 2 = 0 THEN 'vocaloid' ELSE 'jpop' END AS category FROM lineitem")
    out = enrich.path_categories(links, ["/7", "/8"])
    return out.select("path", "first.index", "first.pos", F.array_join("listed", ";").alias("listed"), F.array_join("categories", ";").alias("category"))


@query("SELECT unnest(['all_', 'urgent', 'late']) AS name, unnest([count(*), count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), count(*) FILTER (WHERE o_orderstatus = 'O')]) AS n FROM orders")
def counters(spark, at):
    return enrich.counters(t(spark, at, "orders"), all_=F.lit(True), urgent=F.col("o_orderpriority") == "1-URGENT", late=F.col("o_orderstatus") == "O")


# ---- favourites

LISTS = """SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN concat('["', c_custkey, '","b",5,"c"]') WHEN 1 THEN '{"a":1}' WHEN 2 THEN 'broken' ELSE '["b","a"]' END AS j FROM customer"""


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN concat(k, ';c') ELSE concat('x;', k, ';b;c') END WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'a' ELSE 'x;b;a' END ELSE CASE WHEN k % 3 = 0 THEN 'b' ELSE 'x' END END AS ids FROM ({LISTS})")
def favourite_toggle(spark, at):
    return sql(spark, at, LISTS).select("k", F.array_join(favourites.toggled(json_sources.strings_of(F.col("j")), F.expr("CASE WHEN k % 3 = 0 THEN 'b' ELSE 'x' END")), ";").alias("ids"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 40 - p_partkey AS rank FROM part WHERE p_partkey BETWEEN 3 AND 40 AND p_partkey % 2 = 0")
def favourites_list(spark, at):
    r = sql(spark, at, "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'jpop' ELSE 'anime' END AS c, CAST(p_partkey AS VARCHAR) AS tj FROM part").withColumn("categories", F.array("c"))
    ids = spark.range(1).select(F.transform(F.sequence(F.lit(40), F.lit(3), F.lit(-1)), lambda x: x.cast("string")).alias("ids"))
    ids = ids.select(F.concat("ids", F.array(F.lit("stale"), F.lit("40"))).alias("ids"))
    return favourites.browse(r, favourites.listed(ids, "ids"), None, "jpop", ("tj",)).select("id", F.col("rank").cast("long").alias("rank"))


# ---- the songbook

LINE = """concat(CASE WHEN p_partkey % 50 = 0 THEN '보컬로이드,     ' WHEN p_partkey % 50 = 25 THEN '특촬물  ' ELSE '애니 이름    ' END, {title}, '    ★  ', {no}, '   ', {artist})"""
BOOK = f"""SELECT p_size AS book, p_partkey * 4 + k AS line_no, CASE k WHEN 0 THEN {LINE.format(title="CASE WHEN p_partkey % 3 = 0 THEN concat('夢', p_partkey) ELSE p_name END", no="50000 + p_partkey % 40000", artist="p_brand")}
  WHEN 1 THEN CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '2026 년 페이지' WHEN 2 THEN '             유메    가수' ELSE '' END WHEN 2 THEN CASE p_partkey % 4 WHEN 0 THEN '             유메' ELSE '12 3456 1.50000' END ELSE '   ' END AS line FROM (SELECT *, {{each}} AS k FROM part)"""


@query("""
WITH l AS (SELECT p_size AS book, p_partkey * 4 AS line_no, p_partkey AS p, 50000 + p_partkey % 40000 AS tj, p_name, p_brand, CASE WHEN p_partkey % 50 = 0 THEN 'vocaloid' WHEN p_partkey % 50 = 25 THEN 'anime' END AS s FROM part),
c AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY book ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'anime') AS section FROM l)
SELECT book, line_no, CAST(tj AS VARCHAR) AS tj, CASE WHEN p % 3 = 0 THEN concat('夢', p) ELSE p_name END AS title, p_brand AS artist, CASE WHEN p % 3 = 0 AND p % 4 IN (0, 2) THEN '유메' END AS title_ko, CAST(NULL AS VARCHAR) AS artist_ko, section
FROM c QUALIFY row_number() OVER (PARTITION BY book, tj ORDER BY line_no) = 1""")
def songbook_lines(spark, at):
    return songbook.parse(sql(spark, at, BOOK.format(each="explode(array(0, 1, 2, 3))")), ["book"])


@query("SELECT 'counter' AS part, 'rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM nation UNION ALL SELECT 'caveat', CAST(n_nationkey AS VARCHAR), concat('L', n_nationkey, ': empty artist for code x') FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'sample', CAST(n_nationkey AS VARCHAR), concat('{\"line_no\":', n_nationkey, ',\"tj\":\"x\",\"artist\":\"', CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END, '\"}') FROM nation WHERE n_nationkey < 20")
def ingest_report(spark, at):
    r = sql(spark, at, "SELECT CAST(n_nationkey AS BIGINT) AS line_no, 'x' AS tj, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS artist FROM nation")
    return sinks.ingest_report(r, songbook.caveats(r), enrich.counters(r, rows=F.lit(True)))


@query("""
SELECT concat('tjpdf-', 50000 + p_partkey % 40000) AS id, CASE WHEN p_partkey % 3 = 0 THEN concat('夢', p_partkey) ELSE p_name END AS title_primary, p_brand AS artist_primary, s AS category, CASE WHEN p_partkey % 2 = 0 THEN 'then' ELSE 'now' END AS crawled_at
FROM (SELECT *, coalesce(last_value(CASE WHEN p_partkey % 50 = 0 THEN 'vocaloid' WHEN p_partkey % 50 = 25 THEN 'anime' END IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey ROWS UNBOUNDED PRECEDING), 'anime') AS s FROM part)
WHERE p_partkey % 7 <> 0 AND p_brand <> 'Brand#12' AND p_partkey < 40000""")
def songbook_records(spark, at):
    lines = sql(spark, at, BOOK.format(each="explode(array(0, 1, 2, 3))") .replace("FROM part)", "FROM part WHERE p_partkey < 40000)"))
    before = sql(spark, at, "SELECT p_partkey AS seq, concat(CASE WHEN p_partkey % 7 = 0 THEN 'blog-' WHEN p_partkey % 2 = 0 THEN 'tjpdf-' ELSE 'none-' END, p_partkey) AS id, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 2 = 0 THEN CAST(50000 + p_partkey % 40000 AS VARCHAR) END AS tj, p_brand AS artist_primary, 'then' AS crawled_at FROM part WHERE p_partkey < 40000").withColumn("artist_aliases", F.lit(None).cast("array<string>"))
    keys = spark.createDataFrame([("brand#12",)], "key string")
    out = crawls.songbook_ingest(lines, ["book"], before, keys, "u", "now")
    return out.select("id", "title_primary", "artist_primary", F.col("categories")[0].alias("category"), "crawled_at")


# ---- the crawl jobs


@query("""
WITH p AS (SELECT p_partkey AS k, p_name, p_brand, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'vocaloid' WHEN p_partkey % 2 = 0 THEN 'jpop' ELSE 'vocaloid' END AS c FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND p_partkey % 30 <> 0 AND p_partkey NOT IN (98, 417))
SELECT concat('blog-', k, '-', r) AS id, CASE r WHEN 1 THEN p_name ELSE concat(p_name, ' II') END AS title_primary, p_brand AS artist_primary, CASE WHEN k IN (105, 101, 112) THEN 'jpop' ELSE c END AS category, CASE WHEN length(CAST(k AS VARCHAR)) <= 6 THEN CAST(k AS VARCHAR) END AS tj FROM p, (SELECT unnest([1, 4]) AS r)""")
def blog_crawl(spark, at):
    each = "SELECT concat_ws('', sort_array(collect_list(concat('<a href=\"/', p_partkey, '\">', p_name, '</a>')))) AS a FROM part WHERE p_partkey % {} = 0"
    index = sql(spark, at, f"SELECT 0 AS index, '/98' AS path, 'jpop' AS category, 200 AS status, a AS html FROM ({each.format(2)}) UNION ALL SELECT 1, '/417', 'vocaloid', 200, a FROM ({each.format(3)})")
    pages = sql(spark, at, f"SELECT concat('/', p_partkey) AS path, CASE WHEN p_partkey % 30 = 0 THEN 503 ELSE 200 END AS status, {PARTS_PAGE} AS html FROM part")
    out = crawls.blog_crawl(stage(index, "crawl-index"), pages, "now", body_class="body")
    return out.select("id", "title_primary", "artist_primary", F.col("categories")[0].alias("category"), "tj")


@query("""
SELECT concat('tj-', p_partkey) AS id, p_name AS title_primary, CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_partkey % 5 <> 0 THEN concat('c', p_size) END AS title_ko
FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 2 = 0 AND p_partkey % 7 = 0 OR p_partkey % 17 = 0)""")
def catalogue_crawl(spark, at):
    # a third of the artists are Japanese, of the others some numbers are, or the blog has them
    artist = "CASE WHEN p_partkey % 13 = 0 THEN 'BTS' WHEN p_partkey % 3 = 0 THEN concat('J', p_partkey) ELSE concat('U', p_partkey) END"
    items = sql(spark, at, f"SELECT 'u' AS source_url, CAST(p_partkey AS VARCHAR) AS pro, p_name AS title, {artist} AS artist FROM part")
    numbers = sql(spark, at, f"SELECT CAST(p_partkey AS VARCHAR) AS pro, CASE WHEN p_partkey % 11 = 0 THEN 'KOR' WHEN p_partkey % 7 = 0 THEN 'JPN' END AS nationalcode, p_type AS sort_title_ko, 'a' AS sort_song_ko, CASE WHEN p_partkey % 2 = 0 THEN {NOW.replace('06-01', '05-20')} END AS last_seen FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 11 = 0")
    artists = sql(spark, at, f"SELECT concat('j', p_partkey) AS key, 'JPN' AS code, CAST(5 AS BIGINT) AS jpn, CAST(0 AS BIGINT) AS kor, CAST(0 AS BIGINT) AS eng, {NOW.replace('06-01', '05-20')} AS last_seen FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0")
    header = spark.range(1).select(F.lit(None).cast("timestamp").alias("bootstrapped_at"), F.lit(None).cast("timestamp").alias("generated_at"))
    charts = sql(spark, at, "SELECT concat('J', p_partkey) AS artist, 'jpn' AS genre, k AS pro, true AS ok FROM (SELECT *, explode(array(1, 2, 3, 4)) AS k FROM part) WHERE p_partkey % 3 = 0 AND p_partkey % 4 = 1")
    scans = sql(spark, at, "SELECT concat('j', p_partkey) AS key, true AS ok, 9 AS jpn, 1 AS kor, 0 AS eng FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 4 = 3")
    searches = sql(spark, at, "SELECT p_name AS search, 0 AS pos, CAST(p_partkey AS VARCHAR) AS pro, 'JPN' AS nationalcode, concat('c', p_size) AS sort_title_ko, 'b' AS sort_song_ko, p_partkey % 5 <> 0 AS ok FROM part")
    previous = sql(spark, at, "SELECT CAST(p_partkey AS VARCHAR) AS tj, 'Somebody' AS artist_primary FROM part WHERE p_partkey % 17 = 0")
    out, _, _ = crawls.catalogue_crawl(items, crawls.State(numbers, artists, header), charts, scans, searches, previous, "2026-06-01 00:00:00")
    return out.select("id", "title_primary", "title_ko")
