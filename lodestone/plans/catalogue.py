"""The catalogue engine's queries over the driver's tables, and the same in DuckDB SQL.

The tables know no songs, so each query gives the operators' roles to columns of theirs; RECS makes song-like records
of documents in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules, text
from lodestone.operators import aliases, changes, classify, merge, ordered, search, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def t(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


RECS = """
SELECT doc_id AS seq,
  concat(CASE doc_id % 4 WHEN 0 THEN 'blog' WHEN 1 THEN 'namu' WHEN 2 THEN 'tj' ELSE 'tjpdf' END, '-', doc_id) AS id,
  concat('http://x/', doc_id) AS source_url,
  split_part(text, chr(10), 1) AS title_primary,
  concat(source, CASE WHEN doc_id % 5 = 0 THEN concat(' (Feat. ', lang, ')') WHEN doc_id % 5 = 1 THEN concat(' & ', lang) ELSE '' END) AS artist_primary,
  CASE WHEN lang = 'en' THEN NULL ELSE substr(text, 1, 20) END AS title_ko,
  CASE WHEN n_chars % 2 = 0 THEN lang ELSE NULL END AS artist_ko,
  md5(text) AS tj, md5(split_part(text, chr(10), -1)) AS ky, CAST(NULL AS VARCHAR(10)) AS joysound,
  CASE n_chars % 3 WHEN 0 THEN 'jpop' WHEN 1 THEN 'vocaloid' ELSE 'anime' END AS category,
  concat('2026-01-', lpad(CAST(1 + doc_id % 28 AS VARCHAR(2)), 2, '0')) AS crawled_at,
  CASE WHEN doc_id % 6 = 0 THEN concat('(', lang, ')') ELSE NULL END AS media_context_ko,
  CASE WHEN lang = 'en' THEN NULL WHEN doc_id % 3 = 0 THEN 'manual' ELSE 'llm-translated' END AS title_ko_source,
  CASE WHEN lang <> 'en' AND doc_id % 3 = 1 THEN 'high' ELSE NULL END AS title_ko_confidence
FROM documents
"""
#: The same with hard keys of every seventh document only and short titles, so that the softer tiers have work.
SOFT = RECS.replace("md5(text) AS tj, md5(split_part(text, chr(10), -1)) AS ky", "CASE WHEN doc_id % 7 = 0 THEN md5(text) END AS tj, CASE WHEN doc_id % 7 = 0 THEN md5(split_part(text, chr(10), -1)) END AS ky").replace("split_part(text, chr(10), 1) AS title_primary", "substr(text, 1, 2) AS title_primary")


def recs(spark: SparkSession, at: str, sql: str = RECS) -> DataFrame:
    out = spark.sql(sql.replace("FROM documents", "FROM {documents}").replace("VARCHAR(10)", "STRING").replace("VARCHAR(2)", "STRING"), documents=t(spark, at, "documents"))
    return out.withColumns({"categories": F.array("category"), "artist_aliases": F.array("artist_ko", "title_ko_source")}).withColumn("artist_aliases", F.filter("artist_aliases", lambda x: x.isNotNull())).drop("category")


KEY = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')"
MATCH = "lower(regexp_replace({}, '\\s+', '', 'g'))"


@query(f"SELECT doc_id AS id, {KEY.format('text')} AS k FROM documents UNION ALL SELECT p_partkey, {KEY.format('p_name')} FROM part")
def normalize_key(spark, at):
    rows = t(spark, at, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("x")).union(t(spark, at, "part").select("p_partkey", "p_name"))
    return rows.select("id", text.identity_key(F.col("x")).alias("k"))


@query(f"SELECT p_partkey AS id, {MATCH.format('p_name')} AS k FROM part UNION ALL SELECT s_suppkey, {MATCH.format('s_name')} FROM supplier")
def match_key(spark, at):
    rows = t(spark, at, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("x")).union(t(spark, at, "supplier").select("s_suppkey", "s_name"))
    return rows.select("id", text.match_key(F.col("x")).alias("k"))


SPLITS = """
w AS (SELECT seq, trim(artist_primary) AS whole FROM r),
p AS (SELECT seq, whole, regexp_extract_all(whole, '(?i)\\(\\s*feat\\.\\s*([^()]+?)\\s*\\)', 1) AS guests,
        trim(regexp_replace(whole, '(?i)\\s*\\(\\s*feat\\.\\s*([^()]+?)\\s*\\)\\s*', ' ', 'g')) AS main FROM w),
c AS (SELECT seq, list_concat([whole], list_filter(list_transform(regexp_split_to_array(main, '\\s*[&,]\\s*'), lambda x: trim(x)), lambda x: x <> ''), guests) AS raw FROM p),
u AS (SELECT seq, list_filter(raw, lambda x, i: list_position(list_transform(raw, lambda y: lower(replace(y, ' ', ''))), lower(replace(x, ' ', ''))) = i) AS parts FROM c)
"""


@query(f"WITH r AS ({RECS}), {SPLITS} SELECT seq, list_aggregate(parts, 'string_agg', ';') AS parts FROM u")
def collab_split(spark, at):
    return text.split_collab(recs(spark, at).select("seq", "artist_primary"), "artist_primary").select("seq", F.array_join("parts", ";").alias("parts"))


@query(f"WITH r AS ({RECS}), {SPLITS} SELECT seq, lower(replace(coalesce(parts[2], parts[1], ''), ' ', '')) AS lead FROM u")
def lead_component(spark, at):
    parts = text.split_collab(recs(spark, at).select("seq", "artist_primary"), "artist_primary")
    return parts.select("seq", text.lead(F.col("parts")).alias("lead"))


COMPS = """
v AS (SELECT seq, 'tj' AS vendor, tj AS value FROM r WHERE tj IS NOT NULL UNION ALL SELECT seq, 'ky', ky FROM r WHERE ky IS NOT NULL),
s AS (SELECT v.seq AS a, m.least AS b FROM v JOIN (SELECT vendor, value, min(seq) AS least FROM v GROUP BY ALL) m USING (vendor, value) WHERE v.seq <> m.least),
e AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT r.seq, least(r.seq, coalesce(min(reach.b), r.seq)) AS comp FROM r LEFT JOIN reach ON r.seq = reach.a GROUP BY r.seq)
"""


@query(f"WITH RECURSIVE r AS ({RECS}), {COMPS} SELECT seq, comp FROM comp")
def tier_a_components(spark, at):
    return merge.hard_key_components(recs(spark, at))


TIERS = f"""
{COMPS}, {SPLITS},
k AS (SELECT r.*, comp, count(*) OVER (PARTITION BY comp) AS size, split_part(id, '-', 1) AS slug,
        {KEY.format('title_primary')} AS kt, {KEY.format('artist_primary')} AS ka, lower(replace(coalesce(parts[2], parts[1], ''), ' ', '')) AS kl
      FROM r JOIN comp USING (seq) JOIN u USING (seq)),
kb AS (SELECT *, kt || '|' || ka AS key_b, CASE WHEN kt <> '' AND kl <> '' THEN kt || '|' || kl END AS key_c FROM k),
gb AS (SELECT key_b, min(seq) AS least_b FROM kb WHERE size = 1 GROUP BY key_b HAVING count(*) > 1),
wb AS (SELECT kb.*, CASE WHEN size = 1 THEN least_b END AS lb FROM kb LEFT JOIN gb USING (key_b)),
gc AS (SELECT key_c, min(seq) AS least_c FROM wb WHERE size = 1 AND lb IS NULL AND key_c IS NOT NULL GROUP BY key_c
       HAVING count(*) > 1 AND (count(DISTINCT slug) >= 2 OR (count(*) FILTER (WHERE regexp_matches(artist_primary, '(?i)\\(feat')) = 1 AND bool_and(category = 'vocaloid')))),
x AS (SELECT wb.*, CASE WHEN size = 1 AND lb IS NULL THEN least_c END AS lc FROM wb LEFT JOIN gc USING (key_c)),
cl AS (SELECT *, coalesce(lb, lc, comp) AS cluster, CASE WHEN size > 1 THEN 'A' WHEN lb IS NOT NULL THEN 'B' WHEN lc IS NOT NULL THEN 'C' END AS tier,
         CASE slug WHEN 'blog' THEN 1 WHEN 'namu' THEN 2 WHEN 'tj' THEN 3 ELSE 2147483647 END AS rank,
         CASE slug WHEN 'tj' THEN 0 WHEN 'blog' THEN 1 WHEN 'namu' THEN 2 ELSE 2147483647 END AS rn,
         CASE slug WHEN 'blog' THEN 0 WHEN 'namu' THEN 1 WHEN 'tj' THEN 2 ELSE 2147483647 END AS rk FROM x)
"""


@query(f"WITH RECURSIVE r AS ({SOFT}), {TIERS} SELECT seq, cluster, tier FROM cl WHERE tier IS DISTINCT FROM 'A'")
def tier_b_c_groups(spark, at):
    return merge.clusters(recs(spark, at, SOFT)).where("NOT tier <=> 'A'").select("seq", "cluster", "tier")


@query(f"""
WITH RECURSIVE r AS ({SOFT}), {TIERS},
d AS (SELECT *, CASE WHEN rk < 3 AND title_ko IS NOT NULL THEN 0 WHEN rk < 3 AND media_context_ko IS NOT NULL THEN 1 WHEN media_context_ko IS NOT NULL THEN 2 END AS step FROM cl),
n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY step NULLS LAST, CASE WHEN step < 2 THEN rk ELSE 0 END, seq) AS dn FROM d)
SELECT cluster, max(tier) AS tier, arg_min(id, {{'r': rank, 's': seq}}) AS id, arg_min(source_url, {{'r': rank, 's': seq}}) AS source_url,
  arg_min(title_primary, {{'r': rn, 's': seq}}) AS title_primary,
  arg_min(title_ko, {{'r': rk, 's': seq}}) FILTER (WHERE title_ko IS NOT NULL) AS title_ko,
  arg_min(artist_primary, {{'r': rn, 's': seq}}) AS artist_primary,
  arg_min(artist_ko, {{'r': rk, 's': seq}}) FILTER (WHERE artist_ko IS NOT NULL) AS artist_ko,
  arg_min(tj, {{'r': rank, 's': seq}}) FILTER (WHERE tj IS NOT NULL) AS tj,
  arg_min(ky, {{'r': rank, 's': seq}}) FILTER (WHERE ky IS NOT NULL) AS ky,
  CASE WHEN bool_or(category = 'vocaloid') THEN 'vocaloid' WHEN bool_or(category = 'anime') THEN 'anime' ELSE 'jpop' END AS category,
  max(crawled_at) AS crawled_at,
  max(media_context_ko) FILTER (WHERE dn = 1 AND step IS NOT NULL) AS media_context_ko,
  max(title_ko_source) FILTER (WHERE dn = 1 AND step IS NOT NULL) AS title_ko_source,
  max(title_ko_confidence) FILTER (WHERE dn = 1 AND step IS NOT NULL) AS title_ko_confidence
FROM n GROUP BY cluster
""")
def merge_records(spark, at):
    out = merge.merge(merge.clusters(recs(spark, at, SOFT)))
    cols = ["cluster", "tier", "id", "source_url", "title_primary", "title_ko", "artist_primary", "artist_ko", "tj", "ky"]
    return out.select(*cols, F.col("categories")[0].alias("category"), "crawled_at", "media_context_ko", "title_ko_source", "title_ko_confidence")


@query(f"""
WITH RECURSIVE r AS ({RECS}), {TIERS},
d AS (SELECT *, CASE WHEN rk < 3 AND title_ko IS NOT NULL THEN 0 WHEN rk < 3 AND media_context_ko IS NOT NULL THEN 1 WHEN media_context_ko IS NOT NULL THEN 2 END AS step FROM cl),
n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY step NULLS LAST, CASE WHEN step < 2 THEN rk ELSE 0 END, seq) AS dn FROM d)
SELECT cluster, max(tier) AS tier, arg_min(id, {{'r': rank, 's': seq}}) AS id, arg_min(source_url, {{'r': rank, 's': seq}}) AS source_url,
  arg_min(title_primary, {{'r': rn, 's': seq}}) AS title_primary,
  arg_min(title_ko, {{'r': rk, 's': seq}}) FILTER (WHERE title_ko IS NOT NULL) AS title_ko,
  arg_min(artist_primary, {{'r': rn, 's': seq}}) AS artist_primary,
  arg_min(artist_ko, {{'r': rk, 's': seq}}) FILTER (WHERE artist_ko IS NOT NULL) AS artist_ko,
  arg_min(tj, {{'r': rank, 's': seq}}) FILTER (WHERE tj IS NOT NULL) AS tj,
  arg_min(ky, {{'r': rank, 's': seq}}) FILTER (WHERE ky IS NOT NULL) AS ky,
  CASE WHEN bool_or(category = 'vocaloid') THEN 'vocaloid' WHEN bool_or(category = 'anime') THEN 'anime' ELSE 'jpop' END AS category,
  max(crawled_at) AS crawled_at,
  max(media_context_ko) FILTER (WHERE dn = 1 AND step IS NOT NULL) AS media_context_ko,
  max(title_ko_source) FILTER (WHERE dn = 1 AND step IS NOT NULL) AS title_ko_source,
  max(title_ko_confidence) FILTER (WHERE dn = 1 AND step IS NOT NULL) AS title_ko_confidence
FROM n GROUP BY cluster
""")
def merge_hard_keys(spark, at):
    out = merge.merge(merge.clusters(recs(spark, at)))
    cols = ["cluster", "tier", "id", "source_url", "title_primary", "title_ko", "artist_primary", "artist_ko", "tj", "ky"]
    return out.select(*cols, F.col("categories")[0].alias("category"), "crawled_at", "media_context_ko", "title_ko_source", "title_ko_confidence")


@query(f"""
WITH RECURSIVE r AS ({SOFT}), {TIERS},
al AS (SELECT cluster, seq, 0 AS pos, artist_ko AS a FROM cl WHERE artist_ko IS NOT NULL UNION ALL SELECT cluster, seq, 1, title_ko_source FROM cl WHERE title_ko_source IS NOT NULL),
f AS (SELECT cluster, a, min({{'s': seq, 'p': CASE WHEN pos = 1 AND NOT has THEN 0 ELSE pos END}}) AS o FROM al JOIN (SELECT seq, artist_ko IS NOT NULL AS has FROM r) USING (seq) GROUP BY cluster, a)
SELECT cluster, string_agg(a, ';' ORDER BY o) AS aliases FROM f GROUP BY cluster
""")
def merge_aliases(spark, at):
    out = merge.merge(merge.clusters(recs(spark, at, SOFT)))
    return out.where("artist_aliases IS NOT NULL").select("cluster", F.array_join("artist_aliases", ";").alias("aliases"))


@query(f"""
WITH RECURSIVE r AS ({SOFT}), {TIERS},
tc AS (SELECT cluster, arg_min(key_c, seq) AS cluster_key, 'tier_c_merge' AS field, string_agg(slug || '=' || id, ';' ORDER BY seq) AS vals, arg_min(id, {{'r': rank, 's': seq}}) AS winner FROM cl WHERE tier = 'C' GROUP BY cluster),
b AS (SELECT cluster, arg_min(key_b, seq) AS cluster_key FROM cl WHERE tier IN ('B', 'C') GROUP BY cluster),
tv AS (SELECT cluster, 'tj' AS field, string_agg(slug || '=' || tj, ';' ORDER BY seq) AS vals, arg_min(tj, {{'r': rank, 's': seq}}) AS winner FROM cl WHERE tier IN ('B', 'C') AND tj IS NOT NULL GROUP BY cluster HAVING count(DISTINCT tj) > 1
  UNION ALL SELECT cluster, 'ky', string_agg(slug || '=' || ky, ';' ORDER BY seq), arg_min(ky, {{'r': rank, 's': seq}}) FROM cl WHERE tier IN ('B', 'C') AND ky IS NOT NULL GROUP BY cluster HAVING count(DISTINCT ky) > 1)
SELECT cluster_key, field, vals, winner FROM tc UNION ALL SELECT cluster_key, field, vals, winner FROM tv JOIN b USING (cluster)
""")
def merge_conflicts(spark, at):
    out = merge.conflicts(merge.clusters(recs(spark, at, SOFT)))
    return out.select("cluster_key", "field", F.expr("array_join(transform(values, v -> concat(v.source, '=', v.value)), ';')").alias("vals"), "winner")


NAMES = "SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, '｜', p_name) WHEN p_partkey % 3 = 1 THEN p_name ELSE p_brand END AS artist_primary FROM part"
PAIRS = f"""
n AS ({NAMES}),
s AS (SELECT seq, trim(split_part(artist_primary, '｜', 1)) AS canonical, trim(split_part(artist_primary, '｜', 2)) AS alias FROM n WHERE contains(artist_primary, '｜')),
p AS (SELECT *, {KEY.format('canonical')} AS canonical_key, {KEY.format('alias')} AS alias_key FROM s),
f AS (SELECT canonical_key, arg_min(canonical, seq) AS surface FROM p GROUP BY canonical_key),
l AS (SELECT alias_key, canonical_key, min(seq) AS first, arg_min(alias, seq) AS alias FROM p WHERE alias_key <> '' AND alias_key <> canonical_key GROUP BY alias_key, canonical_key),
m AS (SELECT alias_key, arg_min(alias, first) AS alias, count(*) AS n, string_agg(surface, ';' ORDER BY surface) AS canonicals, CASE WHEN count(*) = 1 THEN min(canonical_key) END AS canonical_key FROM l JOIN f USING (canonical_key) GROUP BY alias_key),
ka AS (SELECT canonical_key, alias, min(seq) AS place FROM p GROUP BY ALL)
"""


def names(spark, at):
    return spark.sql(NAMES.replace("FROM part", "FROM {part}"), part=t(spark, at, "part")).withColumn("artist_aliases", F.lit(None).cast("array<string>"))


@query(f"WITH {PAIRS} SELECT alias_key, alias, n, canonicals, canonical_key FROM m")
def alias_map(spark, at):
    return aliases.alias_map(aliases.piped(names(spark, at))).withColumn("canonicals", F.array_join("canonicals", ";"))


@query(f"WITH {PAIRS}, b AS (SELECT {KEY.format('artist_primary')} AS alias_key, count(*) AS affected FROM n WHERE NOT contains(artist_primary, '｜') GROUP BY 1) SELECT alias, canonicals, coalesce(affected, 0) AS affected FROM m LEFT JOIN b USING (alias_key) WHERE n > 1")
def alias_collisions(spark, at):
    return aliases.resolve(names(spark, at))[1].withColumn("canonicals", F.array_join("canonicals", ";"))


@query(f"""
WITH {PAIRS}, kn AS (SELECT canonical_key, list(alias ORDER BY place) AS known FROM ka GROUP BY canonical_key),
x AS (SELECT n.seq, coalesce(s.canonical, n.artist_primary) AS a, s.alias AS had, {KEY.format('coalesce(s.canonical, n.artist_primary)')} AS k FROM n LEFT JOIN s ON n.seq = s.seq),
j AS (SELECT x.*, m.canonical_key AS ck, m.n AS mn, own.known AS own FROM x LEFT JOIN m ON k = m.alias_key LEFT JOIN kn own ON k = own.canonical_key)
SELECT j.seq, CASE WHEN mn > 1 OR own IS NOT NULL THEN a ELSE coalesce(f.surface, a) END AS artist_primary,
  list_aggregate(CASE WHEN mn > 1 THEN CASE WHEN had IS NULL THEN NULL ELSE [had] END
    WHEN own IS NOT NULL THEN list_concat(CASE WHEN had IS NULL THEN [] ELSE [had] END, list_filter(own, lambda y: y <> a AND y IS DISTINCT FROM had))
    WHEN f.surface IS NOT NULL THEN list_concat([a], list_filter(kn.known, lambda y: y <> a AND y <> f.surface))
    ELSE CASE WHEN had IS NULL THEN NULL ELSE [had] END END, 'string_agg', ';') AS artist_aliases
FROM j LEFT JOIN f ON j.ck = f.canonical_key LEFT JOIN kn ON j.ck = kn.canonical_key
""")
def alias_rekey(spark, at):
    out = aliases.resolve(names(spark, at))[0]
    return out.select("seq", "artist_primary", F.array_join("artist_aliases", ";").alias("artist_aliases"))


@query("SELECT c_custkey AS seq, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS artist_primary, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS alias FROM customer")
def canonicalise(spark, at):
    rows = t(spark, at, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("artist_primary"), F.lit(None).cast("array<string>").alias("artist_aliases"))
    out = aliases.canonicalise(rows, {"BUILDING": "Building", "MACHINERY": "Machines"})
    return out.select("seq", "artist_primary", F.try_element_at("artist_aliases", F.lit(1)).alias("alias"))


CHAIN = """
SELECT o_orderkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'reject' WHEN o_orderpriority = '1-URGENT' THEN 'reject' WHEN n_regionkey = 2 THEN 'admit'
    WHEN o_orderpriority = '2-HIGH' THEN 'admit' WHEN o_totalprice > 300000 THEN 'admit' ELSE 'drop' END AS verdict,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'drop_list' WHEN o_orderpriority = '1-URGENT' THEN 'pro_kor' WHEN n_regionkey = 2 THEN 'artist'
    WHEN o_orderpriority = '2-HIGH' THEN 'pro' WHEN o_totalprice > 300000 THEN 'rescue' END AS step
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
"""


@query(CHAIN)
def classify_chain(spark, at):
    j = t(spark, at, "orders").join(t(spark, at, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(t(spark, at, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    pro = F.when(F.col("o_orderpriority") == "1-URGENT", "KOR").when(F.col("o_orderpriority") == "2-HIGH", "JPN")
    lead_code = F.when(F.col("n_regionkey") == 2, "JPN")
    verdict, step = classify.chain(classify.admit_steps(F.array("c_mktsegment"), pro, lead_code, F.col("o_totalprice") > 300000, ["MACHINERY"]))
    return j.select("o_orderkey", verdict.alias("verdict"), step.alias("step"))


@query(f"SELECT verdict, step, count(*) AS n FROM ({CHAIN}) GROUP BY verdict, step")
def keep_stats(spark, at):
    return classify.keep_stats(classify_chain(spark, at))


CODES = "CASE n_regionkey WHEN 0 THEN 'JPN' WHEN 1 THEN 'KOR' WHEN 2 THEN 'ENG' END"
TALLY = f"SELECT l_partkey AS key, count(*) FILTER (WHERE code = 'JPN') AS jpn, count(*) FILTER (WHERE code = 'KOR') AS kor, count(*) FILTER (WHERE code = 'ENG') AS eng FROM (SELECT l_partkey, {CODES} AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) GROUP BY l_partkey"


def votes(spark, at):
    codes = t(spark, at, "supplier").join(F.broadcast(t(spark, at, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.expr(CODES).alias("code"))
    return classify.tally(t(spark, at, "lineitem").select("l_partkey", "l_suppkey").join(codes, "l_suppkey"), "l_partkey", "code").withColumnRenamed("l_partkey", "key")


@query(TALLY)
def vote_tally(spark, at):
    return votes(spark, at)


@query(f"SELECT key, CASE WHEN jpn >= 3 AND 10 * jpn >= 7 * (jpn + kor) THEN 'JPN' WHEN kor >= 3 AND 10 * kor >= 7 * (jpn + kor) THEN 'KOR' WHEN jpn >= 3 AND kor >= 3 THEN 'AMBIGUOUS' WHEN eng > 0 AND jpn + kor = 0 THEN 'ENG' ELSE 'UNKNOWN' END AS code FROM ({TALLY})")
def vote_verdict(spark, at):
    return votes(spark, at).select("key", classify.verdict(F.col("jpn"), F.col("kor"), F.col("eng")).alias("code"))


CHART = "SELECT l_suppkey AS key, l_returnflag AS genre, count(DISTINCT l_partkey) AS votes FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01' GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 3"


def chart(spark, at):
    half = t(spark, at, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1996-07-01'")
    return classify.chart_votes(half.withColumnsRenamed({"l_suppkey": "key", "l_returnflag": "genre"}), ["key", "genre"], "l_partkey")


@query(CHART)
def chart_votes(spark, at):
    return chart(spark, at)


@query(f"""
WITH c AS ({CHART}), s AS (SELECT s_suppkey AS key, s_suppkey % 3 AS jpn, s_suppkey % 2 AS kor, CASE WHEN s_suppkey % 11 = 0 THEN 1 ELSE 0 END AS eng FROM supplier),
j AS (SELECT key, CASE WHEN votes IS NOT NULL AND kor = 0 AND eng = 0 THEN greatest(jpn, least(votes, 5)) ELSE jpn END AS jpn, kor, eng FROM s LEFT JOIN (SELECT * FROM c WHERE genre = 'A') USING (key))
SELECT key, jpn, CASE WHEN votes IS NOT NULL AND jpn = 0 AND eng = 0 THEN greatest(kor, least(votes, 5)) ELSE kor END AS kor, CAST(eng AS BIGINT) AS eng FROM j LEFT JOIN (SELECT * FROM c WHERE genre = 'R') USING (key)
""")
def chart_merge(spark, at):
    found = chart(spark, at)
    state = t(spark, at, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 3).alias("jpn"), (F.col("s_suppkey") % 2).alias("kor"), F.when(F.col("s_suppkey") % 11 == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("eng"))
    japan = classify.merge_votes(state, found.where("genre = 'A'").select("key", "votes"), "jpn", 5)
    return classify.merge_votes(japan, found.where("genre = 'R'").select("key", "votes"), "kor", 5)


@query("SELECT w AS week, CAST(CAST(DATE '2026-03-15' - CAST(7 * w + 6 AS INTEGER) AS DATE) AS VARCHAR) AS first, CAST(CAST(DATE '2026-03-15' - CAST(7 * w AS INTEGER) AS DATE) AS VARCHAR) AS last FROM range(104) x(w)")
def trailing_weeks(spark, at):
    weeks = classify.trailing_weeks(spark, "2026-03-15", 104)
    return weeks.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query("SELECT user_id, max(ts) AS last_seen, coalesce(epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(max(ts)) < 7 * 86400000, false) AS fresh FROM events GROUP BY user_id")
def ttl_refresh(spark, at):
    seen = t(spark, at, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return seen.withColumn("fresh", classify.is_fresh(F.col("last_seen"), F.lit("2024-02-01").cast("timestamp"), rules.BOOTSTRAP_DAYS))


CATS = "CASE event_type WHEN 'click' THEN 'jpop' WHEN 'view' THEN 'anime' WHEN 'purchase' THEN 'vocaloid' ELSE event_type END"


@query(f"""
WITH e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {CATS} AS c FROM events), g AS (SELECT user_id, day, list(DISTINCT c) AS l FROM e GROUP BY ALL)
SELECT user_id, day, list_aggregate(list_sort(CASE WHEN list_contains(l, 'vocaloid') THEN list_filter(l, lambda x: x NOT IN ('anime', 'jpop')) WHEN list_contains(l, 'anime') THEN list_filter(l, lambda x: x <> 'jpop') ELSE l END), 'string_agg', ';') AS categories FROM g
""")
def category_exclusive(spark, at):
    rows = t(spark, at, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), F.expr(CATS).alias("c"))
    return rows.groupBy("user_id", "day").agg(F.array_join(text.exclusive(F.collect_set("c")), ";").alias("categories"))


def bm25(terms: str, fields: str, match: str) -> str:
    return f"""
WITH x AS (SELECT p_partkey AS id, 'title' AS field, p_name AS s FROM part UNION ALL SELECT p_partkey, 'artist', p_brand FROM part),
w AS (SELECT id, field, {KEY.format("unnest(regexp_split_to_array(s, '[\\s\\p{P}\\p{Z}]+'))")} AS term FROM x),
i AS (SELECT id, field, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
l AS (SELECT id, field, sum(tf) AS length FROM i GROUP BY ALL), st AS (SELECT field, count(*) AS docs, avg(length) AS mean FROM l GROUP BY field),
df AS (SELECT field, term, count(*) AS df FROM i GROUP BY ALL), q AS (SELECT unnest({terms}) AS q),
m AS (SELECT q, term, CASE WHEN term = q THEN 1.0{match} END AS weight FROM (SELECT DISTINCT term FROM i), q)
SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) * CASE field WHEN 'title' THEN 3.0 WHEN 'artist' THEN 2.0 ELSE 1.0 END * weight), 6) AS score
FROM i JOIN l USING (id, field) JOIN st USING (field) JOIN df USING (field, term) JOIN m USING (term) WHERE weight IS NOT NULL GROUP BY id"""


PREFIX_SQL = " WHEN starts_with(term, q) THEN 0.375 * length(q) / length(term)"
FUZZY_SQL = " WHEN round(length(q) * 0.2) > 0 AND abs(length(term) - length(q)) <= round(length(q) * 0.2) AND levenshtein(term, q) <= round(length(q) * 0.2) THEN 0.45 * (1 - levenshtein(term, q) / length(q))"


def part_index(spark, at):
    rows = t(spark, at, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return search.postings(rows, "id", ["title", "artist"])


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("id", F.round("score", 6).alias("score"))


@query(bm25("['steel', 'small']", "", ""))
def search_exact(spark, at):
    return _rounded(search.search(part_index(spark, at), ["steel", "small"], prefix=False, fuzzy=0))


@query(bm25("['sm', 'w', 'bran']", "", PREFIX_SQL))
def search_prefix(spark, at):
    return _rounded(search.search(part_index(spark, at), ["sm", "w", "bran"], fuzzy=0))


@query(bm25("['smull', 'anvli', 'widgit', 'brant']", "", PREFIX_SQL + FUZZY_SQL))
def search_fuzzy(spark, at):
    return _rounded(search.search(part_index(spark, at), ["smull", "anvli", "widgit", "brant"]))


@query(f"SELECT id, score FROM ({bm25(chr(91) + chr(39) + 'sm' + chr(39) + chr(93), '', PREFIX_SQL)}) ORDER BY score DESC, id LIMIT 50")
def search_topk(spark, at):
    return search.top(_rounded(search.search(part_index(spark, at), ["sm"], fuzzy=0)))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_category(spark, at):
    return t(spark, at, "orders").where(changes.has_category(F.array("o_orderstatus"), "F")).select("o_orderkey", "o_orderstatus")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_partkey END AS tj, CASE WHEN l_linestatus = 'O' AND l_quantity > 40 THEN l_suppkey END AS ky FROM lineitem) SELECT * FROM x WHERE tj IS NOT NULL OR ky IS NOT NULL")
def filter_vendor_or(spark, at):
    x = t(spark, at, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("tj"), F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), F.col("l_suppkey")).alias("ky"))
    return x.where(changes.any_vendor(["tj", "ky"]))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_favorites(spark, at):
    urgent = t(spark, at, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return changes.within(t(spark, at, "customer").select("c_custkey", "c_name"), urgent, "c_custkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, c_name FROM customer QUALIFY rank <= 50")
def hydrate_ranked(spark, at):
    cust = t(spark, at, "customer")
    best = cust.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(50).select("c_custkey", "c_acctbal")
    from pyspark.sql import Window

    hits = best.select("c_custkey", F.row_number().over(Window.orderBy(F.col("c_acctbal").desc(), "c_custkey")).cast("long").alias("rank"))
    return changes.hydrate(hits, cust.select("c_custkey", "c_name"), "c_custkey", "rank")


@query("""
WITH old AS (SELECT p_partkey AS k, p_partkey AS ord, p_name AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 0),
new AS (SELECT p_partkey AS k, p_partkey AS ord, upper(p_name) AS name, p_size + 1 AS size FROM part WHERE p_partkey % 2 = 0)
SELECT old.k, old.ord, coalesce(new.name, old.name) AS name, old.size FROM old LEFT JOIN new USING (k) UNION ALL SELECT new.k, new.ord, new.name, new.size FROM new WHERE k NOT IN (SELECT k FROM old)
""")
def upsert_patch_insert(spark, at):
    p = t(spark, at, "part").select(F.col("p_partkey").alias("k"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    new = p.where("k % 2 = 0").select("k", "ord", F.upper("name").alias("name"), (F.col("size") + 1).alias("size"))
    return changes.upsert(p.where("k % 3 <> 0"), new, "k", ["name"], "ord")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def drop_list_anti(spark, at):
    dropped = t(spark, at, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return changes.without(t(spark, at, "customer").select("c_custkey", "c_nationkey"), dropped, "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'A')")
def prune_semi(spark, at):
    used = t(spark, at, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("s_suppkey"))
    return changes.within(t(spark, at, "supplier").select("s_suppkey", "s_name"), used, "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def disappeared(spark, at):
    return changes.without(t(spark, at, "customer").select("c_custkey"), t(spark, at, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT doc_id, md5(text) AS k FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def dedupe_keep_first(spark, at):
    rows = t(spark, at, "documents").select("doc_id", F.md5("text").alias("k"))
    return ordered.keep_first(rows, ["k"], ["doc_id"])


@query("SELECT event_id, event_type = 'error' AS is_last, event_type = 'click' AS side, CAST(row_number() OVER (PARTITION BY event_type = 'error', event_type = 'click' ORDER BY event_id) AS INTEGER) AS turn FROM events")
def interleave_rr(spark, at):
    rows = t(spark, at, "events").select("event_id", "event_type")
    return ordered.interleave(rows, F.col("event_type") == "click", F.col("event_type") == "error", ["event_id"]).select("event_id", "is_last", "side", "turn")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 500) AS BIGINT) AS chunk FROM documents")
def chunk_ids(spark, at):
    return ordered.chunked(t(spark, at, "documents").select("doc_id"), ["doc_id"], 500).select("doc_id", "chunk")


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING), 'none') AS carried FROM conversations")
def carry_forward(spark, at):
    rows = t(spark, at, "conversations")
    return ordered.carry_forward(rows, F.when(F.col("role") == "user", F.col("text")), ["conv_id"], ["turn", "text"], "none", "carried").select("conv_id", "turn", "carried")


@query("""
WITH w AS (SELECT conv_id, turn, list({'v': CASE WHEN length(text) % 2 = 0 THEN length(text) END, 's': role = 'system'}) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS a FROM conversations),
u AS (SELECT conv_id, turn, coalesce(list_position(list_transform(a, lambda x: x.s), true) - 1, len(a)) AS stop, a FROM w)
SELECT conv_id, turn, coalesce(list_aggregate(list_transform(list_filter(a[1:stop], lambda x: x.v IS NOT NULL)[1:2], lambda x: x.v), 'string_agg', ';'), '') AS ahead FROM u
""")
def lookahead(spark, at):
    rows = t(spark, at, "conversations")
    out = ordered.look_ahead(rows, F.when(F.length("text") % 2 == 0, F.length("text")), F.col("role") == "system", ["conv_id"], ["turn", "text"], 6, 2, "ahead")
    return out.select("conv_id", "turn", F.array_join(F.col("ahead").cast("array<string>"), ";").alias("ahead"))


@query("""
WITH l AS (SELECT user_id, event_id AS left_id, value AS a FROM events WHERE event_type = 'click'), r AS (SELECT user_id, event_id AS right_id, value AS b FROM events WHERE event_type = 'purchase')
SELECT left_id, right_id, abs(a - b) AS gap FROM l JOIN r USING (user_id) WHERE abs(a - b) <= 12 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY abs(a - b), b, right_id) = 1
""")
def nearest_within_tol(spark, at):
    e = t(spark, at, "events").select("user_id", F.col("event_id").alias("id"), "value", "event_type")
    return ordered.nearest_within(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "value", 12)


DECISIONS = "SELECT doc_id AS id, concat(substr(text, 1, 10), CASE WHEN quality = 0 THEN 'x' ELSE '' END) AS title, concat('ko', doc_id) AS ko, CASE WHEN toxic = 1 THEN 'low' ELSE 'high' END AS conf FROM documents JOIN labels USING (doc_id)"
TITLES = "SELECT doc_id AS id, substr(text, 1, 10) AS title, CAST(NULL AS VARCHAR(10)) AS ko, CASE WHEN doc_id % 5 = 0 THEN 'manual' END AS src, CAST(NULL AS VARCHAR(10)) AS conf FROM documents"


def _sql(spark, at, sql, *tables):
    for n in tables:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql.replace("VARCHAR(10)", "STRING"), **{n: t(spark, at, n) for n in tables})


@query(f"WITH d AS ({DECISIONS}), r AS ({TITLES}) SELECT r.id, r.title, CASE WHEN ok THEN d.ko ELSE r.ko END AS ko, CASE WHEN ok THEN 'llm-translated' ELSE r.src END AS src, CASE WHEN ok THEN d.conf ELSE r.conf END AS conf, ok AS applied FROM (SELECT r.*, coalesce(d.id IS NOT NULL AND d.title = r.title AND r.src IS DISTINCT FROM 'manual', false) AS ok FROM r LEFT JOIN d USING (id)) r LEFT JOIN d USING (id)")
def decision_apply(spark, at):
    return changes.apply_decisions(_sql(spark, at, TITLES, "documents"), _sql(spark, at, DECISIONS, "documents", "labels").withColumnsRenamed({}), "id", "title", "ko", "src", "conf")


@query(f"WITH f AS ({DECISIONS}) SELECT f.id, CASE WHEN r.id IS NULL THEN 'not_found' WHEN r.title = f.title THEN 'applied' ELSE 'mismatch' END AS outcome FROM (SELECT CASE WHEN id % 9 = 0 THEN -id - 1 ELSE id END AS id, title FROM f) f LEFT JOIN ({TITLES}) r USING (id)")
def manual_fix(spark, at):
    fixes = _sql(spark, at, DECISIONS, "documents", "labels").select(F.expr("CASE WHEN id % 9 = 0 THEN -id - 1 ELSE id END").alias("id"), "title")
    return changes.manual_fixes(_sql(spark, at, TITLES, "documents"), fixes, "id", "title", "ko")


@query("SELECT event_id, props->>'$.k' AS k, json_valid(props) AS valid FROM events")
def json_extract(spark, at):
    v = F.try_parse_json("props")
    return t(spark, at, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), v.isNotNull().alias("valid"))


BAD = "CASE WHEN n_chars > 2000 THEN 'text must be short' END, CASE WHEN lang <> 'en' THEN 'lang must be en' END, CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'source must be known' END"


@query(f"SELECT left(e, 80) AS error, count(*) AS n FROM (SELECT unnest([{BAD}]) AS e FROM documents) WHERE e IS NOT NULL GROUP BY 1")
def validate_report(spark, at):
    errors = validate.check(("text must be short", F.col("n_chars") <= 2000), ("lang must be en", F.col("lang") == "en"), ("source must be known", F.col("source").isin("src0", "src1", "src2")))
    return validate.report(t(spark, at, "documents"), errors)


@query("SELECT count(*) AS n FROM documents")
def record_count(spark, at):
    return t(spark, at, "documents").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS rows, count(*) FILTER (WHERE contains(text, '    ')) AS spills, count(*) FILTER (WHERE split_part(text, chr(10), 1) = split_part(text, chr(10), -1)) AS same, count(*) FILTER (WHERE contains(text, '    ')) = 0 AND 20 * count(*) FILTER (WHERE split_part(text, chr(10), 1) = split_part(text, chr(10), -1)) < count(*) AS passes FROM documents")
def quality_gate(spark, at):
    first, last = F.split_part("text", F.lit("\n"), F.lit(1)), F.split_part("text", F.lit("\n"), F.lit(-1))
    return changes.quality_gate(t(spark, at, "documents"), F.contains("text", F.lit("    ")), first == last)


@query("SELECT b AS before, a AS after, b - a AS delta, CASE WHEN b < a THEN 'fatal' WHEN b - a > 1000 THEN 'abort' WHEN b = a THEN 'no-op' ELSE 'ok' END AS verdict FROM (SELECT (SELECT count(*) FROM documents) AS b, (SELECT count(DISTINCT text) FROM documents) AS a)")
def replay_gate(spark, at):
    docs = t(spark, at, "documents").select("text")
    return changes.replay_gate(docs, docs.distinct())


@query("SELECT count(*) AS attempted, count(*) FILTER (WHERE o_orderstatus <> 'P') AS succeeded, count(*) FILTER (WHERE o_orderstatus <> 'P') >= 0.9 * count(*) AS passes FROM orders")
def success_ratio(spark, at):
    return changes.success_ratio(t(spark, at, "orders"), F.col("o_orderstatus") != "P")


@query(f"WITH r AS ({RECS}) SELECT seq, CASE WHEN category = 'vocaloid' AND regexp_extract(id || '-0', '^blog-([0-9]+)-', 1) IN ('100', '104', '108', '112') THEN 'jpop' ELSE category END AS category FROM r")
def retag_posts(spark, at):
    posts = {k: "jpop" for k in ("100", "104", "108", "112")}
    return recs(spark, at).select("seq", changes.retag(F.concat("id", F.lit("-0")), F.col("categories"), posts)[0].alias("category"))
