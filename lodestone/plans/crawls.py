"""The two crawl jobs over landed pages and responses (S22, S23). Fetching is not an engine's work: what a crawler lands
is a table, and a source (X1) is a function that returns the records of one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import lead, split_collab
from lodestone.operators import changes, classify, enrich, rows
from lodestone.operators.ordered import interleave
from lodestone.operators.staging import stage
from lodestone.sources import html_sources

#: A source by its name; the pipeline pulls the records of each as one table.
Source = Callable[[SparkSession], DataFrame]
SOURCES: dict[str, Source] = {}


def source(name: str) -> Callable[[Source], Source]:
    def put(f: Source) -> Source:
        SOURCES[name] = f
        return f

    return put


def chosen(names: Sequence[str] = ()) -> list[Source]:
    """The named sources, or all, in the order in which they were given; an unknown name is an error."""
    if missing := [n for n in names if n not in SOURCES]:
        raise ValueError(f"unknown source {missing[0]!r}")
    return [SOURCES[n] for n in names] if names else list(SOURCES.values())


def ordered_posts(posts: DataFrame) -> DataFrame:
    """Posts (path, first, listed, ..) with their place: those of one index take turns, jpop first, those of
    several come last."""
    mixed = (F.size("listed") != 1) | ~F.coalesce(F.col("listed")[0].isin("jpop", "vocaloid"), F.lit(False))
    flat = posts.withColumns({"_index": F.col("first.index"), "_pos": F.col("first.pos")})
    return interleave(flat, F.when(~mixed, F.col("listed")[0]).otherwise("mixed"), mixed, ["_index", "_pos", "path"]).drop("_index", "_pos")


def blog_crawl(indexes: DataFrame, pages: DataFrame, crawled_at: str, limit: int | None = None, body_class: str | None = None, floor: float = 0.9) -> DataFrame:
    """Records of a blog's artist posts, from landed responses.

    indexes: (index, path, category, status, html), pages: (path, status, html). An index that failed stops the job. The
    posts of all indexes are joined into one list (A17), limited before they are read (O3), and read; a post that
    failed, is missing or gives no row is one that didn't succeed, and a job with fewer than floor of them stops before
    it returns anything (A21).
    """
    bad = indexes.where("status < 200 OR status >= 300 OR status IS NULL").select("path", "status").limit(1).collect()
    if bad:
        raise ValueError(f"index {bad[0].path}: status {bad[0].status}")
    own = [r.path for r in indexes.select("path").collect()]
    links = html_sources.index_paths(html_sources.links(indexes, "index", "html")).join(F.broadcast(indexes.select(F.col("index").alias("id"), "category")), "id")
    posts = ordered_posts(enrich.path_categories(links.withColumnRenamed("id", "index"), own))
    if limit:
        posts = posts.orderBy("is_last", "turn", "side").limit(limit)
    posts = stage(posts.withColumn("post", F.substring("path", 2, 18).cast("long")), "crawl-posts")
    got = pages.where("status >= 200 AND status < 300").withColumn("post", F.substring("path", 2, 18).cast("long")).join(posts.select("post"), "post", "left_semi")
    songs = stage(html_sources.artist_pages(got, "post", "html", body_class), "crawl-songs")
    read = posts.join(songs.select(F.col("id").alias("post"), F.lit(True).alias("_read")).distinct(), "post", "left")
    ratio = changes.success_ratio(read, F.col("_read")).first()
    if ratio.attempted and not (ratio.succeeded >= floor * ratio.attempted):
        raise ValueError(f"{ratio.succeeded} of {ratio.attempted} posts could be read, {floor} of them are needed")
    raw = songs.join(posts.select(F.col("post").alias("id"), "path", "categories"), "id")
    raw = raw.select("path", "row", F.col("path").alias("source_url"), F.col("title").alias("title_primary"), "title_ko", "artist_primary", "artist_ko", "tj", "ky", "joysound", "categories")
    return rows.blog_records(raw, crawled_at)


@dataclass
class State:
    """What the catalogue's crawl keeps between runs, as tables: entries by number and by artist, and one header row."""

    numbers: DataFrame  # pro, nationalcode, sort_title_ko, sort_song_ko, last_seen
    artists: DataFrame  # key, code, jpn, kor, eng, last_seen
    header: DataFrame  # bootstrapped_at, generated_at


def catalogue_crawl(items: DataFrame, state: State, charts: DataFrame, scans: DataFrame, searches: DataFrame, previous: DataFrame, now: str, limit: int | None = None) -> tuple[DataFrame, State, DataFrame]:
    """(records, state after it, counts by admit path), from landed responses.

    items: (source_url, pro, title, artist) of the catalogue; charts: (artist, genre, pro, ok); scans: (key, ok, jpn, kor,
    eng); searches: (search, pos, pro, nationalcode, sort_title_ko, sort_song_ko, ok); previous: the records that vouch
    for numbers. The charts count if the bootstrap is due (T2); then stale artists take their scans, the chain admits or
    drops (F1), what was admitted takes its transliterations (J9), and only what comes out is limited (O3). The state is
    written before anything is returned, so a failure later loses no fetched answer.
    """
    at = F.lit(now).cast("timestamp")
    artists = state.artists
    header = state.header
    if header.where(enrich.bootstrap_due(header, at)).limit(1).count():
        from lodestone.functions.text import match_key

        votes = stage(classify.chart_votes(charts.where("ok").withColumn("key", match_key(F.col("artist"))).where("key <> ''"), ["key", "genre"], "pro"), "crawl-votes")
        known = artists.select("key", "jpn", "kor", "eng")
        for genre in ("jpn", "kor"):
            known = classify.merge_votes(known, votes.where(F.col("genre") == genre).select("key", "votes"), genre)
        told = votes.select("key").distinct().withColumn("_told", F.lit(True))
        codes = known.join(told, "key", "left").join(artists.select("key", F.col("code").alias("_code"), "last_seen"), "key", "left")
        fresh = classify.verdict(F.col("jpn"), F.col("kor"), F.col("eng"))
        artists = codes.select("key", F.when(F.col("_told"), fresh).otherwise(F.col("_code")).alias("code"), "jpn", "kor", "eng", F.when(F.col("_told"), at).otherwise(F.col("last_seen")).alias("last_seen"))
        header = enrich.stamped(header, F.lit(charts.where("ok").limit(1).count()), at)
    artists = stage(enrich.scan_artists(artists, scans, at), "crawl-artists")
    numbers = state.numbers
    parts = split_collab(items, "artist", "_parts").withColumn("lead", lead(F.col("_parts")))
    parts = enrich.component_keys(parts.drop("_parts"), "artist")
    coded = enrich.with_codes(parts, artists, numbers.select("pro", F.col("nationalcode").alias("code")), enrich.whitelist(previous), "lead", "pro", ["pro", "title"])
    verdict, step = classify.chain(classify.admit_steps(F.col("keys"), F.col("pro_code"), F.col("lead_code"), F.col("whitelisted")))
    judged = stage(coded.withColumns({"verdict": verdict, "step": step}).select("source_url", "pro", "title", "artist", "verdict", "step"), "crawl-judged")
    kept = judged.where("verdict = 'admit'")
    told, after = enrich.fill_transliterations(kept.select("pro", "title"), numbers, searches, at)
    numbers = stage(after, "crawl-numbers")
    ko = told.where("outcome IN ('hit', 'fetched')").select("pro", "sort_title_ko", "sort_song_ko")
    out = rows.vendor_records(kept.select("source_url", "title", "artist", "pro"), ko, now)
    if limit:
        out = out.orderBy("id").limit(limit)
    return out, State(numbers, artists, stage(header, "crawl-header")), classify.keep_stats(judged)


def songbook_ingest(lines: DataFrame, by: Sequence[str], previous: DataFrame, drop_keys: DataFrame, source_url: str, crawled_at: str) -> DataFrame:
    """S11 to records: the songbook's records (id, tj, title_primary, .., categories) of numbers that are new or the book's
    own, without dropped artists, with what earlier rows of the book said of time and aliases (J20), and with the
    section's category where the lists leave it (F7)."""
    from lodestone.sources import songbook

    found = songbook.parse(lines, by)
    found = found.join(enrich.listed(found.select("tj", "artist"), "tj", "artist", drop_keys), "tj", "left_anti")
    keyed = enrich.component_keys(found, "artist")
    bare = enrich.component_keys(keyed.withColumn("_bare", F.regexp_replace("artist", songbook.CO_VOCALIST, "")), "_bare", "bare_keys")
    category = songbook.section_category(F.col("section"), F.col("keys"), F.col("bare_keys"))
    taken = previous.where(~F.col("id").startswith("tjpdf-")).select("tj")
    new = bare.join(taken, "tj", "left_anti").select(
        F.concat(F.lit("tjpdf-"), "tj").alias("id"), F.lit(source_url).alias("source_url"), F.coalesce(F.nullif("title", F.lit("")), "artist").alias("title_primary"), F.col("artist").alias("artist_primary"),
        "title_ko", "artist_ko", "tj", F.coalesce(F.when(category.isNotNull(), F.array(category)), F.array(F.lit("jpop"))).alias("categories"), F.lit(crawled_at).alias("crawled_at"), F.expr("cast(null AS array<string>)").alias("artist_aliases"),
    )
    return enrich.carried(new, previous)
