"""Enrichment of catalogue rows: nationality joins, transliterations, drop lists by component, state that ages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import exclusive, match_key, match_keys, source_slug, split_collab, trim
from lodestone.operators.classify import admits_to_whitelist, is_fresh, verdict
from lodestone.operators.joins import left_spread


def search_text(c: Column) -> Column:
    """What is searched for: without apostrophes; null if nothing is left, so that nothing is looked up."""
    return F.nullif(trim(F.translate(c, "'", "")), F.lit(""))


# ---- components of a credit


def component_keys(rows: DataFrame, artist: str, out: str = "keys") -> DataFrame:
    """Rows with the match keys of all components of the artist, whole first; none for an empty artist.

    The parts are split_collab's; a drop check only asks whether one is there, so their order doesn't matter.
    """
    keys = F.filter(match_keys(F.col("_c")), lambda k: k != "")
    return split_collab(rows, artist, "_c").withColumn(out, keys).drop("_c")


def distinct_components(rows: DataFrame, artist: str, order: str) -> DataFrame:
    """(key, surface): every component's match key with the form it first has, by order and place."""
    parts = split_collab(rows, artist, "_c").withColumn("_k", match_keys(F.col("_c")))
    each = parts.select(F.col(order).alias("_o"), F.posexplode(F.arrays_zip(F.col("_c").alias("c"), F.col("_k").alias("k"))).alias("_i", "x"))
    return each.where("x.k <> ''").groupBy(F.col("x.k").alias("key")).agg(F.min_by("x.c", F.struct("_o", "_i")).alias("surface"))


def listed(rows: DataFrame, id_col: str, artist: str, keys: DataFrame) -> DataFrame:
    """(id): rows any component of whose artist is among keys (key). An empty list lets everything through."""
    each = component_keys(rows, artist).select(id_col, F.explode("keys").alias("key")).distinct()
    return each.join(keys.select("key").distinct(), "key", "left_semi").select(id_col).distinct()


def drop_listed(rows: DataFrame, id_col: str, artist: str, keys: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """rows without those whose artist has a listed component, whatever their source, and without the ids in also."""
    kept = rows.join(listed(rows, id_col, artist, keys), id_col, "left_anti").select(*rows.columns)
    return kept.where(~F.col(id_col).isin(*also)) if also else kept


# ---- the admit chain's dimensions


def with_codes(rows: DataFrame, by_artist: DataFrame, by_number: DataFrame, rescued: DataFrame, lead: str, pro: str, by: Sequence[str]) -> DataFrame:
    """Rows with lead_code, the nationality of their lead artist's match key (key, code), pro_code, that of their
    number (pro, code), and whitelisted, whether rescued (pro) has the number. Rows without a number stay."""
    out = left_spread(rows, by_artist.select(F.col("key").alias(lead), F.col("code").alias("lead_code")), lead, by)
    out = left_spread(out, by_number.select(F.col("pro").alias(pro), F.col("code").alias("pro_code")), pro, by)
    out = left_spread(out, rescued.select(F.col("pro").alias(pro)).distinct().withColumn("whitelisted", F.lit(True)), pro, by)
    return out.withColumn("whitelisted", F.coalesce("whitelisted", F.lit(False)))


def whitelist(records: DataFrame) -> DataFrame:
    """(pro): the distinct TJ numbers of records whose artist may vouch for them."""
    return records.where((F.col("tj") != "") & admits_to_whitelist(F.col("artist_primary"))).select(F.col("tj").alias("pro")).distinct()


def whitelist_counts(records: DataFrame) -> DataFrame:
    """(kept, skipped) records with a number."""
    admitted = F.coalesce(admits_to_whitelist(F.col("artist_primary")), F.lit(False))
    return records.where("tj <> ''").agg(F.count_if(admitted).alias("kept"), F.count_if(~admitted).alias("skipped"))


def translatable(records: DataFrame) -> DataFrame:
    """records without a Korean title or a note where it is from, whose title has kana or kanji."""
    return records.where(F.col("title_ko").isNull() & F.col("title_ko_source").isNull() & F.col("title_primary").rlike("[\\u3040-\\u30FF\\u4E00-\\u9FFF]"))


# ---- state that ages


def fill_transliterations(rows: DataFrame, state: DataFrame, found: DataFrame, now: Column, days: int = rules.ENTRY_DAYS) -> tuple[DataFrame, DataFrame]:
    """(outcomes, state after it).

    rows (pro, title), state (pro, values.., last_seen), found (search, pos, pro, values.., ok): what a search of a title
    gave; ok false for a search that failed. A fresh number keeps its entry (hit); a stale one takes the first item of
    its title's search that has its number (fetched); a search without it is a miss, a failed or an unasked one an
    error, and both leave the state as it was. outcomes: (pro, outcome, values..).
    """
    values = [c for c in state.columns if c not in ("pro", "last_seen")]
    fresh = state.where(is_fresh(F.col("last_seen"), now, days))
    asked = rows.where("pro IS NOT NULL").select("pro", search_text(F.col("title")).alias("search")).distinct()
    hit = asked.select("pro").distinct().join(fresh, "pro")
    stale = asked.join(fresh.select("pro"), "pro", "left_anti")
    answer = F.struct(*values)
    first = found.where("ok AND pro IS NOT NULL").groupBy("search", "pro").agg(F.min_by(answer, "pos").alias("_new"))
    said = found.groupBy("search").agg(F.bool_or("ok").alias("_ok"))
    j = left_spread(stale, said, "search", ["pro"]).join(first, ["search", "pro"], "left")
    # an empty search gives no items without a call, which is a miss
    one = j.groupBy("pro").agg(F.min_by("_new", "search").alias("_new"), F.bool_or(F.coalesce("_ok", F.col("search").isNull())).alias("_ok"))
    outcome = F.when(F.col("_new").isNotNull(), "fetched").when(F.col("_ok"), "miss").otherwise("error")
    out = hit.select("pro", F.lit("hit").alias("outcome"), *values).union(one.select("pro", outcome.alias("outcome"), *[F.col(f"_new.{v}").alias(v) for v in values]))
    new = one.where(F.col("_new").isNotNull()).select("pro", *[F.col(f"_new.{v}").alias(v) for v in values], now.alias("last_seen"))
    after = state.join(new.select("pro"), "pro", "left_anti").unionByName(new.select(*state.columns))
    return out, after


def scan_artists(state: DataFrame, scans: DataFrame, now: Column, days: int = rules.ENTRY_DAYS) -> DataFrame:
    """The artists' state (key, code, jpn, kor, eng, last_seen) after scans (key, ok, jpn, kor, eng) of the stale ones.

    A scan that answered sets the entry, with the verdict of its votes: no item at all makes UNKNOWN, so it isn't asked
    again soon. A failed scan leaves the entry alone, to be tried again.
    """
    fresh = state.where(is_fresh(F.col("last_seen"), now, days))
    votes = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("jpn", "kor", "eng")]
    new = scans.where("ok").join(fresh.select("key"), "key", "left_anti").select("key", *votes)
    new = new.select("key", verdict(F.col("jpn"), F.col("kor"), F.col("eng")).alias("code"), "jpn", "kor", "eng", now.alias("last_seen"))
    return state.join(new.select("key"), "key", "left_anti").unionByName(new)


def bootstrap_due(header: DataFrame, now: Column, days: int = rules.BOOTSTRAP_DAYS) -> Column:
    """Whether the charts are to be swept: never done, unreadable, or days ago."""
    return ~is_fresh(F.col("bootstrapped_at"), now, days)


def stamped(header: DataFrame, calls_ok: Column, now: Column) -> DataFrame:
    """The header after a sweep; only a sweep with a call that worked counts as one."""
    return header.withColumns({"bootstrapped_at": F.when(calls_ok > 0, now).otherwise(F.col("bootstrapped_at")), "generated_at": now})


def korean_fallback(items: DataFrame, tagged: int, seen: int, least: int = rules.LEAST_VOTES, cap: int = 5) -> DataFrame:
    """(key, votes) of the fallback search, capped: items (name, artist, code, pro) of the searches by the dropped
    names; only an item of exactly the searched artist with the code KOR counts, and a number once. Empty unless the
    sweep neither tagged nor saw a sure Korean artist."""
    key = match_key(F.col("name"))
    good = items.where((F.col("code") == "KOR") & (key != "") & (match_key(F.col("artist")) == key))
    out = good.groupBy(key.alias("key")).agg(F.count_distinct("pro").alias("n")).where(F.col("n") >= least)
    out = out.select("key", F.least("n", F.lit(cap)).alias("votes"))
    return out if not tagged and not seen else out.limit(0)


def carried(new: DataFrame, previous: DataFrame) -> DataFrame:
    """New songbook rows (tj, artist_primary, crawled_at, artist_aliases, ..) with the time at which their number
    was first taken in, and with the earlier row's aliases while the artist's match key is the same.

    previous: records (seq, id, tj, artist_primary, crawled_at, artist_aliases); only the songbook's count, the last one
    of a number.
    """
    old = previous.where((source_slug(F.col("id")) == "tjpdf") & (F.col("tj") != ""))
    last = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col("seq")))
    kept = old.groupBy("tj").agg(
        last("crawled_at", F.col("crawled_at") != "").alias("_at"), last("artist_primary", F.col("artist_primary") != "").alias("_artist"), last("artist_aliases", F.size("artist_aliases") > 0).alias("_aliases")
    )
    j = left_spread(new, kept, "tj", [c for c in new.columns if c != "artist_aliases"])
    same = match_key(F.coalesce("_artist", F.lit(""))) == match_key(F.col("artist_primary"))
    own = {"crawled_at": F.coalesce("_at", "crawled_at"), "artist_aliases": F.when(same, F.col("_aliases")).otherwise(F.lit(None))}
    return j.select(*[own.get(c, F.col(c)).alias(c) for c in new.columns])


# ---- index pages


def path_categories(paths: DataFrame, index_paths: Sequence[str], posts: dict[str, str] = rules.POST_CATEGORY) -> DataFrame:
    """(path, first, listed, categories): every post that an index page links, where it comes first (index, pos),
    the categories of the indexes that list it, and its own: the post's override, or those after exclusivity. paths:
    (index, pos, path, category); links from one index to another don't count."""
    out = paths.where(~F.col("path").isin(*index_paths)).groupBy("path").agg(F.min(F.struct("index", "pos")).alias("first"), F.array_sort(F.collect_set("category")).alias("listed"))
    override = F.lit(None).cast("string")
    for k, v in posts.items():
        override = F.when(F.col("path") == f"/{k}", v).otherwise(override)
    return out.withColumn("categories", F.when(override.isNotNull(), F.array(override)).otherwise(exclusive(F.col("listed"))))


def counters(rows: DataFrame, /, **conditions: Column) -> DataFrame:
    """(name, n): how many rows each condition holds for, in one pass."""
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return one.unpivot([], list(conditions), "name", "n")
