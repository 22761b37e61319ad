"""Three-tier de-duplication and the merge of each cluster by field ownership.

Records: seq (their order), id, source_url, title_primary, title_ko, artist_primary, artist_ko, artist_aliases,
tj, ky, joysound, categories, crawled_at, media_context_ko, title_ko_source, title_ko_confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import exclusive, has_guest, identity_key, lead, source_rank, source_slug, split_collab
from lodestone.operators.components import components
from lodestone.operators.joins import left_spread
from lodestone.operators.ordered import numbered as number_by_ranges
from lodestone.operators.staging import stage


def hard_key_components(rows: DataFrame, keys: tuple[str, ...] = rules.VENDORS) -> DataFrame:
    """Tier A (J1): (seq, comp) for every row; comp is the least seq that shared values of one key column lead to.

    A value that many rows share makes a star of links to its least row, not all pairs.
    """
    values = F.array(*[F.struct(F.lit(k).alias("vendor"), F.col(k).cast("string").alias("value")) for k in keys])
    held = rows.select("seq", F.explode(values).alias("e")).where("e.value IS NOT NULL").select("seq", "e.vendor", "e.value")
    least = held.groupBy("vendor", "value").agg(F.min("seq").alias("least"), F.count("*").alias("n")).where("n > 1")
    edges = held.join(least, ["vendor", "value"]).where("seq <> least").select(F.col("seq").alias("a"), F.col("least").alias("b"))
    found = components(edges).withColumnRenamed("node", "seq")
    return rows.select("seq").join(found, "seq", "left").select("seq", F.coalesce("root", "seq").alias("comp"))


def keyed(rows: DataFrame) -> DataFrame:
    """rows with slug, key_b (title and artist) and key_c (title and lead artist; null if either is empty)."""
    parts = split_collab(rows, "artist_primary", "_parts")
    out = parts.withColumns({"slug": source_slug(F.col("id")), "_t": identity_key(F.col("title_primary")), "_a": identity_key(F.col("artist_primary")), "_l": lead(F.col("_parts"))})
    key_c = F.when((F.col("_t") != "") & (F.col("_l") != ""), F.concat_ws("|", "_t", "_l"))
    return out.withColumns({"key_b": F.concat_ws("|", "_t", "_a"), "key_c": key_c}).drop("_parts", "_t", "_a", "_l")


def _grouped(single: DataFrame, key: str, gate: Column | None = None) -> DataFrame:
    """(key, least): groups of two rows or more of single that pass the gate."""
    groups = single.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("seq").alias("least"), F.count("*").alias("n"),
        F.count_distinct("slug").alias("slugs"),
        F.count_if(has_guest(F.col("artist_primary"))).alias("guests"),
        F.bool_and(F.array_contains("categories", "vocaloid")).alias("vocaloid"),
    )
    groups = groups.where("n > 1")
    return (groups if gate is None else groups.where(gate)).select(key, "least")


def gate() -> Column:
    """A2: different sources, or one source that credits a guest on exactly one of its (all vocaloid) rows."""
    return (F.col("slugs") >= 2) | ((F.col("guests") == 1) & F.col("vocaloid"))


def clusters(rows: DataFrame) -> DataFrame:
    """rows with slug, key_b, key_c, cluster (its least seq) and tier (A, B or C; null for a row by itself).

    Tier B joins rows alone after tier A by title and artist, tier C rows alone after that by title and lead artist
    where gate() holds.
    """
    base = stage(keyed(rows).join(hard_key_components(rows), "seq"), "merge-keys")
    sizes = base.groupBy("comp").agg(F.count("*").alias("size"))
    base = base.join(sizes, "comp")
    b = _grouped(base.where("size = 1"), "key_b").withColumnRenamed("least", "least_b")
    with_b = left_spread(base, b, "key_b", ["seq"]).withColumn("least_b", F.when(F.col("size") == 1, F.col("least_b")))
    with_b = stage(with_b, "merge-b")
    c = _grouped(with_b.where("size = 1 AND least_b IS NULL"), "key_c", gate()).withColumnRenamed("least", "least_c")
    # most rows have no key_c of use; those without one are dealt by seq
    out = left_spread(with_b, c, "key_c", ["seq"]).withColumn("least_c", F.when((F.col("size") == 1) & F.col("least_b").isNull(), F.col("least_c")))
    tier = F.when(F.col("size") > 1, "A").when(F.col("least_b").isNotNull(), "B").when(F.col("least_c").isNotNull(), "C")
    return out.withColumns({"cluster": F.coalesce("least_b", "least_c", "comp"), "tier": tier}).drop("comp", "size", "least_b", "least_c")


def _least(value: Column, order: Column, where: Column) -> Column:
    """The value of the first row by order among those that satisfy where."""
    return F.min_by(F.when(where, F.struct(value.alias("v"))), F.when(where, order))["v"]


def owned(col: str, owners: tuple[str, ...]) -> Column:
    """The first value by the owners' order, then by seq; sources that own nothing come last."""
    return _least(F.col(col), F.struct(source_rank(F.col("slug"), owners), F.col("seq")), F.col(col).isNotNull())


def vendor_number(col: str) -> Column:
    """A10: the value of the best-ranked source that has one."""
    return _least(F.col(col), F.struct(source_rank(F.col("slug")), F.col("seq")), F.col(col).isNotNull())


def korean_donor(field: str) -> Column:
    """The field of the one record that gives the Korean fields: the owner whose title_ko wins, else an owner
    with a media context, else any record with one. (A record of no owner with a title_ko alone gives nothing.)"""
    place = source_rank(F.col("slug"), rules.KOREAN_OWNERS)
    listed = place < len(rules.KOREAN_OWNERS)
    step = F.when(listed & F.col("title_ko").isNotNull(), 0).when(listed & F.col("media_context_ko").isNotNull(), 1).when(F.col("media_context_ko").isNotNull(), 2)
    within = F.when(step < 2, place).otherwise(0)
    return _least(F.col(field), F.struct(step, within, F.col("seq")), step.isNotNull())


def merge(clustered: DataFrame) -> DataFrame:
    """One record for each cluster (A8-A14): (cluster, tier, fields).

    Every field is a map-side combined aggregate over (rank, seq); only the categories and aliases of a cluster are
    collected, as distinct values.
    """
    by_rank = F.struct(source_rank(F.col("slug")), F.col("seq"))
    artist = owned("artist_primary", rules.NAME_OWNERS)
    scalar = {
        "tier": F.max("tier"),
        "id": F.min_by("id", by_rank),
        "source_url": F.min_by("source_url", by_rank),
        "title_primary": owned("title_primary", rules.NAME_OWNERS),
        "title_ko": owned("title_ko", rules.KOREAN_OWNERS),
        "artist_primary": artist,
        "artist_ko": owned("artist_ko", rules.KOREAN_OWNERS),
        **{v: vendor_number(v) for v in rules.VENDORS},
        "crawled_at": F.max("crawled_at"),
        **{f: korean_donor(f) for f in ("media_context_ko", "title_ko_source", "title_ko_confidence")},
    }
    out = clustered.groupBy("cluster").agg(*[c.alias(n) for n, c in scalar.items()])
    cats = clustered.select("cluster", F.explode("categories").alias("c")).groupBy("cluster").agg(exclusive(F.collect_set("c")).alias("categories"))
    each = clustered.select("cluster", "seq", F.posexplode("artist_aliases").alias("pos", "alias"))
    firsts = each.groupBy("cluster", "alias").agg(F.min(F.struct("seq", "pos")).alias("at"))
    aliases = firsts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("_aliases"))
    out = out.join(cats, "cluster", "left").join(aliases, "cluster", "left")
    kept = F.array_remove("_aliases", F.col("artist_primary"))
    return out.withColumns({"categories": F.coalesce("categories", F.array().cast("array<string>")), "artist_aliases": F.when(F.size(kept) > 0, kept)}).drop("_aliases")


def conflicts(clustered: DataFrame) -> DataFrame:
    """(cluster_key, field, values, winner): vendors on which the rows of a tier B or C cluster disagree, and a row for
    each tier C cluster; values in seq order."""
    soft = clustered.where("tier IN ('B', 'C')")
    first = F.min_by("key_b", "seq"), F.min_by("key_c", "seq")
    head = soft.groupBy("cluster").agg(first[0].alias("key_b"), first[1].alias("key_c"))
    rows = []
    for v in rules.VENDORS:
        of = soft.where(F.col(v).isNotNull()).groupBy("cluster").agg(
            F.count_distinct(v).alias("n"), vendor_number(v).alias("winner"),
            F.array_sort(F.collect_list(F.struct("seq", F.col("slug").alias("source"), F.col(v).cast("string").alias("value")))).alias("values"),
        )
        rows.append(of.where("n > 1").join(head, "cluster").select(F.col("key_b").alias("cluster_key"), F.lit(v).alias("field"), "values", F.col("winner").cast("string").alias("winner")))
    c = soft.where("tier = 'C'").groupBy("cluster").agg(
        F.min_by("id", F.struct(source_rank(F.col("slug")), F.col("seq"))).alias("winner"),
        F.array_sort(F.collect_list(F.struct("seq", F.col("slug").alias("source"), F.col("id").alias("value")))).alias("values"),
    )
    rows.append(c.join(head, "cluster").select(F.col("key_c").alias("cluster_key"), F.lit("tier_c_merge").alias("field"), "values", "winner"))
    return reduce(DataFrame.union, rows).withColumn("values", F.expr("transform(values, x -> struct(x.source AS source, x.value AS value))"))


def headline(found: DataFrame) -> DataFrame:
    """conflicts without the tier C merges."""
    return found.where("field <> 'tier_c_merge'")


def numbered(records: DataFrame, out: str = "place") -> DataFrame:
    """O1 as a column: each record's place in the final order, numbered by ranges."""
    keyed = records.withColumns({"_none": F.col("tj").isNull(), "_title": identity_key(F.col("title_primary"))})
    return number_by_ranges(keyed, ["_none", "tj", "_title", "id"], out).drop("_none", "_title")


def ordered(records: DataFrame) -> DataFrame:
    """O1: by TJ number (as text, missing last), then the title's key, then id."""
    return records.orderBy(F.col("tj").asc_nulls_last(), identity_key(F.col("title_primary")), "id")


def summary(found: DataFrame, clashes: DataFrame | None = None, sample: int = rules.CONFLICT_SAMPLE, alias_sample: int = rules.ALIAS_SAMPLE) -> DataFrame:
    """The headline total beside a bounded sample of all conflicts, and with the alias conflicts (alias,
    canonicals, affected) their total and a smaller sample."""
    top = found.orderBy("cluster_key", "field").limit(sample).select(F.lit(0).alias("n"), F.struct("cluster_key", "field", "winner").alias("s"))
    both = headline(found).groupBy().agg(F.count("*").alias("n")).select("n", F.lit(None).cast(top.schema["s"].dataType).alias("s")).union(top)
    out = both.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list("s")).alias("sample"))
    if clashes is None:
        return out
    first = clashes.orderBy("alias", "affected").limit(alias_sample).select(F.lit(0).alias("n"), "alias")
    total = clashes.groupBy().agg(F.count("*").alias("n")).select("n", F.lit(None).cast("string").alias("alias")).union(first)
    one = total.agg(F.sum("n").alias("alias_total"), F.array_sort(F.collect_list("alias")).alias("alias_sample"))
    return out.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")
