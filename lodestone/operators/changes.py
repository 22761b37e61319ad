"""Upserts, corrections, removals and gates over record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import media_context, nfkc
from lodestone.operators.joins import left_spread


def upsert(rows: DataFrame, incoming: DataFrame, key: str, patched: Sequence[str], order: str) -> DataFrame:
    """Rows with the patched columns of the incoming row of their key, and incoming rows of new keys.

    Several rows of one key: the last one (by order) is the one patched; the others stay. Of several incoming rows the
    first (by order) counts. A null key matches nothing.
    """
    first = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c != key]), order).alias("_new"))
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_last"))
    # most rows may have no key: they are dealt by their place, not sent to one task
    j = left_spread(left_spread(rows, last, key, [order]), first, key, [order])
    hit = F.col("_new").isNotNull() & (F.col(order) == F.col("_last"))
    kept = j.select(*[F.when(hit & F.col(f"_new.{c}").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in patched else F.col(c) for c in rows.columns])
    new = first.join(last, key, "left_anti").select(key, "_new.*")
    return kept.unionByName(new, allowMissingColumns=True).select(*rows.columns)


def apply_decisions(rows: DataFrame, decisions: DataFrame, id_col: str, title: str, target: str, source: str, confidence: str) -> DataFrame:
    """Rows with target, source and confidence of the decision of their id, unless the row is manual or its title
    isn't the decision's (in compatibility form)."""
    d = decisions.select(F.col(id_col).alias("_id"), F.col(title).alias("_title"), F.col(target).alias("_target"), F.col(confidence).alias("_conf"))
    j = rows.join(d, F.col(id_col) == F.col("_id"), "left")
    same = nfkc(F.col(title)) == nfkc(F.col("_title"))
    j = j.withColumn("_ok", F.coalesce(F.col("_id").isNotNull() & same & ~F.col(source).eqNullSafe("manual"), F.lit(False)))
    new = {target: F.col("_target"), source: F.lit("llm-translated"), confidence: F.col("_conf")}
    return j.select(*[F.when(F.col("_ok"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns], F.col("_ok").alias("applied"))


def manual_fixes(rows: DataFrame, fixes: DataFrame, id_col: str, title: str, target: str) -> DataFrame:
    """(id, outcome) of each fix: applied, mismatch (the title is another) or not_found."""
    t = rows.select(F.col(id_col).alias("_id"), F.col(title).alias("_title"))
    j = fixes.join(t, F.col(id_col) == F.col("_id"), "left")
    same = nfkc(F.col(title)) == nfkc(F.col("_title"))
    return j.select(id_col, F.when(F.col("_id").isNull(), "not_found").when(same, "applied").otherwise("mismatch").alias("outcome"))


def apply_fixes(rows: DataFrame, fixes: DataFrame, id_col: str, title: str, target: str, source: str, confidence: str, order: str) -> DataFrame:
    """Rows with the fixes applied: target is the fix's, the source is manual, the confidence goes, all else stays.
    A fix whose title isn't the row's (in compatibility form) changes nothing; of several rows of an id the last one is
    fixed, of several fixes of an id the one whose target comes last by its text counts."""
    f = fixes.select(F.col(id_col).alias("_id"), F.col(title).alias("_title"), F.col(target).alias("_target")).groupBy("_id", "_title").agg(F.max("_target").alias("_target"))
    last = rows.groupBy(F.col(id_col).alias("_lid")).agg(F.max(order).alias("_last"))
    j = rows.join(last, F.col(id_col) == F.col("_lid"), "left").join(f, (F.col(id_col) == F.col("_id")) & (nfkc(F.col(title)) == nfkc(F.col("_title"))), "left")
    ok = F.col("_id").isNotNull() & (F.col(order) == F.col("_last"))
    new = {target: F.col("_target"), source: F.lit("manual"), confidence: F.lit(None)}
    return j.select(*[F.when(ok, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def fix_one(rows: DataFrame, id_col: str, one: str, target: str, value: str, source: str, confidence: str) -> DataFrame:
    """Rows with one record's target set by hand; a record that isn't there, or twice, is an error."""
    n = rows.where(F.col(id_col) == one).limit(2).count()
    if n != 1:
        raise ValueError(f"record not found: {one}" if not n else f"duplicate record_id: {one}")
    new = {target: F.lit(value), source: F.lit("manual"), confidence: F.lit(None)}
    return rows.select(*[F.when(F.col(id_col) == one, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def title_ko_rule(row_id: Column, title_ko: Column, source: Column, media: Column, confidence: Column) -> dict[str, Column]:
    """title_ko, source, media context and confidence after the first stage. Rows of tj and tjpdf keep a title_ko of a
    trusted source only; else its media context in parentheses is saved, and the title, source and confidence go. Rows
    of blog with a title_ko and no source get the source blog."""
    slug = F.substring_index(row_id, "-", 1)
    trusted = F.coalesce(source.isin("llm-translated", "manual", "blog"), F.lit(False))
    vendor = slug.isin("tj", "tjpdf") & ~trusted
    own = (slug == "blog") & (F.coalesce(title_ko, F.lit("")) != "") & (F.coalesce(source, F.lit("")) == "")
    gone = lambda c: F.when(vendor, F.lit(None)).otherwise(c)
    return {"title_ko": gone(title_ko), "source": F.when(own, "blog").otherwise(gone(source)), "media": F.when(vendor, F.coalesce(media_context(title_ko), media)).otherwise(media), "confidence": gone(confidence)}


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in dropped; a null key stays."""
    return rows.join(dropped.select(key).distinct(), key, "left_anti")


def within(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in kept."""
    return rows.join(kept.select(key), key, "left_semi")


def hydrate(hits: DataFrame, rows: DataFrame, key: str, rank: str) -> DataFrame:
    """The rows of the hits, in their order; stale hits go."""
    return hits.select(key, rank).join(rows, key).orderBy(rank)


def has_category(categories: Column, wanted: str) -> Column:
    """'all' lets everything through."""
    return F.lit(True) if wanted == "all" else F.array_contains(categories, wanted)


def any_vendor(vendors: Sequence[str]) -> Column:
    """a number of one of the vendors; no vendor lets everything through."""
    out = F.lit(not vendors)
    for v in vendors:
        out = out | F.col(v).isNotNull()
    return out


def retag(row_id: Column, categories: Column, posts: dict[str, str] = rules.POST_CATEGORY) -> Column:
    """blog posts with an override lose the category vocaloid for it; others keep theirs."""
    post = F.regexp_extract(row_id, "^blog-([0-9]+)-", 1)
    to = F.lit(None).cast("string")
    for k, v in posts.items():
        to = F.when(post == k, v).otherwise(to)
    return F.when(to.isNotNull() & F.array_contains(categories, "vocaloid"), F.array(to)).otherwise(categories)


def replay_gate(before: DataFrame, after: DataFrame, most: int = 1000, rewrites: int = 0) -> DataFrame:
    """(before, after, delta, verdict): more records than before are fatal, too many fewer stop the replay, and none
    fewer means that there is nothing to do, unless names were rewritten."""
    both = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select(F.lit(0), F.lit(1)))
    j = both.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("before"), F.coalesce(F.sum("a"), F.lit(0)).alias("after"))
    delta = F.col("before") - F.col("after")
    return j.withColumn("delta", delta).withColumn("verdict", F.when(delta < 0, "fatal").when(delta > most, "abort").when((delta == 0) & F.lit(not rewrites), "no-op").otherwise("ok"))


def quality_gate(rows: DataFrame, spill: Column, same: Column) -> DataFrame:
    """(rows, spills, same, passes): no spilled columns, and less than one in twenty rows with equal names."""
    out = rows.agg(F.count("*").alias("rows"), F.count_if(spill).alias("spills"), F.count_if(same).alias("same"))
    return out.withColumn("passes", (F.col("spills") == 0) & (20 * F.col("same") < F.col("rows")))


def success_ratio(rows: DataFrame, ok: Column, floor: float = 0.9) -> DataFrame:
    """A21."""
    out = rows.agg(F.count("*").alias("attempted"), F.count_if(ok).alias("succeeded"))
    return out.withColumn("passes", F.col("succeeded") >= floor * F.col("attempted"))
