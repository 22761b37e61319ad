"""Alias resolution: names given as 'canonical｜alias' re-key the records that use the alias alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import identity_key, pipe_segments
from lodestone.operators.staging import stage


def piped(rows: DataFrame, name: str = "artist_primary") -> DataFrame:
    """(seq, canonical, canonical_key, pos, alias, alias_key): each alias of each row whose name has two segments."""
    parts = rows.select("seq", pipe_segments(F.col(name)).alias("s")).where("size(s) >= 2")
    each = parts.select("seq", F.col("s")[0].alias("canonical"), F.posexplode(F.array_distinct(F.expr("slice(s, 2, size(s) - 1)"))).alias("pos", "alias"))
    return each.withColumns({"canonical_key": identity_key(F.col("canonical")), "alias_key": identity_key(F.col("alias"))})


def alias_map(pairs: DataFrame) -> DataFrame:
    """(alias_key, alias, canonical_key, canonicals, n): for each alias key its first surface form, the one
    canonical key it stands for (null if there are several), the canonicals' first surface forms, sorted, and how many
    there are. Aliases with an empty key or their canonical's own key make no row."""
    useful = pairs.where("alias_key <> '' AND alias_key <> canonical_key")
    surface = pairs.groupBy("canonical_key").agg(F.min_by("canonical", F.struct("seq", "pos")).alias("surface"))
    links = useful.groupBy("alias_key", "canonical_key").agg(F.min(F.struct("seq", "pos", "alias")).alias("first")).join(surface, "canonical_key")
    out = links.groupBy("alias_key").agg(F.min("first")["alias"].alias("alias"), F.count("*").alias("n"), F.array_sort(F.collect_set("surface")).alias("canonicals"), F.min("canonical_key").alias("canonical_key"))
    return out.withColumn("canonical_key", F.when(F.col("n") == 1, F.col("canonical_key")))


def canonical_aliases(pairs: DataFrame) -> DataFrame:
    """(canonical_key, canonical, known): each canonical's first surface form and its aliases in order."""
    first = pairs.groupBy("canonical_key", "alias").agg(F.min(F.struct("seq", "pos")).alias("at"))
    known = first.groupBy("canonical_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("known"))
    surface = pairs.groupBy("canonical_key").agg(F.min_by("canonical", F.struct("seq", "pos")).alias("canonical"))
    return surface.join(known, "canonical_key")


def resolve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with artist_primary and artist_aliases resolved, conflicts (alias, canonicals, affected)).

    A piped name becomes its first segment, with the others as aliases. A bare name that is an alias of exactly one
    canonical becomes that; one that is a canonical gets its known aliases; one that is an alias of several stays, and
    is counted. Then the fixed spellings apply. A name with the pipe but one segment stays and is a conflict of its own.
    The alias tables are as small as the piped names; they join on the name's key.
    """
    pairs = stage(piped(rows), "alias-pairs")
    mapped = alias_map(pairs)
    known = canonical_aliases(pairs)
    seg = pipe_segments(F.col("artist_primary"))
    split = rows.withColumn("_seg", seg)
    none = F.array().cast("array<string>")
    split = split.withColumns({
        "_piped": F.size("_seg") >= 2,
        "_odd": F.col("artist_primary").contains(rules.PIPE) & (F.size("_seg") < 2),
        "artist_aliases": F.when(F.size("_seg") >= 2, F.array_distinct(F.expr("slice(_seg, 2, size(_seg) - 1)"))).otherwise(F.col("artist_aliases")),
        "artist_primary": F.when(F.size("_seg") >= 2, F.col("_seg")[0]).otherwise(F.col("artist_primary")),
    }).withColumn("_key", identity_key(F.col("artist_primary")))
    one = mapped.where("n = 1").select(F.col("alias_key").alias("_key"), F.col("canonical_key").alias("_to"))
    several = mapped.where("n > 1").select(F.col("alias_key").alias("_key"), F.lit(True).alias("_collides"))
    own = known.select(F.col("canonical_key").alias("_key"), F.col("known").alias("_own"))
    target = known.select(F.col("canonical_key").alias("_to"), F.col("canonical").alias("_canonical"), F.col("known").alias("_known"))
    # what is known of a name is put together first: all by the name's key, so the rows join once
    told = one.join(target, "_to", "left").drop("_to").join(several, "_key", "full_outer").join(own, "_key", "full_outer")
    j = stage(split.join(told, "_key", "left"), "alias-joined")
    free = ~F.col("_odd") & (F.col("_key") != "") & F.col("_collides").isNull()
    is_own = free & F.col("_own").isNotNull()
    rewrites = free & F.col("_own").isNull() & F.col("_canonical").isNotNull()
    has = F.coalesce("artist_aliases", none)
    merged_own = F.array_remove(F.array_distinct(F.concat(has, F.col("_own"))), F.col("artist_primary"))
    merged_to = F.array_remove(F.array_distinct(F.concat(has, F.array("artist_primary"), F.coalesce("_known", none))), F.col("_canonical"))
    j = j.withColumns({
        "artist_aliases": F.when(is_own, merged_own).when(rewrites, F.when(F.size(merged_to) > 0, merged_to).otherwise(F.col("artist_aliases"))).otherwise(F.col("artist_aliases")),
        "artist_primary": F.when(rewrites, F.col("_canonical")).otherwise(F.col("artist_primary")),
    })
    hit = j.where(F.col("_collides") & ~F.col("_odd")).groupBy("_key").agg(F.count("*").alias("affected"))
    clash = mapped.where("n > 1").join(hit, F.col("alias_key") == F.col("_key"), "left").select("alias", "canonicals", F.coalesce("affected", F.lit(0)).alias("affected"))
    odd = j.where("_odd").select(F.col("artist_primary").alias("alias"), none.alias("canonicals"), F.lit(1).cast("long").alias("affected"))
    return canonicalise(j).select(*rows.columns), clash.union(odd)


def canonicalise(rows: DataFrame, names: dict[str, str] = rules.CANONICAL_NAMES) -> DataFrame:
    """Exact spellings become the one that stands for them, and stay as aliases; piped names stay."""
    pairs = rows.sparkSession.createDataFrame(list(names.items()), "_from string, _into string")
    j = rows.join(F.broadcast(pairs), F.col("artist_primary") == F.col("_from"), "left")
    merged = F.array_remove(F.array_distinct(F.concat(F.coalesce("artist_aliases", F.array().cast("array<string>")), F.array("artist_primary"))), F.col("_into"))
    return j.withColumns({
        "artist_aliases": F.when(F.col("_into").isNotNull(), merged).otherwise(F.col("artist_aliases")),
        "artist_primary": F.coalesce("_into", "artist_primary"),
    }).drop("_from", "_into")
