"""Favourites: an ordered list of ids, newest first, kept as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import changes, search


def toggled(ids: Column, one: Column) -> Column:
    """The list without the id if it is there, else with it in front; null is the empty list."""
    own = F.coalesce(ids, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, one), F.array_remove(own, one)).otherwise(F.array_prepend(own, one))


def listed(ids: DataFrame, col: str) -> DataFrame:
    """(id, rank): the list's ids in their order, each once."""
    return ids.select(F.posexplode(F.col(col)).alias("rank", "id")).groupBy("id").agg(F.min("rank").alias("rank"))


def browse(records: DataFrame, favourites: DataFrame, hits: DataFrame | None, category: str = "all", vendors: tuple[str, ...] = (), cap: int = 50) -> DataFrame:
    """Q4: the favourite records, (records.., rank): without a query in the list's order, else the query's hits (id, score)
    that are favourites, best first. Ids without a record are stale and give nothing."""
    wanted = changes.has_category(F.col("categories"), category) & changes.any_vendor(vendors)
    if hits is None:
        return records.join(favourites, "id").where(wanted).orderBy("rank").limit(cap)
    found = records.join(favourites.select("id"), "id", "left_semi").join(hits, "id").where(wanted)
    return search.top(found, cap)
