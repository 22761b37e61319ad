"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.staging import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(sym: DataFrame, keep) -> DataFrame:
    """For pairs (u, v): links what keep admits of u's neighbours to the least of u and its neighbours."""
    least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.where(keep).join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (a long, b long), any order, repeats and loops allowed. Returns (node, root): root is the least node
    of the component. Nodes without an edge don't appear; no edge gives no row.

    Each round is two map-side combined aggregations and two joins that AQE can split at a hub; the edges are
    staged between rounds, so a lost executor repeats one round at most. Nothing but two numbers reaches the driver.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(pairs.distinct(), "cc")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        sym = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = _star(sym, F.col("v") > F.col("u")).where("x != b").distinct()
        down = large.select(F.col("x").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array("v", "u")).alias("x"), F.col("m").alias("b"))
        now = stage(small.where("x != b").select(F.col("x").alias("a"), "b").distinct(), "cc")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
