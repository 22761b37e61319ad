"""Operators that depend on row order; every one takes the ordering columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.staging import stage


def carry_forward(rows: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], default: str, out: str) -> DataFrame:
    """The last non-null value up to the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def look_ahead(rows: DataFrame, value: Column, stop: Column, by: Sequence[str], order: Sequence[str], reach: int, most: int, out: str) -> DataFrame:
    """Up to most non-null values of the next reach rows, before the first row at which stop is true."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, reach)
    ahead = F.collect_list(F.struct(value.alias("v"), F.coalesce(stop, F.lit(False)).alias("s"))).over(w)
    until = F.expr("CASE WHEN exists(_ahead, x -> x.s) THEN slice(_ahead, 1, cast(array_position(transform(_ahead, x -> x.s), true) - 1 AS INT)) ELSE _ahead END")
    taken = F.expr(f"slice(transform(filter(_until, x -> x.v IS NOT NULL), x -> x.v), 1, {most})")
    return rows.withColumn("_ahead", ahead).withColumn("_until", until).withColumn(out, taken).drop("_ahead", "_until")


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with one key the first; a map-side combined aggregate, so a frequent key costs nothing extra."""
    best = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*[F.col(c) for c in order]))
    return rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).agg(best.alias("_row")).select("_row.*")


def interleave(rows: DataFrame, bucket: Column, last: Column, order: Sequence[str]) -> DataFrame:
    """Rows with (turn, side): buckets take turns, rows for which last holds come after all others. Sorting by
    (is_last, turn, side) gives the order."""
    sides = rows.withColumns({"is_last": last, "side": bucket})
    out = numbered(sides, order, "turn", ["is_last", "side"])
    return out.select(*sides.columns, (F.col("turn") + 1).cast("int").alias("turn"))


def numbered(rows: DataFrame, order: Sequence[str], out: str = "number", by: Sequence[str] = ()) -> DataFrame:
    """A number from 0 in the order of the columns, for each value of by anew, without one task for all rows: rows are
    dealt by range, numbered within each range, and shifted by the ranges' sizes."""
    ranged = rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged, "numbered")
    sizes = ranged.groupBy("_part", *by).agg(F.count("*").alias("n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    earlier = F.col("b._part") < F.col("a._part")
    for s in same:
        earlier &= s
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), earlier, "left")
    before = before.groupBy("a._part", *[f"a.{c}" for c in by]).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_part", *by).orderBy(*order)
    here = F.col("a._part") == F.col("b._part")
    for s in same:
        here &= s
    out_rows = ranged.alias("a").join(F.broadcast(before).alias("b"), here).select("a.*", "b._base").withColumn(out, F.row_number().over(w) - 1 + F.col("_base"))
    return out_rows.drop("_part", "_base")


def chunked(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Rows with chunk, the number of their run of size rows."""
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("number") / size).cast("long"))


def nearest_within(left: DataFrame, right: DataFrame, by: Sequence[str], position: str, tolerance: int) -> DataFrame:
    """For each left row (by.., id, position) the right row (by.., id, position) nearest in position within
    tolerance; of equally near ones the leftmost. (left_id, right_id, gap).

    Positions are cut into cells as wide as the tolerance, so the join has equal keys: a row meets its own and the
    neighbouring cells only.
    """
    cell = F.floor(F.col(position) / tolerance).cast("long")
    l_ = left.select(*by, F.col("id").alias("left_id"), F.col(position).alias("_l"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    r = right.select(*by, F.col("id").alias("right_id"), F.col(position).alias("_r"), cell.alias("_cell"))
    gap = F.abs(F.col("_l") - F.col("_r"))
    near = l_.join(r, [*by, "_cell"]).where(gap <= tolerance).withColumn("gap", gap)
    return near.groupBy("left_id").agg(F.min(F.struct("gap", F.col("_r").alias("at"), "right_id")).alias("m")).select("left_id", "m.right_id", "m.gap")
