"""Left joins of rows whose key may be null for most of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_spread(rows: DataFrame, dim: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """rows left joined to dim on key. A row without a key can match nothing; it is dealt by the hash of its columns by,
    so that the rows without one don't meet in one task. Keys are compared as text."""
    free = F.concat(F.lit("\x00"), F.xxhash64(*by).cast("string"))
    keyed = rows.withColumn("_spread", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), free))
    own = dim.where(F.col(key).isNotNull()).withColumn("_spread", F.concat(F.lit("="), F.col(key).cast("string"))).drop(key)
    return keyed.join(own, "_spread", "left").drop("_spread")
