"""Exact top-k search in Hamming space by incremental multi-index hashing."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import log2
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stage, table

#: Segments have about log2 of the number of codes bits, less SPARE, within these bounds: a value then holds a few codes,
#: which costs less to look through than the probes of wider segments' larger balls.
SPARE, NARROW, WIDE = 2, 8, 20


def binary_codes(rows: DataFrame, bits: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, c0, c1, ..): the sign bits of vectors of bits numbers (set where positive; NaN and null numbers are not),
    64 to a column. Rows with a null id, a null vector or one of another length have no code."""
    n = -(-bits // 64)

    def run(batches):
        for b in batches:
            v = b.column(1)
            flat = v.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, bits)
            ones = np.zeros((len(flat), n * 64), bool)
            ones[:, :bits] = flat > 0
            words = np.packbits(ones, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(n))], names=["id", *(f"c{k}" for k in range(n))])

    good = rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) == bits)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return good.mapInArrow(run, "id long, " + ", ".join(f"c{k} long" for k in range(n)))


def segments(bits: int, codes: int) -> list[tuple[int, int, int]]:
    """(code column, shift, width) of each segment; none crosses a column."""
    width = min(WIDE, max(NARROW, round(log2(max(codes, 2))) - SPARE))
    out = []
    for k in range(-(-bits // 64)):
        here = min(64, bits - 64 * k)
        parts = max(1, round(here / width))
        at = 0
        for i in range(parts):
            w = here // parts + (i < here % parts)
            out.append((k, at, w))
            at += w
    return out


def _value(seg: tuple[int, int, int], prefix: str) -> Column:
    k, shift, width = seg
    return F.shiftrightunsigned(f"{prefix}{k}", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


#: Probes that a worker makes at once.
PROBES = 1 << 17


def _probes(segs: list[tuple[int, int, int]], r: int, words: int):
    """For rows (code words, bound): the values at exactly r bits from the code's in each segment that the bound still
    needs at radius r, as rows (code words, bound, seg, val)."""
    m = len(segs)
    masks = {w: np.array([sum(1 << b for b in c) for c in combinations(range(w), r)], np.int64) for w in {s[2] for s in segs}}
    names = [*(f"q{i}" for i in range(words)), "bound", "seg", "val"]

    def run(batches):
        for b in batches:
            code = [np.asarray(b.column(i)).astype(np.int64) for i in range(words)]
            bound = np.asarray(b.column(words))
            for i, (k, shift, width) in enumerate(segs):
                ball = masks[width]
                asks = np.flatnonzero(bound - m * r + 1 > i) if len(ball) else np.zeros(0, np.int64)
                step = max(1, PROBES // max(1, len(ball)))
                for a in range(0, len(asks), step):
                    part = asks[a : a + step]
                    own = ((code[k][part].view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                    val = (own[:, None] ^ ball[None, :]).reshape(-1)
                    each = np.repeat(part, len(ball))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[each]) for c in code), pa.array(bound[each]), pa.array(np.full(len(each), i, np.int32)), pa.array(val)], names=names)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, bits: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(query_id, neighbor_id, distance, rank): for each row of queries the k rows nearest to it in Hamming distance of
    sign bits, other than itself; ties go to the smaller id. queries has the columns of rows.

    Equal codes are looked at once, with the k + 1 smallest of their ids, which is all that can be among the nearest.
    In wave r every open query probes values at exactly r bits from its own in each segment, as many segments as its
    k-th distance found so far still needs; a probe returns verified distances within that k-th one only. A query
    closes when no code that it hasn't met could be as near as its k-th: with radius r in the first j of m segments
    and r - 1 in the others, all codes within m * r + j - 1 bits have been met.

    Rows without a code (see binary_codes) are neither found nor ask. Repeated ids count once. With k or fewer other
    codes around, a query gets them all. Empty tables give no row. Other columns aren't read.
    """
    spark = rows.sparkSession
    n = -(-bits // 64)
    cols = [f"c{i}" for i in range(n)]
    by_code = Window.partitionBy(*cols).orderBy("id")
    first = binary_codes(rows, bits, id_col, vec_col).distinct().withColumn("nth", F.row_number().over(by_code)).where(F.col("nth") <= k + 1)
    codes = stage(first.groupBy(*cols).agg(F.array_sort(F.collect_list("id")).alias("ids")), "hamming-codes")
    asked = stage(binary_codes(queries, bits, id_col, vec_col).distinct(), "hamming-queries")
    own = [F.col(c).alias(f"q{i}") for i, c in enumerate(cols)]
    q = [f"q{i}" for i in range(n)]
    total = codes.count()
    segs = segments(bits, total)
    m = len(segs)
    places = F.array(*[F.struct(F.lit(i).alias("seg"), _value(s, "c").alias("val")) for i, s in enumerate(segs)])
    index = stage(codes.select(*cols, F.element_at("ids", 1).alias("least"), F.size("ids").alias("size"), F.explode(places).alias("e")).select(*cols, "least", "size", "e.seg", "e.val"), "hamming-index")
    distance = reduce(add, [F.bit_count(F.col(f"q{i}").bitwiseXOR(F.col(f"c{i}"))) for i in range(n)])
    # found: the best codes of each query so far; open_: queries with the k-th distance known (else bits)
    found = spark.createDataFrame([], "".join(f"{x} long, " for x in [*q, *cols]) + "least long, size int, distance int")
    open_ = asked.select(*own).distinct().withColumn("bound", F.lit(bits))
    done_ = None
    for r in range(max(w for _, _, w in segs) + 1):
        need = F.col("bound") - m * r + 1  # segments that a query must probe at radius r
        wave = open_.select(*q, "bound").mapInArrow(_probes(segs, r, n), "".join(f"{x} long, " for x in q) + "bound int, seg int, val long")
        # the planner takes the probes for as few as the queries; the hint keeps it from sending them to every worker
        met = wave.join(index.hint("shuffle_hash"), ["seg", "val"]).where(distance <= F.col("bound")).select(*q, *cols, "least", "size", distance.cast("int").alias("distance"))
        both = found.join(open_.select(*q), q, "left_semi").union(met).distinct()
        order = Window.partitionBy(*q).orderBy("distance", "least")
        best = both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
        best = best.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        best = stage(best.drop("nth"), "hamming-found")
        kth = best.where(F.col("sum") >= k + 1).groupBy(*q).agg(F.min("distance").alias("kth"))
        now = open_.select(*q).join(kth, q, "left").withColumn("bound", F.coalesce("kth", F.lit(bits))).drop("kth")
        # after this wave a query has met all within m * r + j - 1, j being the segments it probed
        covered = stage(open_.select(*q, F.least(F.lit(m), F.greatest(need, F.lit(0))).alias("j")).join(now, q), "hamming-open")
        closed = F.col("bound") <= m * r + F.col("j") - 1
        ready = best.drop("sum").join(covered.where(closed).select(*q), q, "left_semi")
        done_ = ready if done_ is None else done_.union(ready)
        found = best.drop("sum")
        open_ = covered.where(~closed).select(*q, "bound")
        if open_.limit(1).count() == 0:
            break
    near = done_.join(codes, cols).select(*q, "distance", F.explode("ids").alias("neighbor_id"))
    pairs = asked.select(F.col("id").alias("query_id"), *own).join(near, q).where("query_id != neighbor_id")
    rank = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    out = pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_id", "neighbor_id", "distance", "rank")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of each vector whose id is divisible by 50, by the signs of its 64 numbers."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 10, 64, "vec_id", "embedding")


ORACLE = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS b FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.b, n.b), lambda x: CAST(x[1] <> x[2] AS INTEGER))) AS INTEGER) AS distance
  FROM c q JOIN c n ON q.vec_id % 50 = 0 AND n.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM p)
SELECT query_id, neighbor_id, distance, rank FROM r WHERE rank <= 10
"""
