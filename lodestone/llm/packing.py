"""Best-fit packing of tokenised documents by the linear grouping scheme."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import freed, stage, table
from lodestone.llm.encoder import default_path, encoder, pieces

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The scheme's accuracies to choose from: lengths above capacity / LARGE are packed by configurations, the others by
#: best fit; the large ones are rounded up within so many groups of equal cardinality.
LARGE = (2, 3, 4, 6, 8, 16)
GROUPS = (64, 256, 1024)
#: Rows of one length that one task numbers.
SHARD_ROWS = 50_000
#: A plan of at most so many rows (a few MB) is broadcast.
PLAN_ROWS = 200_000


@dataclass(frozen=True)
class Run:
    """Items number lo .. lo + n - 1 of one length go per at a time into sequences seq, seq + 1, ..., from offset on."""

    length: int
    lo: int
    n: int
    seq: int
    per: int
    offset: int


def _groups(counts: dict[int, int], floor: int, k: int) -> list[list[list[int]]]:
    """Lengths above floor, longest first, in k groups of equal cardinality: each a list of [length, first number, n]."""
    total = sum(n for length, n in counts.items() if length > floor)
    size = -(-total // k) if total else 0
    out: list[list[list[int]]] = []
    room = 0
    for length in sorted((x for x in counts if x > floor), reverse=True):
        lo, n = 0, counts[length]
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append([length, lo, take])
            lo, n, room = lo + take, n - take, room - take
    return out


def _fill(sizes: list[int], have: list[int], room: int) -> list[int]:
    """Indices (repeats allowed, at most have[i] of i) of sizes with the largest sum within room; subset sums as bits."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i, s in enumerate(sizes):
        if s > room:
            continue
        for _ in range(min(have[i], room // s)):
            more = reach | (reach << s) & mask
            if more == reach:
                break
            steps.append((i, s, reach))
            reach = more
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, []
    for i, s, before in reversed(steps):
        if not before >> at & 1:
            out.append(i)
            at -= s
    return out


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """The grouping scheme's plan with the fewest sequences, over LARGE and GROUPS."""
    tries = (grouped(counts, capacity, capacity // large, groups) for large in LARGE for groups in GROUPS)
    return min(tries, key=lambda t: (t[1], len(t[0])))


def grouped(counts: dict[int, int], capacity: int, floor: int, groups: int) -> tuple[list[Run], int]:
    """Where each item of each length goes, and the number of sequences; counts has the items of each length.

    Linear grouping (de la Vega and Lueker, 1981): the large lengths fall into groups of equal cardinality and count
    as the longest of their group. Of these few sizes, configurations are made that hold the largest size left and
    fill the rest as full as can be, each used as often as the counts allow. The actual items then take the places of
    their group, which leaves some more room; the small lengths are put best-fit, longest first, into all the room
    that is left, and into new sequences after that. Work and result depend on the lengths' number, not the items'.
    """
    members = _groups(counts, floor, groups)
    sizes = [g[0][0] for g in members]
    have = [sum(n for _, _, n in g) for g in members]
    out: list[Run] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, number of sequences)
    seq = 0
    for top in range(len(sizes)):
        while have[top]:
            have[top] -= 1
            rest = _fill(sizes[top:], have[top:], capacity - sizes[top])
            have[top] += 1
            config = [top, *(top + i for i in rest)]
            uses = {i: config.count(i) for i in config}
            times = min(have[i] // m for i, m in uses.items())
            for i, m in uses.items():
                have[i] -= m * times
            # one run of equal actual lengths in every place at a time
            done = 0
            while done < times:
                n = times - done
                heads, taken = [], defaultdict(int)
                for i in config:
                    n = min(n, members[i][0][2] // uses[i] or 1)
                for i in config:
                    run = members[i][0]
                    if run[2] < n:  # places of one group met a run's end: one sequence by itself
                        n = 1
                offset = 0
                for i in config:
                    length, lo, left = run = members[i][0]
                    heads.append((length, lo, offset))
                    out.append(Run(length, lo, n, seq, 1, offset))
                    offset += length
                    run[1], run[2] = lo + n, left - n
                    taken[i] += n
                    if not run[2]:
                        members[i].pop(0)
                rooms[capacity - offset].append((seq, n))
                seq += n
                done += n
    free = sorted(r for r in rooms if r)
    for length in sorted((x for x in counts if x <= floor), reverse=True):
        lo, left = 0, counts[length]
        while left:
            at = bisect_left(free, length)
            if at == len(free):
                per = capacity // length
                n = max(1, left // per)
                where, room = (seq, n), capacity
                seq += n
            else:
                room = free[at]
                where = rooms[room].pop()
                if not rooms[room]:
                    free.pop(at)
            first, n = where
            per = room // length
            if left >= per:
                full = min(n, left // per)
                each = per
            else:
                full, each = 1, left
            if full < n:
                if room not in rooms or not rooms[room]:
                    insort(free, room)
                rooms[room].append((first + full, n - full))
            out.append(Run(length, lo, full * each, first, each, capacity - room))
            lo, left = lo + full * each, left - full * each
            rest_room = room - each * length
            if rest_room:
                if not rooms.get(rest_room):
                    insort(free, rest_room)
                rooms[rest_room].append((first, full))
    return out, seq


def _cut(path: str, capacity: int, separator: int):
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            encoded = (x for part in pieces(b) for x in enc.ids(part.column(1).to_pylist()))
            for doc, ids in zip(b.column(0).to_pylist(), encoded, strict=True):
                ids += end
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity if not piece else capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for col, x in zip(cols, (doc, piece, start, length, crc), strict=True):
                        col.append(x)
                    start, piece = start + length, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return freed(run)


def pack(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs.

    A row's ids are the library's, then the separator. Only rows longer than capacity are cut, the first piece taking
    what the others of full capacity leave. The driver gets the number of pieces of each length (capacity numbers at
    most) and plans with these; every piece then finds its place by its number among the pieces of its length.

    Null and empty texts are one separator. Repeated rows and rows with a null id are packed like any other. An empty
    table gives no row. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(_cut(path, capacity, separator), PIECES)
    # numbers by which a crowded length is dealt to several tasks; stored, so that they stay the same
    pieces = stage(pieces.withColumn("deal", F.monotonically_increasing_id() % (1 << 30)), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    shards = max(1, -(-max(counts.values(), default=0) // SHARD_ROWS))
    pieces = pieces.withColumn("shard", F.col("deal") % shards)
    own = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "deal")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    sizes = sizes.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.withColumn("number", F.row_number().over(own) - 1).join(sizes, ["length", "shard"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("base"))
    steps = spark.createDataFrame([(r.length, r.lo, r.lo + r.n, r.seq, r.per, r.offset) for r in runs], "l long, lo long, hi long, seq long, per long, at long")
    if len(runs) <= PLAN_ROWS:
        steps = F.broadcast(steps)
    placed = numbered.join(steps, (F.col("length") == F.col("l")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    nth = F.col("number") - F.col("lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("seq") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())
