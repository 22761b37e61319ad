"""SimHash near-duplicates linked by multi-index hashing."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import as_row, freed, stage, table, text_key
from lodestone.operators.components import components

SEED = 42
BITS = 64
#: Shingles whose bits are spread out at once, so that a very long text needs bounded memory.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint of one text; 0 if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        part = h[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, th, fp): the fingerprint as a signed long, for every row of docs; th is the text's key."""

    def run(batches):
        for b in batches:
            texts = (t.as_py() for t in b.column(2))
            fp = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp)], names=["id", "th", "fp"])

    text = F.col(f"`{text_col}`").cast("string")
    cols = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text).alias("th"), text.alias("text"))
    return cols.mapInArrow(freed(run), "id long, th binary, fp long")


def radii(segments: int, distance: int) -> list[int]:
    """Search radii such that two codes within distance agree within the radius in one segment at least."""
    spare = distance - segments + 1
    return [max(-1, spare // segments + (i >= segments - spare % segments)) if spare >= 0 else (0 if i <= distance else -1) for i in range(segments)]


def widths(segments: int) -> list[int]:
    """Wider segments first: they have the smaller radii."""
    return [BITS // segments + (i < BITS % segments) for i in range(segments)]


def choose_segments(n: int, distance: int) -> int:
    """The number of segments with the least work for n codes: twice the probes and the expected matches."""

    def work(m: int) -> float:
        balls = [(w, sum(comb(w, k) for k in range(r + 1))) for w, r in zip(widths(m), radii(m, distance), strict=True)]
        return sum(2 * b + b * n / 2.0**w for w, b in balls)

    return min(range(2, min(distance, 8) + 1), key=work) if distance >= 2 else 2


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def _probes(ball: Column, seg: Column, value: Column) -> Column:
    return F.transform(ball, lambda x: F.struct(seg, value.bitwiseXOR(x).alias("key")))


def links(nodes: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """(a, b): pairs of different codes of nodes.fp with at most distance differing bits; n is about their number.

    Multi-index hashing. Every code enters a table once for each segment; probes enumerate the Hamming ball of the
    segment's radius around its value, and meet the table in one equi-join on (segment, value) whose condition
    verifies the whole distance, so the join returns true links only. AQE splits a value that many codes share.
    """
    m = choose_segments(n, distance)
    shift, rows, probes = 0, [], []
    for i, (w, r) in enumerate(zip(widths(m), radii(m, distance), strict=True)):
        if r < 0:
            break
        value: Column = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
        head = F.lit(i).cast("int").alias("seg")
        rows.append(F.struct(head, value.alias("key")))
        ball = F.array(*[F.lit(x).cast("long") for x in _ball(w, r)])
        probes.append(_probes(ball, head, value))
        shift += w
    left = nodes.select(F.col("fp").alias("b"), F.explode(F.array(*rows)).alias("e")).select("b", "e.seg", "e.key")
    right = nodes.select(F.col("fp").alias("a"), F.explode(F.flatten(F.array(*probes))).alias("e")).select("a", "e.seg", "e.key")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (F.col("a") < F.col("b"))
    at = (left.seg == right.seg) & (left.key == right.key)
    # the planner takes the exploded probes for as few as the codes; the hint keeps it from collecting them on the driver
    return left.join(right.hint("merge"), at & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """Groups of near-duplicates: (id, th, fp, root, component) for every row of docs.

    Rows link if their fingerprints differ in at most distance bits; root names the connected group (the least
    fingerprint in it), component is the smallest id in it. Equal fingerprints collapse before anything is
    compared, so copies cost nothing, however many.

    Null text counts as empty; a text without a word has fingerprint 0 and links like any other. A row with a null
    id belongs to its group but names it only if all its ids are null (then component is null). Repeated rows stay.
    An empty table gives no row. Other columns aren't read.
    """
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = components(links(nodes, nodes.count(), distance)).withColumnRenamed("node", "fp")
    # files of copies are small however many rows they hold, so their size must not send rows or codes to the driver
    named = nodes.join(roots.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "simhash-roots")
    groups = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(groups.hint("merge"), "root").select("fp", "root", "component")
    return rows.join(named.hint("merge"), "fp").select("id", "th", "fp", "root", "component")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group: the one with the smallest id (null last), then the smallest text key.

    Repeated rows are one group like all near-duplicates. All columns stay as they are, whatever their names; null and
    empty texts are a group of their own with all texts without a word. An empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col)
    first = F.struct(F.col("id").isNull().alias("null"), "id", "th")
    # one key column that is never null: the join's partitioning then does for the repeated rows too
    key = lambda th, id_: F.concat_ws(":", F.hex(th), id_)
    best = found.groupBy("root").agg(F.min(first).alias("best")).select(key(F.col("best.th"), F.col("best.id")).alias("key"))
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(key(text_key(text), F.col(f"`{id_col}`").cast("long")).alias("key"), as_row(docs.columns))
    return rows.join(best, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
