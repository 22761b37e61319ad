import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.llm.simhash import choose_segments, fingerprint, keep_one, links, near_duplicates, radii


def brute(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(n, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(fps):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_fingerprint_matches_definition():
    for t in [None, "", " \t\n", "One", "a B c", "a b c d", "A b c d e\x0bf\x0c g", "Éa É b c d e", "x " * 40000]:
        assert fingerprint(t, 4) == brute(t)


def test_radii_cover_the_distance():
    for d in range(2, 9):
        for m in range(2, d + 2):
            assert sum(r + 1 for r in radii(m, d)) == d + 1
    assert choose_segments(10, 4) >= choose_segments(10**9, 4)


def test_links_are_all_pairs(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps):
        for flips in range(1, 6):
            y = x
            for b in rng.sample(range(64), flips):
                y ^= 1 << b
            fps.add(y)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for n in (100, 10**6, 10**9):
        assert {tuple(r) for r in links(nodes, n).collect()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    loops = {x for x in label if all(a == b for a, b in edges if x in (a, b))}
    assert got == {k: v for k, v in label.items() if k not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_edges(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(5, base, "x"), (3, base + " tail", "y"), (9, None, None), (7, "", "z"), (None, base, "n"), (5, base, "x"), (8, "quite other words stand here", "q"), (None, None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.id is None, r.id or 0, r.component) for r in near_duplicates(docs).collect())
    fps = [brute(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    lab = reach(fps)
    want = sorted((ids[i] is None, ids[i] or 0, min([ids[j] for j in range(len(rows)) if lab[j] == lab[i] and ids[j] is not None], default=None)) for i in range(len(rows)))
    assert got == want
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert near_duplicates(docs.where(F.lit(False))).count() == 0


def test_probes_are_never_broadcast(spark, tmp_path):
    """A small file of codes makes many probes: they must not go to the driver, though the planner takes them for few."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/nodes")
    found = links(spark.read.parquet(f"{tmp_path}/nodes"), 1000)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_are_never_broadcast(spark):
    """Rows of copies make a small file: they must not go to the driver, though the planner takes them for few."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("one text in all of the rows").alias("text"))
    found = near_duplicates(docs)
    assert found.groupBy("component").count().collect() == [(0, 20000)]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
