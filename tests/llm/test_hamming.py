import random

import numpy as np
import pytest

from lodestone.llm.hamming import segments, top_k


def brute(rows, queries, k, bits):
    codes = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == bits:
            codes.setdefault(i, np.nan_to_num(np.array([x or 0.0 for x in v])) > 0)
    out = []
    for q in sorted({i for i, _ in queries if i in codes}):
        near = sorted((int((codes[q] != codes[i]).sum()), i) for i in codes if i != q)[:k]
        out += [(q, i, d, r) for r, (d, i) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize(("bits", "k"), [(64, 5), (100, 3)])
def test_against_brute_force(spark, bits, k):
    rng = random.Random(bits)
    base = [[rng.gauss(0, 1) for _ in range(bits)] for _ in range(40)]
    rows = []
    for i in range(300):
        v = list(rng.choice(base)) if i % 3 else [rng.gauss(0, 1) for _ in range(bits)]
        for b in rng.sample(range(bits), rng.randrange(8)):
            v[b] = -v[b]
        rows.append((i, v))
    rows += [(1000 + i, base[0]) for i in range(50)] + [(2000, None), (2001, [1.0]), (None, base[1]), (2002, [float("nan")] * bits), (2003, [None] * bits), rows[4]]
    schema = "id long, vec array<float>"
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), k, bits).collect())
    assert got == sorted(brute(rows, queries, k, bits))


def test_few_rows(spark):
    rows = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64)], "id long, vec array<float>")
    assert [tuple(r) for r in top_k(rows, rows, 5, 64).orderBy("query_id").collect()] == [(1, 2, 64, 1), (2, 1, 64, 1)]
    assert top_k(rows.limit(0), rows.limit(0), 5, 64).count() == 0
    for n in (2, 10**5, 10**9):
        assert sum(w for _, _, w in segments(100, n)) == 100
