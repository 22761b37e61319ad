import hashlib
import random
import re

import pytest

from lodestone.llm.substring import levels, substring_dedup, substring_dedup_text


def brute(rows, w):
    top = 2**63 - 1
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    for (d, _), x in zip(rows, split, strict=True):
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, 2**80), top if d is None else d)
    out = []
    for (d, _), x in zip(rows, split, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if first[tuple(x[i : i + w])] < (top if d is None else d):
                gone[i : i + w] = [True] * w
        kept = b" ".join(y for y, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def texts(rng):
    shared = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(rng.choice([12, 13, 14, 40, 120]))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))))
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    return [*rows, (61, None), (62, ""), (63, "a " * 500), (64, "a " * 20), (3, "é ß " * 300), (65, "é ß " * 14), rows[5], rows[5]]


@pytest.mark.parametrize("window", [13, 5, 50])
def test_against_brute_force(spark, window):
    rows = texts(random.Random(window))
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, th int, found string").repartition(3)
    got = substring_dedup(docs, window=window).collect()
    assert order([(r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got]) == order(brute(rows, window))
    texts_ = substring_dedup_text(docs, window=window).collect()
    assert texts_[0].row.asDict().keys() == {"doc_id", "th", "found"}
    digest = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    assert order([(r.row.doc_id, r.n_words, r.n_removed, digest(r.kept_text)) for r in texts_]) == order(brute(rows, window))
    assert substring_dedup(docs.limit(0)).count() == 0


def test_levels_at_most_double():
    for w in (13, 50, 100):
        ladder = levels(w)
        assert ladder[-1] == w and all(b <= 2 * a for a, b in zip(ladder, ladder[1:], strict=False))


def test_null_ids_and_colliding_hashes(spark):
    """1,000 rows with a null id, and pairs of different texts with one 32-bit hash under a null and under one id."""
    import xxhash

    seen, pairs, i = {}, [], 0
    while len(pairs) < 2:
        t = " ".join(f"w{i}x{k}" for k in range(1 + i % 20))
        h = xxhash.xxh64_intdigest(t.encode()) & 0xFFFFFFFF
        if h in seen and len(seen[h]) != len(t):
            pairs.append((seen[h], t))
        seen[h], i = t, i + 1
    rng = random.Random(8)
    base = " ".join(f"b{k}" for k in range(60))
    rows = [(None, f"n{i} {' '.join(base.split()[i % 40 : i % 40 + 20])} {rng.random()}" if i % 3 else f"only {i}") for i in range(1000)]
    rows += [(None, t) for p in pairs for t in p] + [(9, t) for p in pairs for t in p] + [(2**63 - 1, base), (5, base), (2**63 - 1, base[3:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup(docs).collect()
    assert order([(r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got]) == order(brute_nulls(rows, 13))


def brute_nulls(rows, w):
    """As brute, but a null id comes after the largest id too."""
    return [(None if d == 2**70 else d, *x) for d, *x in brute([(2**70 if d is None else d, t) for d, t in rows], w)]


def test_oracle_meets_the_operator(spark):
    import duckdb

    from lodestone.llm.substring import ORACLE, op4_substring_dedup

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    want = con.execute(f"select doc_id, n_words, n_removed, kept_sha256 from ({ORACLE})").fetchall()
    assert order([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op4_substring_dedup(spark, at).collect()]) == order(want)


def test_second_hash_tells_words_apart():
    import numpy as np

    from lodestone.llm.common import Words

    rng = random.Random(12)
    words = [bytes(rng.choices(b"ab", k=rng.randrange(1, 12))) for _ in range(3000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    h = Words(data, np.array([0, len(data)])).second()
    assert len(h) == len(words) and len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))


def test_buckets_are_dealt_evenly(spark):
    from collections import Counter

    from lodestone.llm.substring import numbers

    for least, parts in ((1, 4), (9, 4), (500, 51), (3, 211)):
        got = numbers(least, parts)
        df = spark.createDataFrame([(int(x),) for x in got], "n int").selectExpr(f"pmod(hash(n), {parts}) AS p")
        assert len(got) >= least and len(set(got.tolist())) == len(got) and set(Counter(r.p for r in df.collect()).values()) == {-(-least // parts)}
