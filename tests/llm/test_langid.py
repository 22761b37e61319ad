import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid
from lodestone.llm.langid import Model, fold, identify, remainder, train


def brute(samples, text, order=3):
    counts = defaultdict(Counter)
    for s in samples:
        f = b"   " + bytes(fold(np.frombuffer(s, np.uint8)))
        for i in range(3, len(f)):
            for k in range(order + 1):
                counts[f[i - k : i]][f[i]] += 1
    f, bits = b"   " + bytes(fold(np.frombuffer(text, np.uint8))), 0.0
    for i in range(3, len(f)):
        for k in range(order, -1, -1):
            c = counts.get(f[i - k : i])
            if not c:
                continue
            total, distinct = sum(c.values()), len(c)
            if c[f[i]]:
                bits += math.log2((total + distinct) / c[f[i]])
                break
            bits += math.log2((total + distinct) / distinct)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    samples = {"a": [b"hello world this is", "Éclair été".encode(), b""], "b": [b"the thing", b"x"]}
    texts = [b"", b"h", "Hello the ÉTé zq!\xff".encode(), b"thing world" * 50, b"\x00\x01"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = Model(samples, least=1).lengths(data, np.cumsum([0, *map(len, texts)]))
    for row, t in zip(got, texts, strict=True):
        for value, lang in zip(row, "ab", strict=True):
            assert abs(value - brute(samples[lang], t)) < 0.01 * (len(t) + 1)


def test_pruned_contexts_fall_back():
    m = Model({"a": [b"abcabcabd"], "b": [b"xyz"]}, least=2)
    assert [len(c) for c in m.contexts] == [1, 3, 3, 3]  # a, b, c; ab, bc, ca; abc, bca, cab
    whole = Model({"a": [b"abcabcabd"]}, least=2)
    assert whole.contexts[3].tolist() == m.contexts[3].tolist()  # another language takes no context away
    assert np.isfinite(m.lengths(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))).all()
    with pytest.raises(ValueError, match="bytes"):
        Model({"a": [b"abcabcabd"]}, table_bytes=10)


def test_identify(spark):
    rng = random.Random(6)
    words = {"xx": ["lorem", "ipsum", "dolor"], "yy": ["kata", "moku", "zune"]}
    rows = [(i, " ".join(rng.choices(words[w], k=30)), w, "s") for i in range(80) for w in [rng.choice("xy") * 2]]
    rows += [(100, None, "xx", "s"), (101, "", None, "s"), (102, "123 !!", "yy", "s"), (None, "moku zune", "yy", "s"), (3, rows[3][1], rows[3][2], "s"), (103, "kata " * 30000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, at string")
    model = train(docs, remainder("doc_id", 4) != 2)
    out = identify(docs, model).select("row.*", "lang_pred", "score").collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        assert r.lang_pred == ("und" if r.doc_id in (100, 101, 102) else "yy" if r.doc_id == 103 else r.lang)
    empty = train(docs.limit(0), remainder("doc_id", 4) != 2)
    assert [r.lang_pred for r in identify(docs.limit(2), empty).collect()] == ["und", "und"]
    assert Model({}).predict(pa.array(["a", None]))[0] == ["und", "und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = remainder("doc_id", 4) == 2
    out = identify(docs.where(held), train(docs, ~held)).selectExpr("row.lang", "lang_pred").where("lang is not null")
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()


def test_every_text_is_counted(spark, monkeypatch):
    """The model is that of all texts together, however many there are and however they are dealt out."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.choice('bdfgklmnprstvz')}{rng.choice('aeioué')}{rng.choice('lnrst')}" for _ in range(rng.randrange(4))), "xx" if i % 5 else "yy") for i in range(3000)]
    rows += [rows[0], rows[7], (9000, None, "xx"), (9001, "kein Wort", None), (None, "nobody", "yy"), (9002, "", "zz"), (9003, "ÉÀ" * 40000, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    texts = {w: [t.encode() for i, t, lang in rows if lang == w and i is not None and t is not None] for w in ("xx", "yy")}
    assert len(texts["xx"]) > 2000
    got, want = train(docs, F.lit(True)), Model(texts)
    assert got.langs == ["xx", "yy"] and got.order == want.order
    assert all(np.array_equal(a, b) for a, b in zip(got.contexts, want.contexts, strict=True))
    assert np.array_equal(got.bits, want.bits) and np.array_equal(got.next_, want.next_) and np.array_equal(got.symbol, want.symbol)
    # of more bytes a context needs more: so many in each PER of them
    monkeypatch.setattr(langid, "PER", 2000)
    least = {w: max(3, math.ceil(sum(map(len, t)) / (2000 / 3))) for w, t in texts.items()}
    alone = [Model({w: texts[w]}, least=n).contexts for w, n in least.items()]
    fewer = train(docs, F.lit(True)).contexts
    assert all(np.array_equal(c, np.union1d(a, b)) for c, a, b in zip(fewer, *alone, strict=True)) and len(fewer[3]) < len(got.contexts[3])
    with pytest.raises(ValueError, match="bytes"):
        train(docs, F.lit(True), table_bytes=1000)


def test_counts_are_passed_on_in_parts(monkeypatch):
    monkeypatch.setattr(langid, "AT_ONCE", 10)
    texts = [f"word{i} {i * 7919}" for i in range(50)]
    parts = list(langid._count([pa.record_batch([pa.array(["a", "b"] * 25), pa.array(texts)], names=["lang", "text"])] * 3))
    assert len(parts) > 2
    got, want = Counter(), Counter()
    for p in parts:
        for lang, gram, n in zip(*(c.to_pylist() for c in p.columns), strict=True):
            got[lang, gram] += n
    for i, t in enumerate(texts):
        f = b"   " + t.encode()
        for at in range(3, len(f)):
            want["ab"[i % 2], int.from_bytes(f[at - 3 : at + 1], "big")] += 3
    assert got == want
