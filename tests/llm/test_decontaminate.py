import random
import re

import numpy as np

from lodestone.llm import decontaminate as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 90))])
        b = np.array([rng.randrange(6) for _ in range(rng.randrange(90))])
        assert D.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


def corpus():
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in", "a"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij", k=6))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, text(rng.randrange(15, 60))) for i in range(30)]
    docs, want = [], set()
    for d in range(150):
        body = text(rng.randrange(5, 300))
        if d % 3 == 0:
            i, words = rng.choice(items)
            words = list(words)
            if d % 2:  # a paraphrase: one word in ten is another
                for k in range(5, len(words), 10):
                    words[k] = "swapped"
            at = rng.randrange(len(body))
            body[at:at] = words
            want.add((d, i))
        docs.append((d, " ".join(body).replace(" the ", ", The "), "z"))
    return [(i, " ".join(w)) for i, w in items], docs, want


def test_finds_planted_items(spark, monkeypatch):
    items, docs, want = corpus()
    docs += [(900, None, "z"), (901, "", "z"), (None, items[3][1], "z"), (902, items[4][1] * 1 + " x" * 30000, "z"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (77, None), (78, " ... "), items[2]], "item_id long, text string")
    got = [(r.id, r.item_id) for r in D.contaminated(df, bench).collect()]
    assert set(got) == want | {(None, 3), (902, 4)} and len(got) == len(want) + 3
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    exact = {(d, i) for d, t, _ in docs for i, x in items if " ".join(words(x)) in " ".join(words(t))}
    assert exact <= set(got)
    kept = D.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _ in docs if d is not None and not any(d == x for x, _ in want | {(902, 4)}))
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    assert {(r.id, r.item_id) for r in D.contaminated(df, bench).collect()} == set(got)
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_finds_copies_of_more_items_than_the_rank(spark):
    rng = random.Random(10)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefghij", k=6))
    items = [(i, " ".join(word() for _ in range(rng.randrange(16, 60)))) for i in range(1200)]
    docs = [(i, " ".join([*(word() for _ in range(20)), x, *(word() for _ in range(20))])) for i, x in items]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.id, r.item_id) for r in D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in got for i, _ in items) == len(items)


def test_every_passage_of_every_document_is_in_the_matrix(spark):
    """The corpus's part of X'X against brute force over 700 documents; none may be left out."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices([*words, "other", "more"], k=rng.randrange(0, 120))) for _ in range(700)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(5)
    vocabulary = D.vocabulary_of(spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    place = {w: int(D.find(vocabulary, next(D.words_of(D.pa.array([w])))[1].h)[0]) for w in words}
    idf = np.linspace(1, 3, 50)
    want, rows = np.zeros((50, 50)), 0
    for t in texts:
        own = (t or "").split()
        for a in range(0, len(own), D.PASSAGE):
            x = np.zeros(50)
            for w in own[a : a + D.PASSAGE]:
                if w in place:
                    x[place[w]] += idf[place[w]]
            rows += x.any()
            x /= max(np.linalg.norm(x), 1e-12)
            want += np.outer(x, x)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((50, 50)))[0].astype(np.float32)
    factor, n = D.corpus_factor(df, spark.sparkContext.broadcast(D.Space(vocabulary, idf, 3.0)), q)
    assert n == rows > 1000 and np.allclose(factor @ factor.T, want, rtol=1e-3, atol=1e-2)


def test_recall_of_paraphrases_against_all_pairs(spark):
    """200 items, a basis of 64 dimensions, real documents: of the changed copies that all-pairs alignment accepts, with
    10, 20 and 30 % of the words changed, 0.9 at least are found; copies word by word all are, and nothing else is."""
    rng = random.Random(11)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("length(text) between 300 and 3000").limit(500).collect()]
    pool = sorted({w for t in texts for w in re.findall(r"[^\W_]+", t.lower())})
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    assert len(bench) == 200
    docs, planted = [(10_000 + i, t) for i, t in enumerate(texts)], {}
    for share in (0, 10, 20, 30):
        for i, x in bench:
            words = re.findall(r"[^\W_]+", x.lower())
            for k in rng.sample(range(len(words)), len(words) * share // 100):
                words[k] = rng.choice(pool)
            body = rng.choice(texts).split()
            at = rng.randrange(len(body))
            docs.append((len(planted), " ".join([*body[:at], *words, *body[at:]])))
            planted[len(planted)] = share, i
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.id, r.item_id) for r in D.contaminated(df, spark.createDataFrame(bench, "item_id long, text string"), rank=64).collect()}
    text, item = dict(docs), dict(bench)
    flat = lambda t: re.findall(r"[^\W_]+", t.lower())
    ids: dict[str, int] = {}
    code = lambda ws: np.array([ids.setdefault(w, len(ids)) for w in ws])

    def accepted(d, i):
        own, doc = code(flat(item[i])), code(flat(text[d]))
        n, reach = len(own), len(own) + len(own) // 4 + 2
        return any(D.common_subsequence(own, doc[s : s + reach]) >= D.COVERED * n for s in range(0, max(1, len(doc) - reach + 1)))

    for share in (0, 10, 20, 30):
        want = [(d, i) for d, (s, i) in planted.items() if s == share and accepted(d, i)]
        caught = sum(x in got for x in want) / len(want)
        assert caught >= (1.0 if not share else 0.9), (share, caught, len(want))
    wrong = [(d, i) for d, i in got if d >= 10_000 and not accepted(d, i)]
    assert len(wrong) <= 0.02 * len(got)
