import random

from pyspark.sql import functions as F

from lodestone.llm.langid import remainder
from lodestone.llm.toxicity import Matcher, Model, Trie, fit, quoted, score, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(10)
    terms = {"".join(rng.choices("abc", k=rng.randrange(5, 8))): 1.0 for _ in range(25)}
    m = Matcher(Trie(terms, {}))
    for _ in range(3000):
        w = "".join(rng.choices("abcd", k=rng.randrange(1, 10)))
        least = min(distance(w, t) for t in terms)
        got = m(w)
        assert (got is not None) == (least == 0 or least == 1 and len(w) >= 5)
        assert got is None or got[1] == least


def test_quotation():
    t = 'they said "what an idiot you are" in court'.split()
    assert quoted(t, t.index("idiot")) and not quoted(t, t.index("court"))
    assert not quoted("you are an idiot and a fool".split(), 3)


def test_learns_terms_and_stems(spark):
    rng = random.Random(11)
    filler = ["river", "stone", "cloud", "paper", "green", "table", "window", "light"]
    suffix = [a + b for a in "aeiou" for b in "rstlnm"]
    text = lambda extra: " ".join(rng.sample([*rng.choices(filler, k=40), *extra], 40 + len(extra)))
    toxic = [text(rng.sample(["grobbit", "skelfer", "wunkled"], 2) if i % 2 else ["drab" + s for s in rng.sample(suffix, 4)]) for i in range(200)]
    clean = [text([]) for _ in range(600)]
    m = fit(toxic, clean)
    assert m.score(text(["grobbit", "wunkled"])) > 0.5 > m.score(text([])) and m.score(text(["grobbitt", "skelffer", "wunk1ed"])) > 0.5
    assert m.score(text(["drabzz", "drabyy", "drabxo", "drabqq"])) > 0.5
    assert Model(Matcher(Trie({}, {}))).score(None) < 0.5 and fit([], clean).score("grobbit") < 0.5
    rows = [(i, t, 5.0) for i, t in enumerate([*toxic, *clean])] + [(9000, None, 1.0), (9001, "", 1.0), (None, "grobbit skelfer", 1.0), (0, toxic[0], 5.0), (9002, "green " * 20000, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic double")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(800)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = train(docs.drop("toxic"), labels, remainder("doc_id", 5) != 0)
    out = score(docs, model).select("row.*", "score").collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    wrong = [r for r in out if r.doc_id is not None and r.doc_id < 800 and (r.score >= 0.5) != (r.doc_id < 200)]
    assert len(wrong) <= 4
    assert all(r.score < 0.5 for r in out if r.doc_id in (9000, 9001, 9002)) and [r.score >= 0.5 for r in out if r.doc_id is None] == [True]
    assert score(docs.limit(0), train(docs.limit(0).drop("toxic"), labels, remainder("doc_id", 5) != 0)).count() == 0


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = remainder("doc_id", 5) == 0
    out = score(docs.where(held).join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "toxic", "text"), train(docs, labels, ~held)).select("row.*", "score").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in out)
    assert right >= 0.97 * len(out) and sum(r.score >= 0.5 for r in out if r.toxic == 1) >= 0.8 * sum(r.toxic for r in out)


def test_ties_and_clashing_names(spark):
    toxic = [f"grobbit skelfer drabz{i} w{i}" for i in range(30)]
    clean = [f"green river stone w{i} v{i}" for i in range(60)]
    rows = [(i, t, 1.0, "h", i) for i, t in enumerate([*toxic, *clean])] + [(7, toxic[7], 2.0, "g", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out string, row int")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)], "doc_id long, toxic int")
    out = score(docs, train(docs, labels, F.lit(True)))
    assert out.columns == ["row", "score"] and out.select("row.*").columns == docs.columns
    again = out.where("row.doc_id = 7").collect()
    assert len(again) == 4 and len({r.score for r in again}) == 1 and sorted(r.row.score for r in again) == [1.0, 2.0, 2.0, 2.0]


def test_a_long_word_matches_the_stem_it_begins_with():
    m = Matcher(Trie({}, {"grob": 0.5}))
    assert m("grob" + "x" * 500) == (0.5, 0) and m("x" * 500) is None
