import random
import re

import numpy as np

from lodestone.llm.licenses import TEMPLATES, align, scan


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def test_align_counts_common_words_in_order():
    rng = random.Random(12)
    for _ in range(100):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 10))]
        b = [rng.randrange(5) for _ in range(rng.randrange(1, 10))]
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        n, first, end = align(np.array(a), np.array(b), 0)
        assert n == row[-1]
        if n:
            assert b[first] in a and b[end - 1] in a and n <= end - first


def test_finds_exact_and_changed_templates(spark):
    rng = random.Random(13)
    noise = lambda n: " ".join(rng.choices(["river", "stone", "under", "the", "license", "cc", "version"], k=n))
    names = sorted(TEMPLATES)
    rows, want = [], set()
    for i in range(60):
        name = names[i % len(names)]
        body = TEMPLATES[name].split()
        if len(body) > 20 and i % 2:
            del body[7], body[15]
        rows.append((i, f"{noise(20)}. é {' '.join(body)} {noise(30)}", "x"))
        want.add((i, name))
    rows += [(100, None, "x"), (101, "", "x"), (102, noise(5), "x"), (None, TEMPLATES["mit-line"], "x"), (103, noise(30000) + " zz " + TEMPLATES["mit-line"], "x"), rows[0]]
    out = scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    got = {(r.id, r.license) for r in out}
    assert want | {(None, "mit-line"), (103, "mit-line")} <= got
    assert {i for i, _ in got} == set(range(60)) | {None, 103}
    assert sum(r.id == 0 for r in out) == 2 * len({x for x in got if x[0] == 0})
    text = {i: t for i, t, _ in rows}
    for r in out:
        piece = text[r.id].encode()[r.start_byte : r.end_byte].decode()
        assert words(piece) == words(text[r.id])[r.first_word : r.end_word]
        assert r.coverage >= 0.75 and r.matched_words <= r.end_word - r.first_word


def test_every_licence_line_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(r.id, r.license) for r in scan(docs).collect()}
    flat = {k: " " + " ".join(words(v)) + " " for k, v in TEMPLATES.items()}
    want = {(d.doc_id, k) for d in docs.collect() for k, v in flat.items() if v in " " + " ".join(words(d.text)) + " "}
    assert want == got


def brute_places(text, index):
    """All verbatim places of all templates, a template giving way to a longer one that covers its place."""
    flat = words(text)
    found = []
    for name, template in TEMPLATES.items():
        own, i = words(template), 0
        while i + len(own) <= len(flat):
            if flat[i : i + len(own)] == own:
                found.append((name, i, i + len(own)))
                i += len(own)
            else:
                i += 1
    longer = lambda f, k: k[2] - k[1] > f[2] - f[1] or (k[2] - k[1] == f[2] - f[1] and k[0] < f[0])
    return {f for f in found if not any(k != f and f[1] < k[2] and k[1] < f[2] and longer(f, k) for k in found)}


def test_every_place_of_repeated_templates(spark):
    rng = random.Random(21)
    names = sorted(TEMPLATES)
    rows = [(n, " ".join([TEMPLATES["mit-line-licensed"]] * n)) for n in (1, 2, 3, 500, 4000)]
    for i in range(30):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts.append(TEMPLATES[rng.choice(names)])
            if rng.random() < 0.4:
                parts.append(" ".join(f"q{rng.randrange(99)}" for _ in range(rng.randrange(1, 15))))
        rows.append((10_000 + i, " ".join(parts)))
    out = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {}
    for r in out:
        got.setdefault(r.id, set()).add((r.license, r.first_word, r.end_word))
    for d, t in rows:
        assert got[d] >= brute_places(t, None), d
        if d < 10_000:
            assert len(got[d]) == d
    assert len(out) == sum(map(len, got.values()))


def test_a_changed_place_before_a_whole_one(spark):
    line = TEMPLATES["bsd-grant"].split()
    changed = [*line[:4], "also", *line[5:]]
    df = spark.createDataFrame([(1, " ".join([*changed, *line, *changed]))], "doc_id long, text string")
    assert [(r.license, r.matched_words, r.first_word) for r in scan(df).orderBy("first_word").collect()] == [("bsd-grant", len(line) - 1, 0), ("bsd-grant", len(line), len(line)), ("bsd-grant", len(line) - 1, 2 * len(line))]
