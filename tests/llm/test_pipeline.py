import hashlib
import re

import corpus_pipeline
from lodestone.llm.common import stage
from tests.llm.test_decontaminate import corpus
from tests.llm.test_simhash import brute as fingerprint
from tests.llm.test_simhash import reach
from tests.llm.test_substring import brute as windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    items, planted, leaks = corpus()
    rows = [(d, t, "en", "s", len(t)) for d, t, _ in planted]
    shared = " ".join(f"shared{i}" for i in range(60))
    rows += [(500 + i, f"start{i} middle{i} {shared} tail{i} end{i} " + " ".join(f"x{i}y{k}" for k in range(60)), None, "s", 9) for i in range(4)]
    rows += [(600, rows[1][1], "en", "s", 3), (601, "123 456", "en", "s", 7), (602, None, "en", "s", None), (603, shared, "en", "s", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = {n: f for n, f in corpus_pipeline.STAGES}
    one = stage(step["language_id"](spark, docs, str(tmp_path)), "t")
    kept = {r.doc_id: r.text for r in one.collect()}
    assert kept.keys() == {r[0] for r in rows} - {601, 602} and one.columns == docs.columns
    assert one.where("lang is null").count() == 0
    two = stage(step["near_dedup"](spark, one, str(tmp_path)), "t")
    ids = sorted(kept)
    label = reach([fingerprint(kept[i]) for i in ids])
    after = {r.doc_id: r.text for r in two.collect()}
    assert sorted(after) == sorted({ids[x] for x in label})
    three = stage(step["substring_dedup"](spark, two, str(tmp_path)), "t")
    want = {d: (n, gone, digest) for d, n, gone, digest in windows(sorted(after.items()), 13)}
    left = {r.doc_id: r.text for r in three.collect()}
    assert left.keys() == {d for d, (n, gone, _) in want.items() if gone < n or not gone} and 603 not in left
    for d, t in left.items():
        assert hashlib.sha256(b" ".join(t.encode().split())).hexdigest() == want[d][2]
    assert all(r.n_chars == len(r.text) for r in three.collect() if want[r.doc_id][1])
    four = stage(step["decontamination"](spark, three, str(tmp_path)), "t")
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    # a passage that an earlier document has is gone already; of the others the first words tell
    still = {d for d, i in leaks if d in left and " ".join(words(items[i][1]).split()[:5]) in words(left[d])}
    assert still and {r.doc_id for r in four.collect()} == left.keys() - still and four.columns == docs.columns
    five = step["packing"](spark, four, str(tmp_path))
    assert {r.doc_id for r in five.collect()} == {r.doc_id for r in four.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(map(tuple, five.drop("sequence_id", "offset").collect()))

CLASHES = ("k", "th", "_k", "_th", "id", "fp", "root", "row", "best", "null", "found", "component", "lang_pred", "_lang_pred", "score", "_score", "kept_text", "n_words", "n_removed", "item_id", "at", "b", "bucket")


def test_edge_cases_of_every_stage(spark, tmp_path):
    """Clashing columns keep their values; nulls, empty and long texts, repeated rows and empty tables give a defined result."""
    body = [" ".join(f"{w}{i}" for w in "the river runs past old stone houses and under a bridge of iron while we wait".split()) for i in range(8)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(body)]
    rows += [(None, body[0], None, None, None), (20, None, "en", None, 0), (21, "", None, "s", 0), rows[3], rows[3], (22, " ".join(f"lange{i % 977}wort" for i in range(40000)), "en", "s", 1), (2**63 - 1, body[1], "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in CLASHES)) for r in rows], SCHEMA + ", " + ", ".join(f"`{c}` string" for c in CLASHES))
    bench = spark.createDataFrame([(1, body[5]), (None, None), (2, "")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    steps, at = dict(corpus_pipeline.STAGES), str(tmp_path)
    for name in ("language_id", "near_dedup", "substring_dedup", "decontamination"):
        out = steps[name](spark, docs, at)
        assert out.columns == docs.columns and steps[name](spark, docs.limit(0), at).count() == 0
        got = out.collect()
        assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in CLASHES)
        ids = sorted((-1 if r.doc_id is None else r.doc_id) for r in got)
        want = {
            "language_id": [-1, 0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 22, 2**63 - 1],
            # texts without a word are one group, which its least id names; of equal texts the least id stays, null last
            "near_dedup": [0, 1, 2, 3, 4, 5, 6, 7, 20, 22],
            # rows of one id never take from each other; the largest id and null ids lose what others have
            "substring_dedup": [-1, 0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 20, 21, 22],
            "decontamination": [-1, -1, 0, 1, 2, 3, 3, 3, 4, 6, 7, 20, 21, 22, 2**63 - 1],
        }[name]
        assert ids == want, name
    packed = steps["packing"](spark, docs, at)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in rows} and steps["packing"](spark, docs.limit(0), at).count() == 0
