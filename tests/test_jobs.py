import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import rows, search
from lodestone.plans import jobs


def song(id, title, artist, **more):
    return {"id": id, "source_url": f"http://x/{id}", "title_primary": title, "title_ko": None, "artist_primary": artist, "artist_ko": None, "karaoke_numbers": {"tj": None, "ky": None, "joysound": None}, "categories": ["jpop"], "crawled_at": "2026-01-01T00:00:00Z"} | more


def test_sources_to_search(spark, tmp_path):
    blog = [song("blog-1-0", "夜に駆ける", "YOASOBI｜ヨアソビ", karaoke_numbers={"tj": "68888", "ky": None, "joysound": None}), song("blog-1-1", "アイドル", "YOASOBI")]
    tj = [song("tj-68888", "夜に駆ける", "ヨアソビ", karaoke_numbers={"tj": "68888", "ky": "5", "joysound": None}), song("tj-2", "Other", "Nobody")]
    (tmp_path / "a.json").write_text(json.dumps(blog))
    (tmp_path / "b.json").write_text(json.dumps(tj))
    jobs.main([str(tmp_path / "a.json"), str(tmp_path / "b.json"), "--out", str(tmp_path / "out")])
    records = spark.read.parquet(str(tmp_path / "out" / "records"))
    got = {r.id: (r.artist_primary, r.artist_aliases, r.tj, r.ky) for r in records.collect()}
    assert got == {"blog-1-0": ("YOASOBI", ["ヨアソビ"], "68888", "5"), "blog-1-1": ("YOASOBI", ["ヨアソビ"], None, None), "tj-2": ("Nobody", None, None, None)}
    index = search.postings(records.withColumnsRenamed({"title_primary": "title", "artist_primary": "artist"}), "id", ["title", "artist", "artist_aliases"])
    ids = lambda q, **k: [r.id for r in jobs.browse(records, index, q, **k).collect()]
    assert sorted(ids("yoasobi")) == ["blog-1-0", "blog-1-1"] and ids("ヨアソビ", vendors=("tj",)) == ["blog-1-0"] and ids(" ") == [] and ids("yoasobi", category="anime") == []
    (tmp_path / "bad.json").write_text(json.dumps([song("BAD", "", "x")]))
    with pytest.raises(ValueError, match="invalid records"):
        jobs.main([str(tmp_path / "bad.json"), "--out", str(tmp_path / "no")])


def test_row_mappers(spark):
    raw = spark.createDataFrame([("/449", 3, "u", "t", None, "a", None, "1", None, None, ["jpop"])], "path string, row int, source_url string, title_primary string, title_ko string, artist_primary string, artist_ko string, tj string, ky string, joysound string, categories array<string>")
    assert rows.blog_records(raw, "now").first().id == "blog-449-3"
    cat = spark.createDataFrame([("u", "t", "a", "7"), ("u", "t2", "a", "8")], "source_url string, title string, artist string, pro string")
    ko = spark.createDataFrame([("7", "티", "에이")], "pro string, sort_title_ko string, sort_song_ko string")
    assert {r.id: (r.title_ko, r.artist_ko, r.categories) for r in rows.vendor_records(cat, ko, "now").collect()} == {"tj-7": ("티", "에이", ["jpop"]), "tj-8": (None, None, ["jpop"])}
    df = spark.createDataFrame([("a", "b", ["x", "y"], ["한", "", "Latin"], " ", "86400"), (None, "b", [], ["One"], "2026-01-01", "x"), ("a", None, None, [], "", "oops")], "p string, k string, al array<string>, l array<string>, d string, e string")
    name, korean = rows.artist_names(F.col("l"))
    got = df.select(rows.bilingual(F.col("p"), F.col("k")), rows.artist_display(F.col("p"), F.col("al")), name, korean, rows.database_date(F.col("d"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("a — b", "a (x, y)", "Latin", "한", "1970-01-02"), ("b", None, "One", None, "2026-01-01"), ("a", "a", None, None, "")]
    assert spark.range(1).select(rows.iso_millis(F.timestamp_millis(F.lit(1500)))).first()[0] == "1970-01-01T00:00:01.500Z"


def test_staging_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    from lodestone.operators import staging

    conf = lambda **x: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: x.get(k.replace(".", "_"), d), set=lambda k, v: None))
    for master in ("spark://x:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            staging.shared_dir(conf(spark_master=master))
    assert staging.shared_dir(conf(spark_master="yarn", spark_checkpoint_dir="hdfs://a/b/")) == "hdfs://a/b"
    kept = staging._staged[:]
    staging._staged.clear()
    at = staging.stage(spark.range(3), "t")
    assert at.count() == 3
    path = staging._staged[0]
    staging.clear(spark)
    assert not staging._staged and not os.path.exists(path.removeprefix("file://"))
    staging._staged.extend(kept)
