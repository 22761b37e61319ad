import html as H
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm.pages import Stream, blocks, main_text, suffix_array


def test_suffix_array_sorts_by_prefix():
    rng = random.Random(14)
    for _ in range(60):
        t = [rng.randrange(3) for _ in range(rng.randrange(1, 60))]
        depth = rng.randrange(1, 9)
        order, group = suffix_array(np.array(t), depth)
        keys = [t[i : i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)
        for i in range(1, len(t)):
            assert (group[i] == group[i - 1]) == (keys[i] == keys[i - 1])


def test_counts_of_runs_against_brute_force():
    rng = random.Random(15)
    for _ in range(40):
        pages = [[(False, False, " ".join(rng.choices("abc", k=rng.randrange(9)))) for _ in range(rng.randrange(4))] for _ in range(6)]
        hosts = [rng.choice(["x", "y"]) for _ in pages]
        at = {}
        for p, (own, host) in enumerate(zip(pages, hosts, strict=True)):
            for _, _, t in own:
                words = t.split()
                for run in [tuple(words[i : i + 4]) for i in range(len(words) - 3)] or ([tuple(words)] if words else []):
                    at.setdefault((host, run), set()).add(p)
        stream = Stream(pages, hosts)
        names = np.array([rng.getrandbits(60) for _ in pages])
        key, page = stream.evidence(4, names, 99)
        each, n = np.unique(key, return_counts=True)
        assert len({*zip(key.tolist(), page.tolist(), strict=True)}) == len(key) and set(page.tolist()) <= set(names.tolist())
        assert sorted(n.tolist()) == sorted(map(len, at.values()))
        few = Counter(stream.evidence(4, names, 2)[0].tolist())
        assert all(min(few[k], 2) == min(c, 2) for k, c in zip(each.tolist(), n.tolist(), strict=True))
        common = np.sort(each[n >= 2])
        gone = stream.covered(4, common)
        for p, k, a, b in stream.spans:
            words, want = pages[p][k][2].split(), [False] * (b - a)
            if len(words) < 4:
                want = [len(at.get((hosts[p], tuple(words)), ())) >= 2] * len(words)
            for i in range(len(words) - 3):
                if len(at[hosts[p], tuple(words[i : i + 4])]) >= 2:
                    want[i : i + 4] = [True] * 4
            assert gone[a:b].tolist() == want


def test_blocks():
    page = """<p>x<div class='cookie-notice'>We use <b>cookies</b></div><ul><li>a<li>b</ul><main><p>One&nbsp;two &lt;x&gt;<p>Three
    <b>bold</b>.<div id=comments><p>nice</div><script>if(a<b)x</script><pre>a\n  b</pre>tail<table><tr><td>1<td>2</table><aside>no</aside><br>last &amp</main><form>q<input></form><footer>f"""
    assert [t for m, b, t in blocks(page) if m and not b] == ["One two <x>", "Three bold.", "a b", "tail", "1", "2", "last &"]
    assert [t for m, b, t in blocks(page) if not m and not b] == ["x", "a", "b"]
    for odd in (None, "", "   ", "<", "<p", "<!-- open", "<script>never closed", "</p></div>", "<a href='x>y", "&#0;&bogus;", "<article>" * 3000):
        assert isinstance(blocks(odd), list)


def test_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    out = main_text(pages).collect()
    assert len(out) == len(html)
    for r in out:
        inside = html[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inside)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_hosts_without_article_elements(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, want = [], {}
    for i in range(40):
        body = [" ".join(word() for _ in range(30)) for _ in range(2)]
        want[i] = "\n".join(body)
        rows.append((i, f"http://h.example/{i}", f"<div>Home Products Shop Contact us today</div><div>{body[0]}</div><p>{body[1]}</p><div>All content of this site is ours alone</div>", 1))
    rows += [(100, None, None, 1), (101, "http://h.example/x", "", 1), (None, "http://z.example/", "<article>kept</article>", 1), (102, "x", "<article>" + "<p>w w</p>" * 30000 + "</article>", 1), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = main_text(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id in want:
            assert r.text == want[r.page_id]
    assert {r.page_id: r.n_chars for r in out if r.page_id in (100, 101, None, 102)} == {100: 0, 101: 0, None: 4, 102: 4 * 30000 - 1}
    assert main_text(df.limit(0)).count() == 0


def test_notices_of_a_large_host_and_common_phrases(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, want = [], {}
    for i in range(120):
        body = " ".join(word() for _ in range(20))
        rare = "<div>This page moved here from our older site</div>" if i % 40 == 7 else ""
        date = f"{word()} Copyright of all texts and pictures by the authors {word()}"
        # an own sentence most of which is a phrase that all pages have
        rows.append((i, f"http://big.example/{i}", f"<p>At the end of it {word()} {word()}</p>{rare}<p>{body}</p><div>{date}</div>"))
        own = re.search(r"<p>(At.*?)</p>", rows[-1][2])[1]
        want[i] = "\n".join([own, body, f"{date.split()[0]} {date.split()[-1]}"])
    # a page that comes many times is one page
    rows += [(400, "http://big.example/400", "<p>Said by no other page of the host at all</p>")] * 5
    want[400] = "Said by no other page of the host at all"
    # evidence from pages with an article counts for the others of the host, and not for another host
    for i in range(200, 203):
        rows.append((i, f"http://big.example/{i}", "<article>own text</article><div>Only pages with an article say this on this host</div>"))
        want[i] = "own text"
    rows.append((300, "http://big.example/300", "<p>Only pages with an article say this on this host</p><p>alone</p>"))
    rows.append((301, "http://other.example/300", "<p>Only pages with an article say this on this host</p><p>alone</p>"))
    want |= {300: "alone", 301: "Only pages with an article say this on this host\nalone"}
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, key int, found int")
    for most, parts in ((10**6, 3), (10**6, 7), (0, 5)):
        assert {r.page_id: r.text for r in main_text(df.repartition(parts), most_runs=most).collect()} == want


def test_runs_decide_beside_an_article_too(spark):
    """Outside of an article element, what is unmarked goes if the host repeats it and stays if it is unique."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, want = [], {}
    for i in range(12):
        title, end, own = (" ".join(word() for _ in range(n)) for n in (3, 12, 9))
        motto = "Everything on this site was written by hand and by night"
        rows.append((i, f"http://h.example/{i}", f"<div>Home Products Shop</div><h1>{title}</h1><article><p>{own}</p><p>{motto}</p></article><p>{end}</p><div>{word()} {motto}</div><div class=promo>{word()}</div>"))
        want[i] = "\n".join([title, own, motto, end, re.search(r"<div>(\w+) Every", rows[-1][2])[1]])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most, parts in ((10**6, 1), (10**6, 5), (0, 3)):
        assert {r.page_id: r.text for r in main_text(df.repartition(parts), most_runs=most).collect()} == want


def test_pages_without_their_article_tags(spark):
    """What the runs and the remaining structure find where no element marks the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: r.text for r in main_text(pages).collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", "</?(article|main)[^>]*>", ""))
    assert pages.where("html rlike '<(article|main)'").count() > 0 and bare.where("html rlike '<(article|main)'").count() == 0
    hit = got = want = 0
    for r in main_text(bare).collect():
        a, b = Counter(r.text.split()), Counter(truth[r.page_id].split())
        hit, got, want = hit + (a & b).total(), got + a.total(), want + b.total()
    assert hit >= 0.9 * got and hit >= 0.9 * want


def test_names_inside_and_outside_of_articles():
    text = lambda page: [t for m, b, t in blocks(page) if m and not b]
    assert text("<main><article><p>Own</p></article><article class='comment'><p>nice</p></article></main>") == ["Own"]
    assert text("<article><p>Own</p><article id='comment-7'>hi</article><section class=comments>x</section></article>") == ["Own"]
    assert text("<article class='comment'>stray</article>") == []
    assert text("<article class='post comments-open'>Own</article>") == ["Own"]
    assert text("<article><p class='share-price'>Up</p><p class=legal>Law</p><h2 id='form-of-government'>Form</h2><div class='ad'>buy</div></article>") == ["Up", "Law", "Form"]
    assert [t for _, b, t in blocks("<div class=legal>Law</div><p>x</p>") if not b] == ["x"]
