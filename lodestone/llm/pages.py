"""Main text of HTML pages: block structure, then a suffix array of each host's token streams."""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import freed, grams, mix, stage, table

#: Boilerplate is a run of RUN tokens, or a whole block of fewer, that occurs on PAGES distinct pages of a host.
RUN, PAGES = 8, 3
#: The hosts' boilerplate runs are broadcast up to this number (8 bytes each); more of them meet their pages in a join.
MOST_RUNS = 4_000_000

# Elements by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("nav header footer aside form menu dialog button select option datalist input label fieldset svg math canvas audio video object applet embed head script style textarea title xmp iframe noembed noframes noscript template".split())
MAIN = frozenset({"article", "main"})
ENDS_P = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "option", "optgroup", "legend"}
#: Roles, and words of class or id that name what isn't part of an article.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager masthead topbar cookie cookies consent gdpr popup modal newsletter comment comments commentlist disqus widget widgets toolbar".split()
)
#: Words that do so outside of an article only: inside one they may be about anything.
NAMED_OUTSIDE = frozenset("banner banners side aside header footer bottom notice notices notification notifications alert alerts overlay subscribe subscription signup login form forms search share sharing social related recommended recommendations toc respond replies reply discussion copyright legal disclaimer skip".split())
#: Names of an article element that is a reader's comment, and of what holds it.
COMMENT = frozenset("comment comments commentlist reply replies".split())
#: Names that mark the article even where another of its names is in NAMED.
CONTENT = frozenset("article content post entry story main body text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
PARENT_END = {"li": {"ul", "ol", "menu"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select", "datalist"}}
SIBLING_END = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}}


def _unwanted(name: str, attrs: str, main: bool) -> bool:
    """Whether an element isn't part of an article, by its kind, role, class or id; main: it lies in an article."""
    if name in DROPPED:
        return True
    if not attrs or name in ("body", "html"):
        return False
    for key, value in ATTR.findall(attrs):
        key = key.lower()
        value = value.strip("\"'")
        if key in ("class", "id"):
            words = set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if name in MAIN:
                if words & COMMENT and (main or not words & CONTENT):
                    return True
            elif words & (NAMED if main else NAMED | NAMED_OUTSIDE) and not (words & CONTENT and not words & {"comment", "comments", "ad", "ads", "sidebar", "nav", "menu", "footer", "related", "share"}):
                return True
            continue
        value = value.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(html: str | None) -> list[tuple[bool, bool, str]]:
    """(in an article or main element, unwanted by its structure, text) of the page's blocks with any text, in order.

    A block is the text between two block boundaries; br ends one too. Unclosed and stray tags are taken as browsers
    would take them, near enough: a list item ends the one before, a block ends an open paragraph, an end tag without
    a start is nothing, what is open at the end of the page ends there.
    """
    if not html:
        return []
    out: list[tuple[bool, bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, inside main, inside unwanted
    main = bad = False

    def flush():
        if text:
            joined = SPACE.sub(" ", unescape("".join(text))).strip()
            if joined:
                out.append((main, bad, joined))
            text.clear()

    def close(depth: int):
        nonlocal main, bad
        if any(n in BLOCK for n, _, _ in stack[depth:]) or any((m, b) != (main, bad) for _, m, b in stack[depth:]):
            flush()
        del stack[depth:]
        if stack:
            if (stack[-1][1], stack[-1][2]) != (main, bad):
                flush()
            main, bad = stack[-1][1], stack[-1][2]
        else:
            if main or bad:
                flush()
            main = bad = False

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        end, start = m.group(1), m.group(2)
        if end:
            name = end.lower()
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == name:
                    close(d)
                    break
            else:
                if name in BLOCK or name == "br":
                    flush()
            continue
        if not start:
            if m.group(0).startswith("<![CDATA["):
                text.append(m.group(0)[9:].removesuffix("]]>"))
            continue
        name = start.lower()
        if name == "br" or name in BLOCK:
            if name in ENDS_P:
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] == "p":
                        close(d)
                        break
                    if stack[d][0] in ("table", "td", "th", "button", "object"):
                        break
            if name in SIBLING_END:
                for d in range(len(stack) - 1, -1, -1):
                    if stack[d][0] in SIBLING_END[name]:
                        close(d)
                        if name != "tr":
                            break
                    elif stack[d][0] in PARENT_END[name]:
                        break
            flush()
        if name in VOID:
            continue
        attrs = m.group(3) or ""
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else n
            continue
        if attrs.rstrip().endswith("/") and name not in BLOCK:
            continue
        unwanted = _unwanted(name, attrs, main)
        inside = main or name in MAIN or re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articlebody\b", attrs, re.I) is not None
        # an article inside reader comments or a sidebar isn't the page's
        if (inside, bad or unwanted) != (main, bad):
            flush()
        main, bad = inside, bad or unwanted
        stack.append((name, main, bad))
    flush()
    return out


def _rank(keys: list[np.ndarray]) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes sorted by their first depth tokens at least, by prefix doubling, and of each place in
    order the number of its group of suffixes that begin alike so far. Done when depth is reached or all differ."""
    rank = _rank([tokens])
    length = 1
    while length < depth and rank.max(initial=0) + 1 < len(rank):
        step = min(length, depth - length)  # the last step overlaps, so that groups agree in depth tokens exactly
        later = np.full(len(rank), -1, np.int64)
        later[:-step] = rank[step:]
        rank = _rank([rank, later])
        length += step
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def _token_ids(text: str) -> list[str]:
    return [w for w in (t.strip(".,;:!?()[]\"'«»“”").lower() for t in text.split()) if w]


def host_of(url: str | None) -> str:
    return (url or "").split("//", 1)[-1].split("/", 1)[0].rsplit("@", 1)[-1].lower()


def _word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Stream:
    """The token streams of some pages, one after the other: what lies outside of article elements, block by block.

    After each block stands a separator of its own (a negative token), so no run crosses blocks or pages. A token is a
    word of a host: equal words of two hosts differ, so equal runs are runs of one host.
    """

    def __init__(self, pages: list[list[tuple[bool, bool, str]]], hosts: list[str]):
        words: dict[tuple[str, str], int] = {}
        ids, self.page, self.block = [], [], []
        self.spans: list[tuple[int, int, int, int]] = []  # page, block, from, to
        for p, (own, host) in enumerate(zip(pages, hosts, strict=True)):
            for k, (main, bad, text) in enumerate(own):
                if main and not bad:
                    continue
                tokens = _token_ids(text)
                self.spans.append((p, k, len(ids), len(ids) + len(tokens)))
                ids += [words.setdefault((host, t), len(words)) for t in tokens]
                ids.append(-len(self.spans))
        self.ids = np.array(ids, np.int64)
        own_hash = {}
        hashes = [_word_hash(t) ^ own_hash.setdefault(h, _word_hash("\n" + h)) for h, t in words]
        self.hash = mix(np.array([*hashes, 0], np.uint64))[np.where(self.ids < 0, len(words), self.ids)]
        self.page = np.repeat(np.array([s[0] for s in self.spans], np.int64), [s[3] - s[2] + 1 for s in self.spans]) if self.spans else np.zeros(0, np.int64)

    def starts(self, run: int) -> np.ndarray:
        """Where a run of tokens begins that lies in one block."""
        n = len(self.ids) - run + 1
        if n < 1:
            return np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(self.ids < 0)]
        return np.flatnonzero(ends[run:] == ends[:n])

    def keys(self, run: int, starts: np.ndarray) -> np.ndarray:
        """The same number for equal runs of one host, in whatever task."""
        return grams(self.hash, run, run)[starts].view(np.int64) if len(starts) else np.zeros(0, np.int64)

    def short(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(span, key) of whole blocks of fewer tokens."""
        at = np.array([i for i, s in enumerate(self.spans) if 0 < s[3] - s[2] < run], np.int64)
        out = np.zeros(len(at), np.uint64)
        for k, i in enumerate(at):
            h = self.hash[self.spans[i][2] : self.spans[i][3]]
            out[k] = grams(h, len(h), run + len(h))[0]
        return at, mix(out + np.uint64(1)).view(np.int64)

    def evidence(self, run: int, names: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, page): for every run and short block, from the suffix array of all the streams, the names of distinct
        pages that have it; no more than least of them, since so many are enough."""
        order, group = suffix_array(self.ids, run) if len(self.ids) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ok = np.zeros(len(self.ids), bool)
        ok[self.starts(run)] = True
        order, group = order[ok[order]], group[ok[order]]
        pair = _few(group, names[self.page[order]], least)
        each, back = np.unique(pair[:, 0], return_inverse=True)
        key = self.keys(run, order[np.searchsorted(group, each)])[back]
        at, short = self.short(run)
        whole = _few(short, names[np.array([self.spans[i][0] for i in at], np.int64)], least)
        return np.r_[key, whole[:, 0]], np.r_[pair[:, 1], whole[:, 1]]

    def covered(self, run: int, boilerplate: np.ndarray) -> np.ndarray:
        """Which tokens lie in one of the runs, or are a whole block, whose (sorted) keys are given."""
        out = np.zeros(len(self.ids), bool)
        if not len(boilerplate):
            return out
        starts = self.starts(run)
        starts = starts[_in(self.keys(run, starts), boilerplate)]
        for k in range(run):
            out[starts + k] = True
        at, key = self.short(run)
        for i in at[_in(key, boilerplate)]:
            out[self.spans[i][2] : self.spans[i][3]] = True
        return out


def _few(group: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """Distinct (group, page), least of each group at most."""
    pair = np.unique(np.stack([group, page], 1).astype(np.int64), axis=0)
    start = np.flatnonzero(np.r_[True, pair[1:, 0] != pair[:-1, 0]][: len(pair)])
    nth = np.arange(len(pair)) - np.repeat(start, np.diff(np.r_[start, len(pair)]))
    return pair[nth < least]


def _in(keys: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return sorted_[at] == keys


def _without(text: str, covered: np.ndarray) -> str:
    """text without its covered tokens; a word of punctuation alone goes with the token before it."""
    out, k, gone = [], -1, False
    for word in text.split():
        if _token_ids(word):
            k += 1
            gone = bool(covered[k])
        if not gone:
            out.append(word)
    return " ".join(out)


def _unguarded(own: list[tuple[bool, bool, str]]) -> list[tuple[bool, bool, str]]:
    """The page's blocks; those that its structure decides have no text: what an article holds stays, what is marked goes."""
    return [(True, False, "") if main or bad else (main, bad, t) for main, bad, t in own]


def _texts(pages: list[list[tuple[bool, bool, str]]], hosts: list[str], boilerplate: np.ndarray, run: int) -> list[str]:
    """Each page's main text: what its structure decides, and of all other blocks what isn't boilerplate."""
    stream = Stream([_unguarded(own) for own in pages], hosts)
    left: dict[tuple[int, int], str] = {}
    if stream.spans:
        gone = stream.covered(run, boilerplate)
        for p, k, a, b in stream.spans:
            if gone[a:b].any():
                left[p, k] = _without(pages[p][k][2], gone[a:b])
    out = []
    for p, own in enumerate(pages):
        stays = [left.get((p, k), t) for k, (_, bad, t) in enumerate(own) if not bad]
        out.append("\n".join(t for t in stays if t))
    return out


def _parts(batch: pa.RecordBatch, n: int):
    for a in range(0, batch.num_rows, n):
        part = batch.slice(a, n)
        yield part, [blocks(h.as_py()) for h in part.column("html")], [host_of(u.as_py()) for u in part.column("url")]


def run_counts(pages: DataFrame, run: int, least: int) -> DataFrame:
    """(key): runs and short blocks outside of articles that least distinct pages have; pages of (page, url, html), page
    being what tells pages apart. Each task sorts the suffixes of its own pages, and names at most least pages of each
    run; equal runs of a host meet by their keys, so it doesn't matter how pages are dealt out, or how often one comes."""

    def work(batches):
        for b in batches:
            for part, own, hosts in _parts(b, 2000):
                key, page = Stream(own, hosts).evidence(run, part.column("page").to_numpy(), least)
                yield pa.record_batch([pa.array(key), pa.array(page)], names=["key", "page"])

    found = pages.mapInArrow(freed(work), "key long, page long")
    return found.groupBy("key").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= least).select("key")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, least_pages: int = PAGES, most_runs: int = MOST_RUNS) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages: the main text, blocks joined by one newline.

    Suffix arrays over the token streams of all pages of a host, outside of article and main elements, give the runs of
    run tokens (and whole blocks of fewer) that occur on least_pages distinct pages: boilerplate. On every page, with an
    article element or without, covered runs go and unique ones stay. The structure guards: what an article or main
    element holds stays but for parts that are marked as no article's, and what elements, roles and names mark as
    navigation, notices, adverts and the like goes even if it is unique. Counts are sums over the whole host by keys of
    the runs, so a result depends on the host's pages only, not on how they are dealt out. The boilerplate goes to the
    workers if it has at most most_runs keys; else each page's keys meet it in a join, with the same result.

    Null html is an empty page with an empty text; a null url is a host of its own with all null urls. Repeated rows
    and null ids stay; rows of one url are one page, however many. An empty table gives no row. Other columns aren't read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    page = F.xxhash64(F.coalesce("url", "html", F.lit("")))
    common = stage(run_counts(rows.select(page.alias("page"), "url", "html"), run, least_pages), "page-runs")
    schema = "page_id long, url string, text string"
    if common.limit(most_runs + 1).count() <= most_runs:
        shared = spark.sparkContext.broadcast(np.sort(common.toArrow().column("key").to_numpy()))

        def work(batches):
            for b in batches:
                for part, own, hosts in _parts(b, 500):
                    yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(_texts(own, hosts, shared.value, run), pa.string())], names=["page_id", "url", "text"])

        out = rows.mapInArrow(freed(work), schema)
    else:
        out = _joined(rows, common, run).mapInArrow(freed(_with_own_keys(run)), schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def _joined(rows: DataFrame, common: DataFrame, run: int) -> DataFrame:
    """rows with found, the boilerplate keys of each page. Pages are told apart by url and html: equal ones have equal
    keys. A key that very many pages ask for is a skewed join of small rows, which AQE splits."""
    rows = rows.withColumn("page", F.unhex(F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), "html").cast("binary"), 256)))

    def asks(batches):
        for b in batches:
            for part, own, hosts in _parts(b, 500):
                page = part.column("page")
                for p in range(len(own)):
                    stream = Stream([_unguarded(own[p])], [hosts[p]])
                    if stream.spans:
                        key = np.unique(np.r_[stream.keys(run, stream.starts(run)), stream.short(run)[1]])
                        yield pa.record_batch([pa.array([page[p].as_py()] * len(key), pa.binary()), pa.array(key)], names=["page", "key"])

    asked = rows.select("page", "url", "html").mapInArrow(freed(asks), "page binary, key long").distinct()
    found = asked.join(common, "key").groupBy("page").agg(F.collect_list("key").alias("found"))
    return rows.join(found, "page", "left").select("page_id", "url", "html", "found")


def _with_own_keys(run: int):
    def work(batches):
        for b in batches:
            for part, own, hosts in _parts(b, 500):
                found = part.column("found").to_pylist()
                text = [_texts([own[p]], [hosts[p]], np.sort(np.array(found[p] or [], np.int64)), run)[0] for p in range(len(own))]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return work


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
