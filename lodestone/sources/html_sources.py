"""HTML sources: index links and an artist page's table rows, by a vectorised pass over the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import number_cell, trim

# What a link to a ranking says, the labels of a header row, and the longest cell that is read.
RANKING = "(?i)랭킹|순위|차트|월간|연간|주간|연말|연초|top\\s*[0-9]+"
HEADER = ("TJ", "KY", "JOYSOUND")
LONGEST_CELL = 65536


class _Reader(HTMLParser):
    """Collects anchors; and within the body (a div with the given class, or the page), the cells of table rows as lists
    of lines, and the lines of the first paragraph of the first blockquote."""

    def __init__(self, body_class: str | None):
        super().__init__(convert_charrefs=True)
        self.body_class = body_class
        self.links, self.rows, self.heading = [], [], None
        self.link = self.cell = self.row = None
        self.size = 0
        self.depth = 0 if body_class else 1  # of open divs, counted from the body's on; 0 is outside
        self.quotes = self.paragraphs = 0
        self.lines = None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "a":
            self.link = [own.get("href") or "", ""]
        if tag == "div" and self.body_class and (self.depth or self.body_class in (own.get("class") or "").split()):
            self.depth += 1
        if not self.depth:
            return
        if tag == "blockquote":
            self.quotes += 1
        elif tag == "p" and self.quotes == 1:
            self.paragraphs += 1
            self.lines = [""] if self.paragraphs == 1 else None
        elif tag == "tr":
            self._end_row()
            self.row = []
        elif tag == "td":
            self._end_cell()
            self.cell, self.size = [""], 0
        elif tag == "br":
            for lines in (self.cell, self.lines):
                if lines is not None:
                    lines.append("")
        if self.cell is not None and tag != "td":
            self.size += len(self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        if tag == "a" and self.link is not None:
            self.links.append((self.link[0], self.link[1].strip()))
            self.link = None
        if tag == "div" and self.body_class and self.depth:
            self.depth -= 1
            if not self.depth:
                self._end_row()
        if tag in ("p", "blockquote") and self.lines is not None:
            self.heading, self.lines = [x.replace("\xa0", " ").strip() for x in self.lines], None
        if tag == "td":
            self._end_cell()
        elif tag in ("tr", "table"):
            self._end_row()

    def handle_data(self, data):
        if self.link is not None:
            self.link[1] += data
        if self.cell is not None:
            self.cell[-1] += data
            self.size += len(data)
        if self.lines is not None:
            self.lines[-1] += data

    def _end_cell(self):
        if self.cell is not None and self.row is not None:
            self.row.append([x.replace("\xa0", " ").strip() for x in self.cell] if self.size <= LONGEST_CELL else None)
        self.cell = None

    def _end_row(self):
        self._end_cell()
        if self.row:
            self.rows.append(self.row)
        self.row = None


def _read(html: str | None, body_class: str | None = None) -> _Reader:
    r = _Reader(body_class)
    r.feed(html or "")
    r.close()
    if r.link is not None:
        r.handle_endtag("a")
    if r.lines is not None:
        r.handle_endtag("p")
    r._end_row()
    return r


def _each(pages: DataFrame, id_col: str, html_col: str, found, kinds: tuple, schema: str) -> DataFrame:
    """A row (id, values..) for each tuple that found gives of a page."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            for i, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = [(i, *x) for x in found(html.as_py())]
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), *kinds), strict=True)], names=names)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, schema)


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pos, href, text) of every anchor."""
    found = lambda html: [(p, h, t) for p, (h, t) in enumerate(_read(html).links)]
    return _each(pages, id_col, html_col, found, (pa.int32(), pa.string(), pa.string()), "id long, pos int, href string, text string")


def index_paths(found: DataFrame, host: str = "[^/]+", ranking: str = RANKING) -> DataFrame:
    """(id, path, pos) of an index page's links to posts, each at its first place: /number, or the same with the
    host before it; without links to rankings."""
    path = F.nullif(F.regexp_extract("href", f"^(?:https?://{host})?(/[0-9]+)$", 1), F.lit(""))
    good = found.withColumn("path", path).where(F.col("path").isNotNull() & ~F.col("text").rlike(ranking))
    return good.groupBy("id", "path").agg(F.min("pos").alias("pos"))


def table_rows(pages: DataFrame, id_col: str, html_col: str, body_class: str | None = None) -> DataFrame:
    """(id, row, cells) of every table row, numbered within its page; a cell is its lines, null if longer than
    LONGEST_CELL. With body_class only what a div of that class holds is read; a page without one has no row."""
    found = lambda html: list(enumerate(_read(html, body_class).rows))
    return _each(pages, id_col, html_col, found, (pa.int32(), pa.list_(pa.list_(pa.string()))), "id long, row int, cells array<array<string>>")


def headings(pages: DataFrame, id_col: str, html_col: str, body_class: str | None = None) -> DataFrame:
    """(id, lines) of the first paragraph of the first blockquote, for pages that have one."""

    def found(html):
        heading = _read(html, body_class).heading
        return [] if heading is None else [(heading,)]

    return _each(pages, id_col, html_col, found, (pa.list_(pa.string()),), "id long, lines array<string>")


def song_rows(rows: DataFrame) -> DataFrame:
    """Rows of four cells as (id, row, title, title_ko, tj, ky, joysound); header rows and rows without a title go."""
    lines = F.filter(F.col("cells")[0], lambda x: x != "")
    whole = lambda i: trim(F.array_join(F.col("cells")[i], ""))
    header = whole(1).isin(*HEADER) | whole(2).isin(*HEADER) | whole(3).isin(*HEADER)
    out = rows.where((F.size("cells") == 4) & ~F.coalesce(header, F.lit(False))).select(
        "id", "row", F.try_element_at(lines, F.lit(1)).alias("title"), F.try_element_at(lines, F.lit(2)).alias("title_ko"),
        *[number_cell(F.col("cells")[i], d).alias(n) for i, (n, d) in enumerate((("tj", 6), ("ky", 6), ("joysound", 7)), 1)],
    )
    return out.where("title IS NOT NULL")


def artist_pages(pages: DataFrame, id_col: str, html_col: str, body_class: str | None = None) -> DataFrame:
    """song_rows with the page's artist_primary and artist_ko; pages without an artist give nothing."""
    from lodestone.operators.rows import artist_names

    primary, ko = artist_names(F.col("lines"))
    names = headings(pages, id_col, html_col, body_class).select("id", primary.alias("artist_primary"), ko.alias("artist_ko"))
    return song_rows(table_rows(pages, id_col, html_col, body_class)).join(names.where("artist_primary IS NOT NULL"), "id")
