"""The songbook's text lines (S11): sections, anchors, titles, wrapped artists and transliterations, by columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import anchor
from lodestone.operators.ordered import carry_forward, keep_first

# Words that open a section at the start of a line, and page furniture.
SECTIONS = {"보컬로이드": "vocaloid", "특촬물": "anime"}
BOILERPLATE = "^\\s*[0-9]{4}\\s*년|★ 표시는|반주기에 탑재|^일본 애니메이션 곡"
# The default section; a cell's reach to either side of its column; how far a wrap of an unknown column is
# indented at least; lines looked at after an anchor; wraps and transliteration lines taken.
SECTION, REACH, INDENT, AHEAD, WRAPS, KO_LINES = "anime", 12, 25, 6, 2, 2

_SYLLABLES = "가-힣ᄀ-ᇿ㄰-㆏"
HANGUL = re.compile(f"[{_SYLLABLES}]")
JAPANESE = re.compile("[぀-ヿ一-鿿ｦ-ﾟ]")
LATIN = re.compile("[A-Za-z]")
ANCHOR = re.compile(r"(?<![0-9.])([0-9]{4,5})(?![0-9])")
FURNITURE = re.compile(BOILERPLATE)
CELL = re.compile(r"\S+(?:\s{1,3}\S+)*")
TURN = re.compile(f"[{_SYLLABLES}][{_SYLLABLES}\\s]*(?=[^{_SYLLABLES}\\s])")


class Cell(NamedTuple):
    column: int
    text: str


def cells(line: str) -> list[Cell]:
    """The columns of a line: what gaps of four spaces part, with where each begins."""
    return [Cell(m.start(), m.group()) for m in CELL.finditer(line)]


def hangul_only(text: str) -> bool:
    """Hangul, and no kana or Han (F8)."""
    return bool(HANGUL.search(text)) and not JAPANESE.search(text)


def after_hangul(text: str) -> str:
    """What follows the first stretch of Hangul; the whole where there is none, nothing where it goes to the end."""
    if not HANGUL.search(text):
        return text.strip()
    m = TURN.search(text)
    return text[m.end() :].lstrip() if m else ""


def find_anchor(line: str) -> re.Match | None:
    """N10, with its place."""
    fit = [m for m in ANCHOR.finditer(line) if int(m[1]) >= 5000]
    return fit[-1] if fit else None


def title_of(prefix: str) -> str:
    """The last column that isn't Hangul only; of a column into which a Hangul one has run, what follows that."""
    texts = [c.text for c in cells(prefix.strip())]
    own = [t for t in texts if not hangul_only(t)]
    title = own[-1] if own else after_hangul(texts[-1]) if texts and LATIN.search(texts[-1]) else ""
    if HANGUL.search(title) and (JAPANESE.search(title) or LATIN.search(title)):
        title = after_hangul(title) or title
    return title


def column_of(line: str, text: str) -> int | None:
    """N13."""
    return line.find(text) if text and text in line else None


def nearest(found: list[Cell], column: int | None, used: set[Cell]) -> Cell | None:
    """The cell whose column is nearest within REACH, the leftmost of equally near ones, each cell once."""
    if column is None:
        return None
    near = [c for c in found if c not in used and abs(c.column - column) <= REACH]
    return min(near, key=lambda c: abs(c.column - column), default=None)


def wrapped(line: str, column: int | None) -> str | None:
    """The part of a line that goes on with the artist whose column is given."""
    if not line.strip() or find_anchor(line) or FURNITURE.search(line):
        return None
    stars = [Cell(c.column, re.sub(r"^★\s*", "", c.text)) for c in cells(line) if not hangul_only(c.text)]
    found = [c for c in stars if c.text]
    if column is None:
        return found[0].text if found and len(line) - len(line.lstrip()) >= INDENT else None
    best = nearest(found, column, set())
    return best.text if best else None


def artist_of(suffix: str, column: int | None, ahead: Sequence[str]) -> str:
    """The artist with what up to two following lines go on with; one blank line between may be passed."""
    out, taken, blank = suffix.strip(), 0, False
    for line, after in zip(ahead, [*ahead[1:], ""], strict=False):
        if taken == WRAPS:
            break
        if not line.strip():
            if blank or wrapped(after, column) is None:
                break
            blank = True
            continue
        more = wrapped(line, column)
        if not more:
            break
        # Latin words were parted by the line's end, Japanese ones were not
        out += (" " if LATIN.match(out[-1:]) and LATIN.match(more) else "") + more
        taken += 1
    return out


def transliterations(ahead: Sequence[str]) -> list[Cell]:
    """The columns of up to two Hangul lines among the next ones, before an anchor or page furniture."""
    lines: list[str] = []
    for line in (x for x in ahead[:AHEAD] if x.strip()):
        if len(lines) == KO_LINES or find_anchor(line) or FURNITURE.search(line):
            break
        if hangul_only(line):
            lines.append(line)
        elif lines:
            break
    return [c for line in lines for c in cells(line)]


def assign(found: list[Cell], title: str, title_column: int | None, artist: str, artist_column: int | None) -> tuple[str | None, str | None]:
    """(title_ko, artist_ko): Japanese names take the nearest column, the title first; else what is left by position."""
    if title_column is not None and title_column > 5:
        found = [c for c in found if c.column >= title_column - REACH] or found
    wants_title, wants_artist = bool(JAPANESE.search(title)), bool(JAPANESE.search(artist))
    used: set[Cell] = set()
    t = nearest(found, title_column, used) if wants_title else None
    if t:
        used.add(t)
    a = nearest(found, artist_column, used) if wants_artist else None
    if t or a or not found:
        return t and t.text, a and a.text
    first = found[0].text
    if wants_title and wants_artist:
        if len(found) > 1:
            return first, found[1].text
        return (first, None) if title and len(title) < len(artist) else (None, first)
    return first if wants_title else None, first if wants_artist else None


def record(line: str, ahead: Sequence[str]) -> tuple[str, str, str, str | None, str | None]:
    """(tj, title, artist, title_ko, artist_ko) of a line with an anchor and the lines after it."""
    at = find_anchor(line)
    tight = lambda x: " ".join(x.split()) if x else x
    title = title_of(re.sub(r"\s*★\s*$", " ", line[: at.start()]).rstrip())
    suffix = line[at.end() :]
    column = at.end() + len(suffix) - len(suffix.lstrip()) if suffix.strip() else None
    artist = artist_of(suffix, column, ahead)
    ko = assign(transliterations(ahead), title, column_of(line, title), artist, column)
    return at[1], tight(title), tight(artist), tight(ko[0]) or None, tight(ko[1]) or None


def section_word(line: Column) -> Column:
    """F8: the section that a word at the start of the line opens, before a gap."""
    out = F.lit(None).cast("string")
    for word, name in SECTIONS.items():
        out = F.when(line.rlike(f"^{word},?\\s{{2,}}\\S"), name).otherwise(out)
    return out


def is_boilerplate(line: Column) -> Column:
    return line.rlike(BOILERPLATE)


PARSED = "tj string, title string, artist string, title_ko string, artist_ko string"


def _records(batches):
    for b in batches:
        out = [record(x, y) for x, y in zip(b.column("line").to_pylist(), b.column("_ahead").to_pylist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        names = ["tj", "title", "artist", "title_ko", "artist_ko"]
        keep = [i for i, n in enumerate(b.schema.names) if n != "_ahead"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *(pa.array(c, pa.string()) for c in cols)], names=[*(b.schema.names[i] for i in keep), *names])


def anchors(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., line_no, line, section, _ahead) of the lines (by.., line_no, line) that hold a catalogue number, with the
    next lines. by tells books apart: books are read side by side, each in the order of its lines."""
    rows = lines.select(*by, "line_no", F.coalesce("line", F.lit("")).alias("line"))
    plain = ~is_boilerplate(F.col("line"))
    rows = carry_forward(rows, F.when(plain, section_word(F.col("line"))), by, ["line_no"], SECTION, "section")
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(1, AHEAD)
    return rows.withColumn("_ahead", F.collect_list("line").over(w)).where(plain & anchor(F.col("line")).isNotNull())


def read(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., line_no, section, tj, title, artist, title_ko, artist_ko) of every line with an anchor; the artist is empty
    where the book has none (see caveats), the title where it shares another line's. A null line is an empty one."""
    found = anchors(lines, by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name != "_ahead")
    return found.mapInArrow(_records, f"{schema}, {PARSED}").drop("line")


def parse(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """The records of read() that have an artist, the first of each number."""
    return keep_first(read(lines, by).where("artist <> ''"), [*by, "tj"], ["line_no"])


def caveats(found: DataFrame) -> DataFrame:
    """What read() found and parse() leaves out, for the report."""
    return found.where("artist = ''").select("*", F.format_string("L%d: empty artist for code %s", "line_no", "tj").alias("caveat"))


def spills(c: Column) -> Column:
    """A gap of four spaces inside a field."""
    return c.rlike("\\S+\\s{4,}\\S+")


# Artists of the section vocaloid whose songs are anime's, and artists whose categories stay as they were.
TO_ANIME = ("gackt", "garnidelia", "lip×lip", "三月のパンタシア", "team.ねこかん[猫]", "honeyworks", "chicowithhoneyworks")
KEEP_AS_IS = ("米津玄師", "ずっと真夜中でいいのに。", "aimer")
CO_VOCALIST = f"{rules.SPACE}*[（(]\\+[^()（）]+[)）]{rules.SPACE}*$"


def section_category(section: Column, keys: Column, bare_keys: Column) -> Column:
    """the category that a row's section gives its song; null where the song keeps what it has. keys are the match
    keys of all components of the artist, bare_keys those without a trailing (+co-vocalist)."""
    lists = lambda names: F.array(*[F.lit(x) for x in names])
    kept = F.arrays_overlap(F.concat(keys, bare_keys), lists(KEEP_AS_IS))
    return F.when(section == "vocaloid", F.when(kept, F.lit(None)).when(F.arrays_overlap(keys, lists(TO_ANIME)), "anime").otherwise("vocaloid")).otherwise(section)
