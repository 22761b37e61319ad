"""Text keys and name splitting as Column expressions; NFKC alone needs a (vectorised) UDF."""

from __future__ import annotations

from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions import rules


def _normalised(x: pa.Array) -> pa.Array:
    """The composed compatibility form. (Arrow's own utf8_normalize leaves NFKC decomposed in the version at hand.)"""
    return pa.array([v if v is None or v.isascii() else normalize("NFKC", v) for v in x.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def nfkc(x: pa.Array) -> pa.Array:
    return _normalised(x)


@F.arrow_udf(ArrayType(StringType()))
def nfkc_each(x: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy()
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("int32")), _normalised(x.flatten()), mask=x.is_null())


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{rules.SPACE}+|{rules.SPACE}+$", "")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim), lambda p: p != "")


def identity_key(c: Column) -> Column:
    """Compatibility form, small letters, and nothing but letters, numbers and marks."""
    return F.regexp_replace(F.lower(nfkc(c)), "[^\\p{L}\\p{N}\\p{M}]", "")


def match_key(c: Column) -> Column:
    """Without white space, small letters, then the compatibility form; punctuation stays. The order differs from
    identity_key's on purpose: what only the compatibility form turns into capitals stays capital."""
    return nfkc(F.lower(F.regexp_replace(c, rules.SPACE, "")))


def match_keys(parts: Column) -> Column:
    """match_key of each element."""
    return nfkc_each(F.transform(parts, lambda p: F.lower(F.regexp_replace(p, rules.SPACE, ""))))


def collab_parts(c: Column) -> Column:
    """The raw parts of a joint credit: the whole, the main artists, then guests, and guests' names and groups."""
    whole = trim(c)
    guests = F.regexp_extract_all(whole, F.lit(rules.GUEST), F.lit(1))
    main = trim(F.regexp_replace(whole, rules.GUEST, " "))
    groups = F.transform(guests, lambda g: F.concat(F.array(g), F.when(g.rlike(rules.MEMBER_OF), _filled(F.split(g, rules.MEMBER_OF))).otherwise(F.array().cast("array<string>"))))
    parts = F.concat(F.array(whole), _filled(F.split(main, rules.COLLAB_SPLIT)), F.flatten(groups))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(parts)


def split_collab(df, col: str, out: str = "parts"):
    """df with the array of a credit's components, whole first, one for each match key, in a column out."""
    numbered = "transform(_p, (p, i) -> struct(p AS p, _k[i] AS k, i AS i))"
    firsts = f"transform(filter({numbered}, x -> x.k <> '' AND array_position(_k, x.k) = x.i + 1), x -> x.p)"
    keyed = df.withColumn("_p", collab_parts(F.col(col))).withColumn("_k", match_keys(F.col("_p")))
    return keyed.withColumn(out, F.expr(firsts)).drop("_p", "_k")


def lead(parts: Column) -> Column:
    """The match key of the first component besides the whole, or of the whole; empty if there is none."""
    return match_key(F.coalesce(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1)), F.lit("")))


def pipe_segments(c: Column) -> Column:
    """The non-empty segments of a name with the full-width pipe in compatibility form; none without the pipe."""
    segments = _filled(nfkc_each(F.split(c, rules.PIPE)))
    return F.when(c.contains(rules.PIPE), segments).otherwise(F.array().cast("array<string>"))


def has_guest(c: Column) -> Column:
    return c.rlike(rules.HAS_GUEST)


def exclusive(categories: Column) -> Column:
    """The first of CATEGORY_PRIORITY that is present removes the others; unknown values stay; sorted."""
    out = categories
    for i, top in reversed(list(enumerate(rules.CATEGORY_PRIORITY))):
        others = F.array(*[F.lit(x) for j, x in enumerate(rules.CATEGORY_PRIORITY) if j != i])
        out = F.when(F.array_contains(categories, top), F.array_except(categories, others)).otherwise(out)
    return F.array_sort(F.array_distinct(out))


# Words for a kind of media in Korean parentheses.
MEDIA_WORD = "OST|OP|ED|극장판|TV|OVA|삽입곡|MV|오프닝|엔딩"


def media_context(c: Column) -> Column:
    """The parentheses with Hangul and a word for a kind of media, joined by a space; null if there is none."""
    found = F.filter(F.regexp_extract_all(c, F.lit("\\([^()]*\\)"), F.lit(0)), lambda p: p.rlike("[\\uAC00-\\uD7AF]") & p.rlike(MEDIA_WORD))
    return F.nullif(F.array_join(found, " "), F.lit(""))


def source_slug(c: Column) -> Column:
    return F.substring_index(c, "-", 1)


def source_rank(slug: Column, order: tuple[str, ...] | None = None) -> Column:
    """The place of a source in order, or its general rank; sources that aren't listed come last."""
    ranks = {s: i for i, s in enumerate(order)} if order else rules.SOURCE_RANK
    out = F.lit(2**31 - 1)
    for s, r in ranks.items():
        out = F.when(slug == s, F.lit(r)).otherwise(out)
    return out


def number_cell(lines: Column, digits: int) -> Column:
    """A vendor's number from a cell's lines; null if there is none, more than one, or one with too many digits,
    and for a cell that is too long to be read (null)."""
    clean = F.filter(F.transform(lines, lambda v: trim(F.regexp_replace(v, "[\\x{A0}\\x{202F}\\x{2007}\\x{200B}]", " "))), lambda v: ~v.isin("", "-", "–", "—"))
    only = F.try_element_at(clean, F.lit(1))
    return F.when((F.size(clean) == 1) & ~(only.rlike("^[0-9]+$") & (F.length(only) > digits)), only)


def anchor(c: Column) -> Column:
    """The rightmost run of four or five digits, alone and not after a point, of at least 5000."""
    runs = F.regexp_extract_all(c, F.lit("(?<![0-9.])([0-9]{4,5})(?![0-9])"), F.lit(1))
    return F.try_element_at(F.filter(runs, lambda r: r.cast("int") >= 5000), F.lit(-1))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, f"{rules.SPACE}+", " "))
