"""The closed record schema as a column of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's patterns and enumerations.
ID, MEDIA, STAMP = "^[a-z0-9-]+-[0-9]+$", "^\\(.*\\)$", "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
SOURCES, CONFIDENCES, CATEGORIES = ("blog", "llm-translated", "manual"), ("high", "medium", "low"), ("jpop", "vocaloid", "anime")
FIELDS = ("id", "source_url", "title_primary", "title_ko", "artist_primary", "artist_ko", "artist_aliases", "karaoke_numbers", "categories", "crawled_at", "media_context_ko", "title_ko_source", "title_ko_confidence")


def check(*rules: tuple[str, Column]) -> Column:
    """An array of the names of the rules that fail (are not true)."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]), lambda x: x.isNotNull())


def optional(c: Column, ok: Column) -> Column:
    return c.isNull() | ok


def record_errors() -> Column:
    """F14 for the flat record columns."""
    c = F.col
    filled = lambda n: c(n).isNotNull() & (c(n) != "")
    return check(
        ("id must match pattern", c("id").rlike(ID)),
        ("source_url must be a uri", c("source_url").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")),
        ("title_primary must not be empty", filled("title_primary")),
        ("artist_primary must not be empty", filled("artist_primary")),
        ("title_ko must not be empty", optional(c("title_ko"), c("title_ko") != "")),
        ("artist_ko must not be empty", optional(c("artist_ko"), c("artist_ko") != "")),
        ("artist_aliases must be unique", optional(c("artist_aliases"), F.size("artist_aliases") == F.size(F.array_distinct("artist_aliases")))),
        ("artist_aliases must not hold empty names", optional(c("artist_aliases"), ~F.array_contains("artist_aliases", ""))),
        ("categories must be exactly one", (F.size("categories") == 1) & c("categories")[0].isin(*CATEGORIES)),
        ("crawled_at must be a date-time", c("crawled_at").rlike(STAMP)),
        ("media_context_ko must match pattern", optional(c("media_context_ko"), c("media_context_ko").rlike(MEDIA))),
        ("title_ko_source must be known", optional(c("title_ko_source"), c("title_ko_source").isin(*SOURCES))),
        ("title_ko_confidence must be known", optional(c("title_ko_confidence"), c("title_ko_confidence").isin(*CONFIDENCES))),
        ("title_ko_confidence needs llm-translated", optional(c("title_ko_confidence"), c("title_ko_source") == "llm-translated")),
    )


def report(rows: DataFrame, errors: Column) -> DataFrame:
    """(error, n): messages by their first 80 characters."""
    return rows.select(F.explode(errors).alias("e")).groupBy(F.substring("e", 1, 80).alias("error")).agg(F.count("*").alias("n"))


def unknown_fields(raw: Column) -> Column:
    """The keys of a JSON object that the closed schema doesn't know."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(x) for x in FIELDS]))
