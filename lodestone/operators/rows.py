"""Row mappers between sources, records and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "cast(null AS string)"


def blog_records(raw: DataFrame, crawled_at: str) -> DataFrame:
    """Raw rows (path, row, source_url, title_primary, title_ko, artist_primary, artist_ko, tj, ky, joysound,
    categories) as records; the id is made of the post in the path and the row. A path that names no post is an error."""
    post = F.regexp_extract("path", "^/([0-9]+)$", 1)
    checked = F.when(post != "", post).otherwise(F.raise_error(F.concat(F.lit("no post in path "), "path")))
    return raw.withColumns({"id": F.concat_ws("-", F.lit("blog"), checked, "row"), "crawled_at": F.lit(crawled_at)}).drop("path", "row")


def vendor_records(raw: DataFrame, enrichment: DataFrame, crawled_at: str) -> DataFrame:
    """Catalogue rows (source_url, title, artist, pro) as records, with the Korean names of the enrichment
    (pro, sort_title_ko, sort_song_ko) of their number. A row without a number is an error."""
    pro = F.when(F.coalesce("pro", F.lit("")) != "", F.col("pro")).otherwise(F.raise_error(F.concat(F.lit("no number for "), "title")))
    ko = enrichment.select("pro", F.col("sort_title_ko").alias("title_ko"), F.col("sort_song_ko").alias("artist_ko"))
    out = raw.withColumn("pro", pro).join(ko, "pro", "left")
    return out.select(
        F.concat(F.lit("tj-"), "pro").alias("id"), "source_url", F.col("title").alias("title_primary"), "title_ko", F.col("artist").alias("artist_primary"), "artist_ko",
        F.col("pro").alias("tj"), F.expr(NONE).alias("ky"), F.expr(NONE).alias("joysound"), F.array(F.lit("jpop")).alias("categories"), F.lit(crawled_at).alias("crawled_at"),
    )


def artist_names(lines: Column) -> tuple[Column, Column]:
    """(artist_primary, artist_ko) of a heading's lines: of two the first is the Korean one; one is the name itself."""
    filled = F.filter(lines, lambda x: x != "")
    first, second = F.try_element_at(filled, F.lit(1)), F.try_element_at(filled, F.lit(2))
    return F.coalesce(second, first), F.when(second.isNotNull(), first)


def bilingual(primary: Column, ko: Column) -> Column:
    """Both names with a dash; else the one there is; else the dash."""
    both = (F.coalesce(primary, F.lit("")) != "") & (F.coalesce(ko, F.lit("")) != "")
    return F.when(both, F.concat_ws(" — ", primary, ko)).otherwise(F.coalesce(primary, ko, F.lit("—")))


def title_display(title: Column, title_ko: Column, media: Column) -> Column:
    """The titles, and the media context unless the Korean title has it."""
    shown = (F.coalesce(media, F.lit("")) != "") & ~F.coalesce(title_ko, F.lit("")).contains(F.coalesce(media, F.lit("")))
    return F.when(shown, F.concat_ws(" ", bilingual(title, title_ko), media)).otherwise(bilingual(title, title_ko))


def artist_display(primary: Column, aliases: Column) -> Column:
    """The name, with its aliases in parentheses."""
    return F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0, F.concat(primary, F.lit(" ("), F.array_join(aliases, ", "), F.lit(")"))).otherwise(primary)


def database_date(stated: Column, epoch: Column) -> Column:
    """The stated date, else the day of the epoch seconds in UTC, else nothing."""
    seconds = F.when(epoch.rlike("^[0-9]+$"), epoch.try_cast("long"))
    day = F.when(seconds > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))
    return F.coalesce(F.nullif(F.trim(stated), F.lit("")), day, F.lit(""))


def iso_millis(at: Column) -> Column:
    """P10: a timestamp to the millisecond, in UTC where the session's zone is."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
