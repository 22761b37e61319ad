"""Sinks: Parquet tables, one JSON document swapped in whole, numbered chunks, a review CSV."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of a record that are left out when null; the others are written as null.
OPTIONAL = ("artist_aliases", "media_context_ko", "title_ko_source", "title_ko_confidence")


def replace_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """A text file on any file system that Spark reaches, written beside its place and then renamed into it."""
    jvm = spark.sparkContext._jvm
    to, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()
    fs.delete(to, False)
    if not fs.rename(beside, to):
        raise OSError(f"could not rename {path}.tmp to {path}")


def write_json_array(rows: DataFrame, path: str, optional: tuple[str, ...] = OPTIONAL) -> int:
    """K1: rows as one indented JSON array, in their order. A document of this kind is for one reader; rows come to the
    driver a partition at a time. Returns how many there were."""
    n = 0

    def parts():
        nonlocal n
        yield "["
        for r in rows.toLocalIterator():
            d = {k: v for k, v in r.asDict(recursive=True).items() if v is not None or k not in optional}
            yield (",\n" if n else "\n") + "  " + json.dumps(d, ensure_ascii=False, indent=2).replace("\n", "\n  ")
            n += 1
        yield "\n]\n" if n else "]\n"

    replace_text(rows.sparkSession, path, parts())
    return n


def _quoted(col: str) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.col(col).alias("x"))), "^\\{.x.:(.*)\\}$", 1)


def cache_document(header: DataFrame, numbers: DataFrame, artists: DataFrame) -> DataFrame:
    """K3: (name, value) of the cache's members as JSON: extras first, then the engine's own, which win; bootstrappedAt
    is left out where it is null. Entries stay tables; only the whole document is one value."""
    own = header.select(F.explode(F.map_concat("extras", F.create_map(F.lit("version"), F.col("version").cast("string"), F.lit("generatedAt"), _quoted("generated_at")))).alias("name", "value"))
    stamp = header.where("bootstrapped_at IS NOT NULL").select(F.lit("bootstrappedAt").alias("name"), _quoted("bootstrapped_at").alias("value"))
    maps = []
    for name, rows, key in (("proEnrichmentMap", numbers, "pro"), ("artistNationalityMap", artists, "key")):
        entry = F.struct(*[c for c in rows.columns if c != key])
        maps.append(rows.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), entry.alias("e")))))).alias("value")).select(F.lit(name).alias("name"), "value"))
    return own.union(stamp).union(maps[0]).union(maps[1])


def write_chunks(rows: DataFrame, chunk: str, path: str) -> None:
    """K4: rows as JSON, a folder for each chunk number, of two digits at least (lpad alone would cut longer ones)."""
    number = F.col(chunk).cast("string")
    rows.withColumn("_chunk", F.lpad(number, F.greatest(F.lit(2), F.length(number)), "0")).repartition("_chunk").write.partitionBy("_chunk").json(path)


def review_rows(decisions: DataFrame) -> DataFrame:
    """K5: what a person should look at."""
    return decisions.where("confidence IN ('medium', 'low')").select("id", "title_primary", "title_ko", "confidence", "reasoning")


def csv_field(c: Column) -> Column:
    """K5: a field, in quotes where it has a comma, a quote or a line's end; null is empty."""
    x = F.coalesce(c, F.lit(""))
    return F.when(x.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def review_lines(decisions: DataFrame) -> DataFrame:
    """K5: (id, line) of the review, a CSV line each."""
    rows = review_rows(decisions)
    return rows.select("id", F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in rows.columns]).alias("line"))


def write_review(decisions: DataFrame, path: str) -> None:
    """K5: the review as one CSV file with a byte order mark and a header; it is for a person, so it is small."""
    rows = review_rows(decisions)
    lines = (r.line + "\n" for r in review_lines(decisions).orderBy("id").toLocalIterator())
    replace_text(decisions.sparkSession, path, itertools.chain(["\ufeff" + ",".join(rows.columns) + "\n"], lines))


def report(rows: DataFrame, by: str, order: str, sample: int = 20) -> DataFrame:
    """K7: counts by a column, with the first values of order of each as a sample."""
    w = Window.partitionBy(by).orderBy(order)
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample).groupBy(by).agg(F.array_sort(F.collect_list(order)).alias("sample"))
    return rows.groupBy(by).agg(F.count("*").alias("n")).join(top, by)


def ingest_report(read: DataFrame, caveats: DataFrame, counters: DataFrame, sample: int = 20) -> DataFrame:
    """K7: (part, name, value) of an ingest: the counters (name, n), the caveats (line_no, caveat), and the first sample
    rows by line, each as JSON."""
    head = read.orderBy("line_no").limit(sample).select(F.lit("sample").alias("part"), F.col("line_no").cast("string").alias("name"), F.to_json(F.struct(*read.columns)).alias("value"))
    return counters.select(F.lit("counter").alias("part"), "name", F.col("n").cast("string").alias("value")).union(caveats.select(F.lit("caveat"), F.col("line_no").cast("string"), "caveat")).union(head)
