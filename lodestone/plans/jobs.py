"""The jobs end to end: sources to a merged, validated table, and queries against it."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import identity_key
from lodestone.operators import aliases, changes, merge, search, validate
from lodestone.operators.ordered import numbered
from lodestone.operators.staging import stage
from lodestone.plans.crawls import chosen
from lodestone.sources.json_sources import read_records
from lodestone.sources.sinks import write_json_array


def concatenate(sources: list[DataFrame]) -> DataFrame:
    """The sources in their order, each in its own seq order, with one seq over all."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return numbered(out, ["_source", "seq"], "_all").withColumn("seq", F.col("_all")).drop("_all", "_source")


def resolve_and_merge(sources: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, merge conflicts, alias conflicts). A record that breaks the schema stops the job."""
    resolved, clashes = aliases.resolve(concatenate(sources))
    clustered = stage(merge.clusters(resolved), "job-clusters")
    records = stage(merge.merge(clustered).drop("tier"), "job-records")
    bad = records.select("id", validate.record_errors().alias("errors")).where(F.size("errors") > 0).limit(5).collect()
    if bad:
        raise ValueError("invalid records: " + "; ".join(f"{r.id}: {', '.join(r.errors)}" for r in bad))
    return records, merge.conflicts(clustered), clashes


def browse(records: DataFrame, index: DataFrame, text: str, category: str = "all", vendors: tuple[str, ...] = (), cap: int = 50) -> DataFrame:
    """Q4: the best records for a query, with their score, after the category and vendor filters; none for no query."""
    terms = [r.t for r in records.sparkSession.sql("SELECT explode(split(:q, '[\\\\s\\\\p{P}\\\\p{Z}]+')) AS w", args={"q": text}).select(identity_key(F.col("w")).alias("t")).collect() if r.t]
    if not terms:
        return records.withColumn("score", F.lit(0.0)).limit(0)
    hits = search.search(index, terms)
    found = records.join(hits, "id").where(changes.has_category(F.col("categories"), category) & changes.any_vendor(vendors))
    return search.top(found, cap)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Merge record files (JSON arrays) and registered sources into one Parquet table.")
    p.add_argument("files", nargs="*", help="JSON files, the first ones first in order")
    p.add_argument("--source", default="", help="names of registered sources, with commas; they come after the files")
    p.add_argument("--limit", type=_natural, default=0, help="records of each source at most; 0: all")
    p.add_argument("--out", required=True)
    p.add_argument("--conflicts-out", help="where the summary of the conflicts goes, one JSON document")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    names = [n.strip() for n in args.source.split(",") if n.strip()]
    tables = [read_records(spark, s) for s in args.files] + [s(spark) for s in (chosen(names) if names else [])]
    if not tables:
        p.error("no file and no source is given")
    if args.limit:
        tables = [x.orderBy("seq").limit(args.limit) for x in tables]
    records, conflicts, clashes = resolve_and_merge(tables)
    merge.ordered(records).write.mode("overwrite").parquet(f"{args.out}/records")
    conflicts.write.mode("overwrite").parquet(f"{args.out}/conflicts")
    clashes.write.mode("overwrite").parquet(f"{args.out}/alias_conflicts")
    if args.conflicts_out:
        write_json_array(merge.summary(conflicts, clashes), args.conflicts_out)


def _natural(text: str) -> int:
    if (n := int(text)) < 0:
        raise argparse.ArgumentTypeError("a non-negative integer is needed")
    return n


if __name__ == "__main__":
    main()
