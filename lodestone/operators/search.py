"""Boosted full-text search: an inverted index as tables, prefix and fuzzy terms, BM25 scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import identity_key
from lodestone.operators.staging import stage

#: Field boosts and the share of a term's letters that may differ.
BOOSTS, FUZZY = {"title": 3.0, "artist": 2.0}, 0.2
#: Okapi BM25 (Robertson and Zaragoza, 2009); terms that match by prefix or with edits weigh less.
K1, B = 1.2, 0.75
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45


def postings(rows: DataFrame, id_col: str, fields: Sequence[str], term: Callable[[Column], Column] = identity_key) -> DataFrame:
    """Q1: (id, field, term, tf, length): terms are the keys that term makes (X3) of the words of a field; array fields
    count as one. The table is staged: a search reads it several times."""
    parts = [F.struct(F.lit(f).alias("field"), (F.concat_ws(" ", f) if rows.schema[f].dataType.typeName() == "array" else F.col(f)).alias("text")) for f in fields]
    words = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("e")).select("id", "e.field", F.explode(F.split("e.text", "[\\s\\p{P}\\p{Z}]+")).alias("word"))
    # equal words of a field are counted before their key is made
    counted = words.groupBy("id", "field", "word").agg(F.count("*").alias("n"))
    terms = counted.withColumn("term", term(F.col("word"))).where("term <> ''").groupBy("id", "field", "term").agg(F.sum("n").alias("tf"))
    length = Window.partitionBy("id", "field")
    return stage(terms.withColumn("length", F.sum("tf").over(length)), "postings")


def field_stats(index: DataFrame) -> DataFrame:
    """(field, docs, mean): documents with the field and its mean length."""
    return index.groupBy("id", "field").agg(F.max("length").alias("length")).groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))


def matches(index: DataFrame, terms: Sequence[str], prefix: bool = True, fuzzy: float = FUZZY) -> DataFrame:
    """(q, term, weight): vocabulary terms that a query term means: itself, what it begins, what few edits make it."""
    vocabulary = index.select("term").distinct()
    edits = F.round(F.length("q") * F.lit(fuzzy)).cast("int")
    near = F.levenshtein(F.col("term"), F.col("q"))
    weight = F.when(F.col("term") == F.col("q"), 1.0)
    if prefix:
        weight = weight.when(F.col("term").startswith(F.col("q")), F.lit(PREFIX_WEIGHT) * F.length("q") / F.length("term"))
    if fuzzy:
        weight = weight.when((edits > 0) & (F.abs(F.length("term") - F.length("q")) <= edits) & (near <= edits), F.lit(FUZZY_WEIGHT) * (1 - near / F.length("q")))
    # a query has a few terms: each vocabulary term is held against them in one pass
    return vocabulary.withColumn("q", F.explode(F.array(*[F.lit(t) for t in terms]))).withColumn("weight", weight).where("weight IS NOT NULL").select("q", "term", "weight")


def search(index: DataFrame, query: Sequence[str], boosts: dict[str, float] = BOOSTS, prefix: bool = True, fuzzy: float = FUZZY) -> DataFrame:
    """Q2: (id, score) of rows with any of the query's terms; query: identity keys. Scores are sums of BM25 times the
    field's boost and the match's weight."""
    found = index.join(matches(index, query, prefix, fuzzy), "term")
    df = index.groupBy("field", "term").agg(F.count("*").alias("df"))
    j = found.join(df, ["field", "term"]).join(F.broadcast(field_stats(index)), "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    boost = F.lit(1.0)
    for f, b in boosts.items():
        boost = F.when(F.col("field") == f, b).otherwise(boost)
    return j.groupBy("id").agg(F.sum(idf * tf * boost * F.col("weight")).alias("score"))


def top(hits: DataFrame, cap: int = 50) -> DataFrame:
    """O2: the best, ties by id; apply it after all filters."""
    return hits.orderBy(F.col("score").desc(), "id").limit(cap)
