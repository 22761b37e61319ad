"""A corpus pipeline of five operators; each stage takes and returns documents, the last returns packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, langid, packing, simhash, substring
from lodestone.llm.common import stage, table
from lodestone.llm.encoder import default_path

#: No stage but the first could be said in SQL, so the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is of no language (und) or more likely not of the predicted one; fills in missing lang values."""
    model = langid.train(docs, langid.remainder("doc_id", 4) != 2)
    out = langid.identify(docs, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= 0.5))
    return out.select(*[(F.coalesce("row.lang", "lang_pred") if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out what earlier documents already have; a document of which nothing is left goes."""
    out = substring.substring_dedup_text(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("kept_text").cast("long"))
    new = {"text": F.col("kept_text"), "n_chars": n_chars}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.pack(docs, default_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
