"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import freed, shared_dir, table
from lodestone.llm.encoder import default_path, encoder, pieces

CACHE = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Names what the counts depend on: the vocabulary file's bytes and the library's version."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        body = hashlib.sha256(f.read()).hexdigest()
    return f"{body}/{tokenizers.__version__ if path.endswith('.json') else sentencepiece.__version__}"


def _cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    try:
        known = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # two writers may have appended the same digest
    return known.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counts(path: str, tokenizer: str):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            n = [x for part in pieces(b) for x in enc.counts(part.column(1).to_pylist())]
            yield pa.record_batch([pa.array([tokenizer] * len(n), pa.string()), b.column(0), pa.array(np.array(n, dtype=np.int64))], names=["tokenizer", "digest", "n_tokens"])

    return freed(run)


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of docs; cache is a folder of Parquet that all executors reach.

    The normalised content is the text with null as empty; nothing else may change, since every byte counts. Its
    SHA-256 is looked up for this tokenizer version, one text of each digest that is not stored yet is encoded (copies
    meet map-side first), and the new counts are appended. Then every row takes its count from the cache.

    Null and empty texts have no tokens. Null ids and repeated rows stay as they are. An empty table appends nothing
    and gives no row. Other columns aren't read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = _cached(spark, cache, tokenizer)
    new = rows.select("digest", "text")
    if known is not None:
        new = new.join(known, "digest", "left_anti")
    new = new.groupBy("digest").agg(F.first("text").alias("text"))
    new.mapInArrow(_counts(path, tokenizer), CACHE).write.mode("append").parquet(cache)
    known = _cached(spark, cache, tokenizer)
    return rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(known, "digest").select("id", "n_bytes", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache each time, so that it counts every text it is given."""
    cache = f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    out = token_counts(table(spark, sf_dir, "documents"), default_path(), cache)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
