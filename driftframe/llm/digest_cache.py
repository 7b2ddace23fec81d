"""Token counts through a digest cache.

A text's count is stored under (digest of its normalised content, digest of the tokenizer version).
Byte-level BPE counts depend on every byte, so the normalised content is the UTF-8 text itself with
null as empty. Only distinct texts whose key is not stored are encoded; their counts are appended.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm import tokens
from driftframe.llm.common import cut, small_batches

CACHE_SCHEMA = "digest binary, n_tokens long, version string"
#: Digests that are broadcast at most, to leave out texts before they are moved.
BROADCAST_ROWS = 100_000


def cached(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache table, a folder per version; an absent one is empty."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def fill_cache(texts: DataFrame, cache_path: str, tokenizer_path: str, kind: str) -> None:
    """Encodes the distinct texts (column ``text``) that the cache lacks and appends their counts.

    With a cache that knows some, digests alone are compared first; only texts of misses are moved then,
    if there are BROADCAST_ROWS of them at most, and none if there are no misses.
    """
    spark, version = texts.sparkSession, tokens.version(tokenizer_path)
    small_batches(spark)
    known = cached(spark, cache_path).where(F.col("version") == version).select("digest")
    keyed, warm = texts.select(_digest("text"), F.coalesce("text", F.lit("")).alias("text")), bool(known.take(1))
    if warm:
        missing = cut(keyed.select("digest").distinct().join(known, "digest", "left_anti"), "missing-digests")
        n = missing.count()
        if not n:
            return
        keyed = keyed.join(F.broadcast(missing), "digest", "left_semi") if n <= BROADCAST_ROWS else keyed
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(missing, "digest", "left_semi") if warm and n > BROADCAST_ROWS else distinct

    @F.arrow_udf("long")
    def count(batch: pa.Array) -> pa.Array:
        return pa.array([len(ids) // 4 for ids in tokens.encoder(tokenizer_path, kind).encode(batch.to_pylist())], pa.int64())

    counted = misses.select("digest", count("text").alias("n_tokens"), F.lit(version).alias("version"))
    counted.write.mode("append").partitionBy("version").parquet(cache_path)


def count_tokens(df: DataFrame, cache_path: str, tokenizer_path: str, kind: str = "byte") -> DataFrame:
    """``df`` with ``n_tokens`` of its column ``text``; null counts as the empty text (0 tokens).

    Repeated texts are encoded once, rows keep their multiplicity; an ``n_tokens`` that ``df`` has is
    replaced, other columns stay. Two writers that append the same key at once do no harm: a key's
    count is always the same and reads take one of them.
    """
    fill_cache(df, cache_path, tokenizer_path, kind)
    spark, version = df.sparkSession, tokens.version(tokenizer_path)
    stored = cached(spark, cache_path).where(F.col("version") == version).groupBy(F.col("digest").alias("__digest")).agg(F.max("n_tokens").alias("n_tokens"))
    keyed = df.drop("n_tokens").withColumn("__digest", _digest("text"))
    return keyed.join(stored, "__digest", "left").drop("__digest")


def _digest(column: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")), 256)).alias("digest")
