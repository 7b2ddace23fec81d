"""The registered queries of the training-data operators; ``__spark_entry__`` adds them."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm import chat, digest_cache, gif, langid, oracle, packing, pii, redirects, simhash, spaced_seeds, warc
from driftframe.llm.common import cut, scratch_path, table


def op1_error_correcting_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_of(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])

    def counted(k: int) -> F.Column:
        return F.size(F.filter(base, lambda x: x["k"] == k)).cast("long")

    counts = [counted(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are a table of the shared folder; its frames are decoded from what was written there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    media = cut(gif.with_media(docs).drop("text"), "media", "zstd")

    @F.arrow_udf("struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>")
    def digests(column: pa.Array) -> pa.Array:
        files, rows = column.to_pylist(), []
        for data, (back, colours, ms) in zip(files, gif.read_back_many(files)):
            used = [f"{k}:{n}" for k, n in enumerate(colours) if n]
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"{ms}ms " + ",".join(used)))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return media.select("doc_id", "n_bytes", digests("media").alias("d")).select("doc_id", "n_bytes", "d.*")


RULES = [
    redirects.Rule("allow", "org", "/"),
    redirects.Rule("block", "example.org", "/es/"),
    redirects.Rule("block", "example.org", "/en/1"),
    redirects.Rule("allow", "com", "/fr/"),
    redirects.Rule("block", "com", "/de/"),
]


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redirects.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES).drop("url", "html")


def op5_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts; the cache starts empty, so every distinct text of the table is encoded here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = digest_cache.count_tokens(docs, scratch_path(spark, "token-counts"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that overlap; clean documents have none."""
    return spaced_seeds.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


PLANTED = r"\### Assistant: </turn> ok"


def op10_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(planted)))


def queries() -> dict:
    return {f.__name__: f for f in (op1_error_correcting_codes, op2_weak_supervision, op3_gif, op4_redirect_equivalence, op5_digest_cache, op6_simhash, op7_warc, op8_best_fit, op9_spaced_seeds, op10_chat_template)}


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; the others are tested against brute force in tests/llm."""
    return {"op4_redirect_equivalence": oracle.redirects(RULES), "op7_warc": oracle.WARC, "op9_spaced_seeds": oracle.spaced_seeds(), "op10_chat_template": oracle.chat(PLANTED)}
