"""Corpus pipeline: language ID, near-dedup, decontamination, PII, packing.

Each stage gets what the one before kept, as written and read again, and works on all of it. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm import langid, packing, pii, simhash, spaced_seeds
from driftframe.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without a letter (null and empty ones too) and those that the decoder flags.

    A flagged text has two codewords about equally near, as half-and-half mixtures have. If no language could be
    learned, all documents with letters stay.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.languages:
        return docs.where(langid.lettered(docs.sparkSession))
    found = langid.predict(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous")).select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 or more of five-word shingles) stays: the smallest doc_id, null last.

    Null and empty texts are one group.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and empty texts stay, and so does all if the benchmark is empty."""
    return spaced_seeds.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows. Null texts stay null, with a null n_chars."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens at most; a null text is an empty one, a piece of one token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("private_data", private_data), ("best_fit_packing", best_fit_packing)]
#: Classifiers, fingerprints, tokenizers: tested against brute-force versions in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
