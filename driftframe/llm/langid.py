"""Language ID with error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier over hashed character n-grams
(smoothed log-odds of the two sides' n-gram frequencies) predicts the bit of a text. Decoding is
loss-weighted: a language's loss is the sum over bits of exp(-code * margin), weighted by how reliably
that bit came out for that language's training texts; the nearest codeword is predicted, and a text
whose two nearest are about equally far is flagged.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm.common import small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Labelled texts learned from, for each language, about (chosen by a hash of their key).
TRAIN_ROWS = 2000
UNDETERMINED = "und"
#: Difference of the two least losses, relative to the number of bits, under which a text is ambiguous.
AMBIGUOUS = 0.05
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))
_PART = 1 << 20
_letters = None
_LETTER = re.compile(r"[^\W\d_]")


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x10000)])
    return _letters


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for m in _LETTER.finditer(text) for c in m[0])


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text, lower-cased, runs of non-letters as one space."""
    out = np.zeros(BUCKETS)
    for at in range(0, len(text), _PART):  # by parts, that overlap by the longest order less one
        part = np.frombuffer((text[max(0, at - max(ORDERS) + 1) : at + _PART]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        part = np.where(_is_letter()[np.minimum(part, 0xFFFF)] | (part > 0xFFFF), part, np.uint32(32))
        part = part[np.concatenate(([True], (part[1:] != 32) | (part[:-1] != 32)))] if len(part) else part
        rolled = np.zeros(len(part), np.uint32)
        for n in ORDERS:
            if len(part) < n:
                break
            rolled = (rolled[: len(part) - n + 1] ^ part[n - 1 :]) * _MIX[n - 1] if n > 1 else part * _MIX[0]
            out += np.bincount((rolled ^ (rolled >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def codewords(languages: int, seed: int = 0) -> np.ndarray:
    """(languages, bits) of -1 and +1: all splits for up to 7 languages, else the best of some random dense codes."""
    if languages <= 7:
        splits = [[1] + [1 if b >> k & 1 else -1 for k in range(languages - 1)] for b in range(2 ** (languages - 1) - 1)]
        return np.array(splits, np.int8).reshape(-1, max(languages, 1)).T
    rng, bits, best = np.random.default_rng(seed), math.ceil(10 * math.log2(languages)), None
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        m = m[:, (np.abs(m.sum(axis=1 - 1)) < languages)]
        near = (m.shape[1] - (m.astype(int) @ m.T)) // 2 + 10_000 * np.eye(languages, dtype=int)
        if best is None or near.min() > best[0]:
            best = (near.min(), m)
    return best[1]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (BUCKETS, bits) log-odds
    scale: float
    trust: np.ndarray  # (languages, bits), rows sum to the number of bits

    def margins(self, text: str) -> np.ndarray:
        counts = ngram_counts(text)
        return counts @ self.weights / max(counts.sum(), 1)

    def predict(self, text: str | None) -> tuple[str, float, str | None, bool]:
        """(language, score 0..1, runner-up, ambiguous)."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, None, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, None, False
        loss = (self.trust * np.exp(np.clip(-self.code * self.margins(text) * self.scale, -30, 30))).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        closeness = np.exp(-(loss - loss[order[0]]))
        return self.languages[order[0]], float(1 / closeness.sum()), self.languages[order[1]], bool(loss[order[1]] - loss[order[0]] < AMBIGUOUS * self.code.shape[1])


def fit(docs: DataFrame, rows_per_language: int = TRAIN_ROWS, key: str = "doc_id") -> Model:
    """Learns from the rows of ``docs`` (key, text, lang) that have text and lang.

    About ``rows_per_language`` rows of each language, by a hash of the key, whole texts. The driver
    gets one row per language and, for the classifiers, at most languages x BUCKETS sums.
    """
    small_batches(docs.sparkSession)
    labelled = docs.select(key, F.col("text"), F.col("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((0, 0)), np.zeros((BUCKETS, 0)), 1.0, np.zeros((0, 0)))
    share = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, rows_per_language / n)) for k, n in sizes.items()])
    chosen = labelled.where(F.pmod(F.xxhash64(F.col(key), F.lit("train")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text").persist()
    sums = chosen.mapInArrow(_sum_ngrams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    index = {k: i for i, k in enumerate(languages)}
    freq = np.zeros((len(languages), BUCKETS))
    freq[[index[k] for k in sums["lang"]], sums["bucket"]] = sums["n"]
    freq /= np.maximum(freq.sum(axis=1, keepdims=True), 1)  # each language weighs the same
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, other = (freq[code[:, b] == s].mean(axis=0) for s in (1, -1))
        weights[:, b] = np.log((one + 1e-6) / (other + 1e-6))
    plain = Model(languages, code, weights, 1.0, np.ones(code.shape))
    if len(languages) == 1:
        chosen.unpersist()
        return plain
    seen = chosen.mapInArrow(_judge(plain), "lang string, n long, hits array<double>, size double").groupBy("lang").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("hits")[b]) for b in range(code.shape[1])]).alias("hits"), F.sum("size").alias("size")).collect()
    chosen.unpersist()
    trust, total = np.ones(code.shape), max(1, sum(r.n for r in seen))
    for r in seen:
        rate = (np.array(r.hits) + 1) / (r.n + 2)
        trust[index[r.lang]] = rate / rate.mean()
    return Model(languages, code, weights, 2.0 * total / max(sum(r["size"] for r in seen), 1e-9), trust)


def _sum_ngrams(batches):
    """Each text weighs 10**6 however long; sums are whole numbers, so their order doesn't matter."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            counts = ngram_counts(text)
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total[lang] += np.rint(counts * (1e6 / max(counts.sum(), 1))).astype(np.int64)
    for lang, sums in total.items():
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at])], ["lang", "bucket", "n"])


def _judge(model: Model):
    def judge(batches):
        index = {k: i for i, k in enumerate(model.languages)}
        for batch in batches:
            rows = [(lang, model.margins(text)) for lang, text in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(text)]
            hits = [(np.sign(m) == model.code[index[lang]]).astype(float).tolist() for lang, m in rows]
            sizes = [float(np.abs(m).mean()) for _, m in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([1] * len(rows), pa.int64()), pa.array(hits, pa.list_(pa.float64())), pa.array(sizes, pa.float64())], ["lang", "n", "hits", "size"])

    return judge


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, runner_up and ambiguous, from column ``text`` alone.

    Null texts and those without a letter are ``und`` with score 0 (as is every text if nothing was
    learned). Columns of these names are replaced, all others stay.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<lang_pred:string,score:double,runner_up:string,ambiguous:boolean>")
    def judged(texts: pa.Array) -> pa.Array:
        rows = [model.predict(t) for t in texts.to_pylist()]
        kinds = {"lang_pred": pa.string(), "score": pa.float64(), "runner_up": pa.string(), "ambiguous": pa.bool_()}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    names = ["lang_pred", "score", "runner_up", "ambiguous"]
    return docs.drop(*names).withColumn("__judged", judged("text")).select("*", *[F.col(f"__judged.{n}").alias(n) for n in names]).drop("__judged")


def lettered(spark: SparkSession, column: str = "text") -> F.Column:
    """True for texts that have a letter."""
    small_batches(spark)

    @F.arrow_udf("boolean")
    def told(texts: pa.Array) -> pa.Array:
        return pa.array([has_letter(t) for t in texts.to_pylist()], pa.bool_())

    return told(column)


def held_out(key: str = "doc_id") -> F.Column:
    """True for the rows that are never learned from: crc32 of the key as text, mod 4, is 2; null keys too."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(True))
