"""Benchmark decontamination with spaced-seed hashing, in DataFrame functions only.

A seed hashes the tokens at the 1-positions of a fixed mask and ignores the others, so a hit survives
substituted tokens. Hashes of the test items are joined to those of the training texts, and around a
hit the aligned tokens are compared: an overlap of a window's length is accepted if enough agree.

The item side first makes a bitmap of its hashes, of fixed size whatever the items' number. Positions of
a training text are unrolled within generated code and those that can't hit end there; only the others,
with the tokens around them, go on, so neither texts nor all their hashes are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import bitmap, cut, in_bitmap

#: Six masks of span 12 and weight 6. Any two of the 12 positions are ignored together by one of them, so 12 tokens
#: of which two are substituted always have a hit, and so have 99.96 % of the ways to substitute a fifth of 20.
MASKS = ("000011001111", "010001011011", "110010110100", "101100100011", "101101101000", "011110010100")
WINDOW = 20
AGREE = 0.8
#: Items of fewer tokens are no evidence of contamination and never match; those shorter than the masks match whole only.
LEAST = 5
#: Masks of one pass over the texts: generated code for more is too long to be compiled.
TOGETHER = 3
#: Seeds of items that are broadcast at most; more are joined by shuffling.
BROADCAST_SEEDS = 200_000


def tokens(text: str) -> F.Column:
    """64-bit hashes of the runs of letters and digits of the lower-cased text; null and empty give none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _hash(number: int | F.Column, array: str, at: F.Column, ones: list[int]) -> F.Column:
    """The seed hash of mask ``number`` at a position: mask and tokens at its 1s."""
    return F.xxhash64(F.lit(number), *[F.get(F.col(array), at + k) for k in ones])


def _seeds(items: DataFrame, masks: tuple[str, ...], window: int) -> tuple[DataFrame, list[tuple[int, list[int]]]]:
    """(h, item, item_id, n, ipos, region) of every seed of ``items``, and (span, ones) of the masks used.

    ``region`` are the item's tokens at ipos + span - window .. ipos + window - 1, null outside of it. Items
    shorter than the masks have one seed, the whole, whose region is null; each such length is a mask.
    """
    span = len(masks[0])
    lengths = sorted(r.n for r in items.select(F.size("it").alias("n")).where(F.col("n") < span).distinct().collect())
    used = [(len(m), [k for k, c in enumerate(m) if c == "1"]) for m in (*masks, *("1" * n for n in lengths))]
    table = None
    for number, (width, ones) in enumerate(used):
        own = items.where(F.size("it") >= span) if number < len(masks) else items.where(F.size("it") == width)
        rows = own.select("item", "item_id", F.size("it").alias("n"), "it", F.explode(F.sequence(F.lit(0), F.size("it") - width)).alias("ipos"))
        region = F.transform(F.sequence(F.lit(span - window), F.lit(window - 1)), lambda i: F.when(F.col("ipos") + i >= 0, F.get("it", F.greatest(F.col("ipos") + i, F.lit(0)))))
        part = rows.select(_hash(number, "it", F.col("ipos"), ones).alias("h"), "item", "item_id", "n", "ipos", region.alias("region") if number < len(masks) else F.lit(None).cast("array<bigint>").alias("region"))
        table = part if table is None else table.union(part)
    return table, used


def find(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, agree: float = AGREE, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*key, item_id, overlap) of the items (item_id, text) that overlap a text of ``docs`` (*key, text).

    ``overlap`` is the largest share of agreeing tokens, at least ``agree``, over windows of ``window``
    aligned tokens (the whole item if it has fewer) that hold a seed. Items shorter than the masks are
    sought whole, without substitutions. Rows are one per key and item: rows that repeat a key are
    judged together. Items with null ids or repeated ones are kept apart by their text. All masks have one
    span, and ``2 * window - span`` is under 64: agreeing tokens around a seed are the bits of one long.
    """
    span = len(masks[0])
    if {len(m) for m in masks} != {span} or not span <= window or 2 * window - span > 63:
        raise ValueError("masks of one span <= window, and 2 * window - span < 64")
    items = benchmark.select("item_id", tokens("text").alias("it")).where(F.size("it") >= LEAST).withColumn("item", F.xxhash64("item_id", "it"))
    table, used = _seeds(cut(items.dropDuplicates(["item"]), "benchmark-items"), masks, window)
    table = cut(table, "benchmark-seeds")
    n_seeds = table.count()
    bits = bitmap(table, "h")

    # a row per token, within generated code; th is only pointed at, and few rows pass the bitmap
    # (an outer one, as others compute the array again to leave out empty ones)
    at = docs.select(*key, tokens("text").alias("th")).select(*key, "th", F.posexplode_outer("th").alias("pos", "__token"))

    def seed(number: int) -> F.Column:
        width, ones = used[number]
        h = _hash(number, "th", F.col("pos"), ones)
        return F.when((F.col("pos") + width <= F.size("th")) & in_bitmap(h, bits), h)

    near = F.slice("th", F.greatest(F.col("pos") + span - window, F.lit(0)) + 1, F.lit(2 * window))

    def hits_of(numbers: range) -> DataFrame:
        # the seeds are told one by one, so that each is computed once for a position
        told = at.select(*key, "th", "pos", *[seed(k).alias(f"h{k}") for k in numbers]).where(" or ".join(f"h{k} is not null" for k in numbers))
        return told.select(*key, "pos", F.greatest(F.col("pos") + span - window, F.lit(0)).alias("from"), near.alias("near"), F.explode(F.array_compact(F.array(*[F.col(f"h{k}") for k in numbers]))).alias("h"))

    hits = reduce(DataFrame.union, [hits_of(range(k, min(k + TOGETHER, len(used)))) for k in range(0, len(used), TOGETHER)])
    met = hits.join(F.broadcast(table) if n_seeds <= BROADCAST_SEEDS else table, "h")

    # the tokens aligned with region, then their agreement as the bits of a long, looked at through every window;
    # a window that leaves the item has no more agreeing tokens than the one moved inside
    offset = F.col("pos") + (span - window) - F.col("from")
    aligned = F.transform(F.sequence(F.lit(0), F.lit(2 * window - span - 1)), lambda i: F.when(i + offset >= 0, F.get("near", F.greatest(i + offset, F.lit(0)))))
    same = F.zip_with("region", aligned, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("long"))
    views = range(window - span + 1)
    most = F.aggregate(same, F.lit(0).cast("long"), lambda m, x: m * 2 + x, lambda m: F.greatest(*[F.bit_count(F.shiftrightunsigned(m, w).bitwiseAND((1 << window) - 1)) for w in views], F.lit(0)))
    overlap = F.when(F.col("region").isNull(), 1.0).otherwise(most / F.least(F.col("n"), F.lit(window)))
    best = met.groupBy(*key, "item_id", "item").agg(F.max(overlap).alias("overlap"))
    return best.where(F.col("overlap") >= agree).drop("item")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), overlap (largest; 0 if none) for each row of ``docs`` (doc_id, text).

    Null and empty texts, and any text if the benchmark is empty, are clean. Rows that repeat a doc_id are
    judged each by its own text. Other columns are ignored.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h_text"))
    found = find(keyed, benchmark, key=("doc_id", "h_text"), **options)
    by = found.groupBy(F.col("doc_id").alias("d"), F.col("h_text").alias("t")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("overlap").alias("overlap"))
    rows = keyed.select("doc_id", "h_text")
    joined = rows.join(by, rows["doc_id"].eqNullSafe(by["d"]) & (rows["h_text"] == by["t"]), "left")
    return joined.select("doc_id", F.col("t").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text overlaps an item; same columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")  # out of the way of names in use here
    keyed = docs.select(row, "doc_id", F.xxhash64("text").alias("__h"))
    found = find(docs.select("doc_id", "text", F.xxhash64("text").alias("h_text")), benchmark, key=("doc_id", "h_text"), **options).select(F.col("doc_id").alias("__d"), F.col("h_text").alias("__t")).distinct()
    return keyed.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__t")), "left_anti").select("__row.*")
