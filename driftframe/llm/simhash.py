"""SimHash near-duplicates by multi-index hashing.

``near_duplicates`` links fingerprints of 64 bits at two or fewer bits, and loses none. The fingerprint is
split into segments, with a table of its values for each. Of two fingerprints within two bits, one segment
differs in ``2 // segments`` bits at most: one's small Hamming ball in that segment holds the other's value,
and the complete distances of the table's matches are verified. Entries with many fingerprints aren't paired:
those that look into them meet in the whole fingerprint's radius-1 balls, whose entries hold 65 at most, all
within two bits of each other, so a star of links from the smallest connects them.

``similar`` is for texts that share four fifths of their five-word shingles. Fingerprints of 64 bits can't tell
those (they differ in ten bits and more), so the tables only give the first candidates. The others: of two such
sets of shingles, each in one order that holds for all, the first fifths share a shingle, so those who share
one, at places that leave enough to share, are candidates. Candidates whose fingerprints of BITS bits are too
far apart go, and the exact similarity of the sets decides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftframe.llm.common import bitmap, cut, in_bitmap, passing, release, small_batches
from driftframe.llm.components import connected_components

SEED = 42
SEGMENTS = 3
#: Fingerprints of a table entry that are paired; those of larger entries meet in whole-fingerprint balls.
PAIRED = 64
#: Texts, about, from which common shingles are learned, and those of them that are put last in the order. They bear on the effort only.
SAMPLE, COMMON = 40_000, 500_000
#: Bits that sort out candidates, and how many may differ. At a similarity of 0.8, one in 10**7 pairs differs in more.
BITS, APART = 256, 70
#: Bits of the parities that sort out more of them, and how many of these go into the join of all members of an entry.
ODD, ODD_JOINED = 1024, 256
#: Sizes of entries from which they have one, two, three and four members that all others meet at first.
CENTRES = (2, 32, 128, 256)
#: Then some of them meet more, so many times.
CENTRES_AGAIN, AGAIN = (2, 16, 32, 64, 128, 256, 256, 256), 4
_PART = 1 << 14
#: Table keys of a task.
PART_KEYS = 900_000
#: Shares of the keys that are dealt one after the other, so that the shuffle files of one share at a time are on disk.
SHARES = 4


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, of the whole sequence if it is shorter; none without a word."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    if len(starts) < words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """(words,) 64-bit words of the bits set in over half of ``hashes`` (n, words)."""
    set_bits = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), _PART):  # very long texts by parts
        part = np.ascontiguousarray(hashes[at : at + _PART]).view(np.uint8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of ``text``, repeats included; null or no word gives 0."""
    hashes = shingle_hashes(text, words)
    return int(_majority(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def _odd(hashes: np.ndarray) -> list[int]:
    """ODD bits: whether an odd number of ``hashes`` falls on each. Two sets' differ in no more bits than the sets differ in members."""
    counts = np.bincount((hashes % np.uint64(ODD)).astype(np.int64), minlength=ODD)
    return np.packbits(counts % 2 == 1, bitorder="little").view("<i8").tolist()


def _described(text: str | None, words: int, common: np.ndarray, place: np.ndarray) -> tuple[int, int, list[int], list[int], list[int]]:
    """(hash of the set of shingles, its size, its SimHash of BITS bits, its ODD parities, its first fifth and one more); zeros and none without a word.

    In order are those that aren't in ``common`` (sorted), by hash, then those that are, by ``place``.
    """
    hashes = np.unique(shingle_hashes(text, words))
    if not len(hashes):
        return 0, 0, [0] * (BITS // 64), [0] * (ODD // 64), []
    late = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = np.where(common[at] == hashes, place[at], 0)
    first = hashes[np.lexsort((hashes, late))[: len(hashes) // 5 + 1]]
    mixed = hashes[:, None] * _MIX
    return _signed(xxh64_intdigest(hashes.tobytes(), SEED)), len(hashes), _majority(mixed ^ (mixed >> np.uint64(32))).tolist(), _odd(hashes), first.view(np.int64).tolist()


#: Odd numbers that make further hashes of one.
_MIX = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)[: BITS // 64]


def with_fingerprint(docs: DataFrame, words: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the SimHash of column ``text`` as a signed long; a column of that name is replaced."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, words) for t in texts.to_pylist()], pa.int64())

    return docs.withColumn(name, hashed("text"))


def links(fingerprints: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Links (a, b), a < b, that connect the distinct longs ``fp`` lying within two bits of each other.

    Every pair within two bits is connected by them, and every link is within two bits. More ``segments`` (2 to
    8) make smaller balls and larger entries. Empty in, empty out.
    """
    if not 2 <= segments <= 8:
        raise ValueError("2 to 8 segments")
    edges = [64 * s // segments for s in range(segments + 1)]
    spans = list(zip(edges, edges[1:]))

    def key(s: int, fp: F.Column) -> F.Column:
        low, high = spans[s]
        return F.shiftrightunsigned(fp, low).bitwiseAND((1 << high - low) - 1) + F.lit(s << 33)

    def keyed(masks: list[list[int]]) -> DataFrame:
        each = F.array(*[key(s, F.col("fp").bitwiseXOR(F.lit(_signed(m)))) for s in range(segments) for m in masks[s]])
        return fingerprints.select("fp", F.explode(each).alias("key"))

    tables = keyed([[0]] * segments)
    sizes = tables.groupBy("key").agg(F.count("*").alias("n"))
    if 2 // segments:  # balls of radius 1 look into the tables
        looks = keyed([[0, *(1 << i for i in range(*span))] for span in spans])
        known = sizes.where(F.col("n") <= PAIRED).select("key")
    else:
        looks = tables
        known = sizes.where(F.col("n").between(2, PAIRED)).select("key")
    x, y = looks.select(F.col("fp").alias("x"), "key"), tables.join(known, "key", "left_semi").select(F.col("fp").alias("y"), "key")
    near = (F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2)
    pairs = x.join(y.hint("shuffle_hash"), "key").where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    crowded = looks.join(sizes.where(F.col("n") > PAIRED).select("key"), "key", "left_semi").select("fp").distinct()
    balls = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(m))) for m in (0, *(1 << i for i in range(64)))])
    met = crowded.select("fp", F.explode(balls).alias("key")).groupBy("key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    stars = met.select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.union(stars).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(docs: DataFrame, words: int = 3, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over fingerprints at two or fewer bits.

    Null and empty texts share fingerprint zero and are linked like any other. Copies meet in one
    fingerprint, which is pre-aggregated, so groups of any size cost one row here. Null doc_ids keep
    their row and never are the smallest. Other columns of ``docs`` are ignored.
    """
    hashed = cut(with_fingerprint(docs.select("doc_id", "text"), words).select("doc_id", "fp"), "fingerprints")
    firsts = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    labels = connected_components(links(firsts, segments))
    joined = firsts.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    lowest = joined.where("component is not null").groupBy("component").agg(F.min("low").alias("component_low"))
    classes = joined.join(lowest, "component", "left").select("fp", F.coalesce("component_low", "low").alias("component_id"))
    return hashed.join(classes, "fp").select("doc_id", "fp", "component_id")


def _leave_enough(x: str, y: str) -> F.Column:
    """Two sets that share a key at these places, and none before, can share four fifths."""
    return F.expr(f"9 * least({x}_n - {x}_pos, {y}_n - {y}_pos) >= 4 * ({x}_n + {y}_n)")


def _sides(entries: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(entries.select("key", *[F.col(c).alias(f"{n}_{c}") for c in columns]) for n in "xy")


def _entries(sets: DataFrame) -> DataFrame:
    """(key, node, n, pos) of the keys that several of ``sets`` (node, n, keys) have; SHARES tables."""
    spark = sets.sparkSession
    release(spark)
    parts = 1 + int(sets.agg(F.sum(F.size("keys"))).first()[0] or 0) // (SHARES * PART_KEYS)  # so many as keep a task's keys in memory
    tables = []
    for share in range(SHARES):
        members = sets.select("node", "n", F.posexplode("keys").alias("pos", "key")).where(F.pmod("key", F.lit(SHARES)) == share).repartition(parts, "key")
        several = members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key")
        tables.append(cut(members.join(several.hint("shuffle_hash"), "key"), "similar-entries"))
        del members, several
        release(spark)
    return reduce(DataFrame.union, tables)


def _stars(entries: DataFrame) -> DataFrame:
    """Distinct pairs (b, a), a < b, of nodes that share a key, of ``entries`` (key, node, n, pos).

    Each key's members meet one of them, another for each key; of larger entries two, three or four.
    """
    found = entries.groupBy("key").agg(F.count("*").alias("size"), *[F.min_by(F.struct("node", "n", "pos"), F.xxhash64("key", "node", F.lit(k))).alias(f"c{k}") for k in range(len(CENTRES))])
    chosen = F.array_compact(F.array(*[F.when(F.col("size") >= least, F.col(f"c{k}")) for k, least in enumerate(CENTRES)]))
    centres = found.select("key", F.explode(F.array_distinct(chosen)).alias("c")).select("key", *[F.col(f"c.{n}").alias(f"y_{n}") for n in ("node", "n", "pos")])
    pairs = _sides(entries, ["node", "n", "pos"])[0].join(centres, "key").where(F.col("x_node") != F.col("y_node")).where(_leave_enough("x", "y"))
    return pairs.select(F.greatest("x_node", "y_node").alias("b"), F.least("x_node", "y_node").alias("a")).distinct()


def _stars_again(entries: DataFrame, nth: int) -> DataFrame:
    """Distinct pairs (b, a), a < b, of ``entries`` (as those of ``_met``, with column linked): a key's members meet some that have links, others each time.

    So a text that is apart from a large group comes to one of it that it is near to, before it has to meet all.
    """
    weight = lambda k: F.col("linked").cast("long") * (1 + F.pmod(F.xxhash64("key", "node", F.lit(100 * nth + k)), F.lit(1 << 30)))
    chosen = F.struct("node", "n", "pos", "component", "bits")
    found = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("first"), F.max("component").alias("last"), *[F.max_by(chosen, F.struct(weight(k).alias("w"), F.xxhash64("key", "node").alias("h"))).alias(f"c{k}") for k in range(len(CENTRES_AGAIN))])
    several = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("size") >= least, F.col(f"c{k}")) for k, least in enumerate(CENTRES_AGAIN)])))
    centres = found.where("first < last").select("key", F.explode(several).alias("c")).select("key", *[F.col(f"c.{n}").alias(f"y_{n}") for n in ("node", "n", "pos", "component", "bits")])
    pairs = _sides(entries, ["node", "n", "pos", "component", "bits"])[0].join(centres, "key").where("x_component <> y_component").where(_leave_enough("x", "y")).where(_near_bits("x", "y"))
    return pairs.select(F.greatest("x_node", "y_node").alias("b"), F.least("x_node", "y_node").alias("a")).distinct()


def _near_bits(x: str, y: str) -> F.Column:
    return sum((F.bit_count(F.col(f"{x}_bits")[k].bitwiseXOR(F.col(f"{y}_bits")[k])) for k in range(BITS // 64)), F.lit(0)) <= APART


def _near_odd(x: str, y: str, bits: int) -> F.Column:
    """Whether parities leave a pair within reach of 0.8: sets that share four fifths differ in a ninth of their sizes' sum at most. This loses none."""
    return 9 * sum((F.bit_count(F.col(f"{x}_odd")[k].bitwiseXOR(F.col(f"{y}_odd")[k])) for k in range(bits // 64)), F.lit(0)) <= F.col(f"{x}_n") + F.col(f"{y}_n")


def _met(entries: DataFrame) -> DataFrame:
    """Distinct pairs (b, a), a < b, of nodes of different components that share a key, of ``entries`` (key, node, n, pos, component, bits, odd if known).

    All pairs that can share four fifths, but for those within a component and those whose bits are too far apart.
    """
    sizes = entries.groupBy("key", "component").agg(F.count("*").alias("members"))
    main = sizes.groupBy("key").agg(F.max_by("component", "members").alias("main"), F.count("*").alias("n")).where("n > 1").select("key", "main")
    rest, all_ = _sides(entries.join(main, "key"), [*[c for c in entries.columns if c != "key"], "main"])
    rest = rest.where("x_component <> x_main")
    pairs = rest.join(all_, "key").where("x_component <> y_component").where(_leave_enough("x", "y")).where(_near_bits("x", "y"))
    if "odd" in entries.columns:
        pairs = pairs.where(_near_odd("x", "y", ODD_JOINED))
    return pairs.select(F.greatest("x_node", "y_node").alias("b"), F.least("x_node", "y_node").alias("a")).distinct()


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints of BITS bits (``sets``: node, n, bits, odd) differ in APART at most, and whose parities let them share four fifths."""
    for n in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("n", "bits", "odd")]), n)
    return pairs.where(_near_bits("a", "b")).where(_near_odd("a", "b", ODD)).select("b", "a")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a similarity of 0.8 or more.

    ``rows`` has the texts' hashes and nodes. Sets are made again, for the texts of the pairs only: a bitmap of
    fixed size tells them, and lets some others pass once they are many.
    """
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "similar-wanted")
    sought = in_bitmap(F.xxhash64("text"), bitmap(rows.join(wanted, "node", "left_semi"), "h_text"))

    @F.arrow_udf("struct<node:long,items:array<long>>")
    def shingled(column: pa.Array) -> pa.Array:
        sets = [np.unique(shingle_hashes(t, words)) for t in column.to_pylist()]
        nodes = [_signed(xxh64_intdigest(x.tobytes(), SEED)) if len(x) else 0 for x in sets]
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "items"])

    made = cut(docs.where(sought).select(shingled("text").alias("s")).select("s.*"), "similar-sets")
    sets = made.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items"))
    sides = [sets.select(F.col("node").alias(n), F.col("items").alias(f"{n}_items")) for n in "ab"]
    shared = F.size(F.array_intersect("a_items", "b_items"))
    return pairs.join(sides[0], "a").join(sides[1], "b").where(9 * shared >= 4 * (F.size("a_items") + F.size("b_items"))).select("a", "b")


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of about SAMPLE texts hold, sorted, and their places by frequency."""
    every = max(1, docs.count() // SAMPLE)

    def shingled(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, words)).view(np.int64))], ["h"])

    sample = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(every)) == 0)
    counts = sample.mapInArrow(shingled, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3")
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes = found["h"].to_numpy().view(np.uint64)
    at = np.argsort(hashes)
    return hashes[at], len(hashes) - at


def similar(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, h_text, group) per row of ``docs`` (doc_id, text): rows of one group are near-duplicates.

    ``group`` is the hash of a set of shingles, the smallest of those linked at a similarity of 0.8 or more;
    ``h_text`` is XXH64 of the text. Copies meet in one set. Null and empty texts are one group. The segment
    tables' links, and stars within the sets' entries, link most of a large group first, so that few pairs of
    it are left to look at.
    """
    small_batches(docs.sparkSession)
    common, place = _common(docs, words)
    release(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((common, place))

    @F.arrow_udf("struct<node:long,n:int,bits:array<long>,odd:array<long>,keys:array<long>>")
    def described(texts: pa.Array) -> pa.Array:
        found = list(zip(*[_described(t, words, *shared.value) for t in texts.to_pylist()])) or [()] * 5
        kinds = {"node": pa.int64(), "n": pa.int32(), "bits": pa.list_(pa.int64()), "odd": pa.list_(pa.int64()), "keys": pa.list_(pa.int64())}
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(found, kinds.values())], list(kinds))

    with passing(docs.sparkSession, 2 + SHARES):
        with passing(docs.sparkSession, 3):
            found = cut(docs.select("doc_id", F.xxhash64("text").alias("h_text"), described("text").alias("s")).select("doc_id", "h_text", "s.*"), "shingled")
            distinct = cut(found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "bits", "odd", "keys")]), "similar-distinct")
            rows = cut(found.select("doc_id", "h_text", "node"), "similar-rows")
            sets = cut(distinct.select("node", "n", "bits", "odd"), "similar-fingerprints")
        entries = _entries(distinct)
    fps = sets.select("node", F.col("bits")[0].alias("fp"))
    near = links(fps.select("fp").distinct())
    lows = fps.groupBy("fp").agg(F.min("node").alias("low"))  # of sets with one fingerprint, the smallest stands for them here
    near = near.join(lows.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(lows.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    near = near.select(F.greatest("x", "y").alias("b"), F.least("x", "y").alias("a"))
    first = cut(_close(_stars(entries).union(near).distinct(), sets), "similar-first")
    with passing(docs.sparkSession):
        linked = cut(_verified(first, rows, docs, words), "similar-links")
    release(docs.sparkSession)

    folded = F.array(*[reduce(F.Column.bitwiseXOR, [F.col("odd")[j] for j in range(k, ODD // 64, ODD_JOINED // 64)]) for k in range(ODD_JOINED // 64)])

    def grouped(labels: DataFrame, odd: list[F.Column]) -> DataFrame:
        known = sets.select("node", "bits", *odd).join(labels, "node", "left").withColumns({"linked": F.col("component").isNotNull(), "component": F.coalesce("component", "node")})
        return cut(entries.join(known, "node"), "similar-grouped")

    for nth in range(AGAIN):
        with passing(docs.sparkSession):
            labels = connected_components(linked, "similar")
            again = cut(_close(_stars_again(grouped(labels, []), nth), sets), "similar-again")
            inside = labels.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            linked = cut(inside.union(_verified(again, rows, docs, words)), "similar-links")
        release(docs.sparkSession)
    labels = connected_components(linked, "similar")
    with passing(docs.sparkSession):
        met = cut(_close(_met(grouped(labels, [folded.alias("odd")])), sets), "similar-met")
    release(docs.sparkSession)
    with passing(docs.sparkSession):
        more = _verified(met, rows, docs, words)
        for n in "ab":
            inside = labels.select(F.col("node").alias(n), F.col("component").alias(f"{n}_in"))
            more = more.join(inside, n, "left").withColumn(n, F.coalesce(f"{n}_in", n)).drop(f"{n}_in")
        more = cut(more, "similar-links")
    lower = connected_components(more, "similar").select(F.col("node").alias("component"), F.col("component").alias("lower"))
    group = rows.select("doc_id", "h_text", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return group.join(lower, "component", "left").select("doc_id", "h_text", F.coalesce("lower", "component").alias("group"))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest doc_id (null last), same columns.

    Rows that repeat both doc_id and text count as one. The winners are an aggregate of small rows; whole
    rows are moved once, to meet them.
    """
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.col("doc_id").isNull().alias("__null")]
    grouped = similar(docs.select("doc_id", "text"), words)
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("h_text").alias("h"))).alias("w"))
    winners = best.select(F.coalesce(F.col("w.d").cast("string"), F.lit("")).alias("__id"), F.col("w.n").alias("__null"), F.col("w.h").alias("__h"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")  # out of the way of names in use here
    kept = docs.select(row, *keys, F.xxhash64("text").alias("__h")).join(winners, ["__id", "__null", "__h"], "left_semi")
    return kept.dropDuplicates(["__id", "__null", "__h"]).select("__row.*")
