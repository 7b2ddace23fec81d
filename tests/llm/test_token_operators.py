import collections
import json
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftframe.llm import digest_cache, packing, queries, tokens
from driftframe.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "It's  THE\n\n end \t x", "ÀÉ ß µ½ 12 34", "x<|endoftext|>y <|startoftext|>", "名前 ́é \x1f \xa0\x85 İ Σς", "don't we'll  \n a\n b \r\n", "!!! ###ab12cd''s"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD + ["copy", "copy"])], "doc_id long, text string, n_tokens string")


@pytest.mark.parametrize("file, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_is_the_library(spark, file, kind):
    texts = [t or "" for t in ODD] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path(file))
    for text, got in zip(texts, tokens.encoder(public_tokenizers.path(file), kind).encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids), text


def test_counts_and_cache(spark, odd):
    path, file = scratch_path(spark, "cache-test"), public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    for docs in (odd.limit(4), odd):  # the second meets a part of its texts stored
        got = sorted((r.doc_id, r.n_tokens) for r in digest_cache.count_tokens(docs, path, file).collect())
        assert got == sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    stored = digest_cache.cached(spark, path)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in ODD + ["copy"]})
    assert digest_cache.count_tokens(odd.limit(0), path, file).count() == 0


def test_a_warm_cache_encodes_misses_only(spark, odd, monkeypatch):
    file = public_tokenizers.path("byte_bpe_50k.json")
    for bound in (100_000, 0):  # misses are broadcast or met by shuffling
        monkeypatch.setattr(digest_cache, "BROADCAST_ROWS", bound)
        path = scratch_path(spark, "cache-test")
        digest_cache.count_tokens(odd.where("doc_id < 8"), path, file)
        before = digest_cache.cached(spark, path).count()
        digest_cache.count_tokens(odd, path, file)  # appends what it encodes
        assert digest_cache.cached(spark, path).count() == len({t or "" for t in ODD + ["copy"]}) > before
        files = spark.read.parquet(path).inputFiles()
        digest_cache.count_tokens(odd.union(odd), path, file)
        assert sorted(spark.read.parquet(path).inputFiles()) == sorted(files) and all("version=" in f for f in files)


def test_another_tokenizer_goes_to_the_library(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        said = json.load(f)
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(said))
    library = Tokenizer.from_file(str(tmp_path / "other.json"))
    got = tokens.Encoder(str(tmp_path / "other.json"), "byte").encode([t or "" for t in ODD])
    assert [len(g) // 4 for g in got] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD]


def test_very_long_and_repeated_rows(spark):
    long = "several words of 1 text, " * 80_000
    rows = [(1, long), (2, "short"), (2, "short"), (3, None), (3, None), (None, "short")]
    docs = spark.createDataFrame([(*r, 7, "c", 9) for r in rows], "doc_id long, text string, piece int, sequence_id string, length int")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counted = digest_cache.count_tokens(docs, scratch_path(spark, "cache-test"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counted) == sorted((str(d), len(library.encode(t or "").ids)) for d, t in rows)
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    check_packing([r for r in packed if r.doc_id == 1], rows[:1], 4096, 1)
    assert sorted(str(r.doc_id) for r in packed if r.doc_id != 1) == ["2", "2", "3", "3", "None"] and packed[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_op5(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "").ids), n > 1024) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {tuple(r) for r in queries.op5_digest_cache(spark, SF).collect()} == want


def check_packing(rows, docs, capacity, end):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, bins = [], collections.defaultdict(list)
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        if fit:
            k = min(fit, key=rooms.__getitem__)
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_op8(spark):
    rows = queries.op8_best_fit(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_packing(rows, docs, 4096, 1) == best_fit_decreasing([r.length for r in rows], 4096)


def test_packing_odd_rows(spark, odd):
    rows = packing.pack(odd, public_tokenizers.path("word_bpe_49k.json"), 8, 1).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()], 8, 1)
    assert packing.pack(odd.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("histogram, capacity", [({10: 3, 3: 7, 1: 20}, 10), ({7: 5, 4: 5, 3: 9, 2: 4}, 11), ({1: 100}, 7), ({5: 1}, 5), ({}, 5), ({n: n % 7 + 1 for n in range(1, 60)}, 64)])
def test_plan_is_best_fit_decreasing(histogram, capacity):
    rows, bins, ranks = packing.plan(histogram, capacity), collections.defaultdict(list), collections.Counter()
    for length, first, items, bin_, per, base in sorted(rows, key=lambda r: (-r[0], r[1])):
        assert first == ranks[length]
        ranks[length] += items
        for k in range(items):
            bins[bin_ + k // per].append((base + k % per * length, length))
    assert ranks == collections.Counter(histogram)
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == best_fit_decreasing([n for n, k in histogram.items() for _ in range(k)], capacity)
    with pytest.raises(ValueError):
        packing.plan({capacity + 1: 1}, capacity)
