"""The pipeline against brute-force versions of its stages, and on odd documents."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftframe.llm import common, pii, simhash, spaced_seeds

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test-stage")
        out.append(docs.collect())
    return out


def test_stages_narrow_the_documents(stages):
    raw, language, dedup, clean, private, packed = stages
    assert {r.doc_id for r in language} == {r.doc_id for r in raw if any(c.isalpha() for c in r.text or "")}
    for a, b in zip(stages[:4], stages[1:4]):
        assert {tuple(r) for r in b} <= {tuple(r) for r in a}
    assert [r.__fields__ for r in private[:1]] == [COLUMNS] and {r.doc_id for r in packed} == {r.doc_id for r in private}


def test_dedup_is_the_brute_force_one(stages):
    _, language, dedup, *_ = stages
    kept, sets = {r.doc_id for r in dedup}, {r.doc_id: shingles(r.text) for r in language}
    near = {d: [e for e in sets if e != d and similarity(sets[d], sets[e]) >= 0.8] for d in sets}
    for d in sets:
        if d not in kept:  # it is near to something, and something in its group stays
            assert near[d]
        else:
            assert not any(similarity(sets[d], sets[e]) >= 0.8 for e in near[d] if e in kept)
        if not near[d]:
            assert d in kept


def test_decontamination_drops_overlaps_only(spark, stages):
    _, _, dedup, clean, private, _ = stages
    found = {r.doc_id for r in spaced_seeds.find(spark.createDataFrame(dedup), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean} == {r.doc_id for r in dedup} - found and found
    strict = re.compile(pii.BASE["email"].replace("++", "+").replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", ""))
    assert not any(strict.search(r.text) for r in private) and any("[EMAIL]" in r.text for r in private)
    assert all(r.n_chars == len(r.text) for r in private)


def test_run_is_the_stages(spark, stages):
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in stages[-1])


def test_odd_documents(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", None), (None, "some words of a text here", "en", None, 3), (4, "some words of a text here", "en", "s", 3), (4, "some words of a text here", "en", "s", 3), (5, "other " * 90_000, "fr", "s", 1), (6, "12 34", "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (docs.limit(0), docs):
        found = empty
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = corpus_pipeline.cut(stage(spark, found, SF), "test-odd")
            assert found.columns == COLUMNS
        packed = corpus_pipeline.STAGES[-1][1](spark, found, SF)
        assert (packed.count() > 0) == (empty is docs)
    assert sorted(r.doc_id for r in found.collect()) == [4, 5]


def test_language_id_rejects_what_the_decoder_flags(spark):
    halves = {"xx": "baba bobo bubu ", "yy": "kiki koko kaka "}
    rows = [(4 * i + j, halves[k] * 20, k) for i in range(40) for j, k in enumerate(halves)]
    mixed = [(9000 + k, "baba " * k + "kiki " * (100 - k), None) for k in range(101)]
    docs = spark.createDataFrame([(*r, "t", 1, True) for r in rows + mixed], "doc_id long, text string, lang string, lang_pred string, score int, ambiguous boolean")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert {r[0] for r in rows} <= ids and {9000, 9100, 9001, 9099} <= ids and any(9000 + k not in ids for k in range(30, 70))


def test_clashing_names_pass_all_stages(spark):
    names = ["text", "doc_id", "lang", "source", "n_chars", "node", "key", "spans", "cands", "__row", "h_text", "bits", "pos", "th", "group", "__h", "ambiguous"]
    rows = [(f"some words of text number {k} mail a{k}@b.cd", k, "en", "s", 1, *([5] * 12)) for k in range(6)]
    found = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.cut(stage(spark, found, SF), "test-clash")
        assert found.columns == names
    assert sorted((r.doc_id, r.key, r.text[-7:]) for r in found.collect()) == [(k, 5, "[EMAIL]") for k in range(6)]


def edited(words, share, rng):
    return [rng.choice(["alpha", "beta", "gamma"]) + str(rng.random()) if rng.random() < share else w for w in words]


def test_recall_and_precision_of_similar_texts(spark):
    rng = random.Random(9)
    rows, pairs = [], []
    for k in range(300):
        words = [f"t{rng.randrange(20_000)}" for _ in range(rng.randrange(80, 600))]
        other = edited(words, rng.choice([0.003, 0.006, 0.01, 0.015, 0.05, 0.3]), rng)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        pairs.append(similarity(shingles(rows[-2][1]), shingles(rows[-1][1])))
    group = {r.doc_id: r.group for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = [group[2 * k] == group[2 * k + 1] for k in range(300)]
    assert met == [s >= 0.8 for s in pairs]
    assert len({group[2 * k] for k in range(300)}) == 300  # no text joins another's pair
    copies = spark.createDataFrame([(k, "one and the same text of some words") for k in range(500)] + [(900, None), (901, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(copies).collect()) == [0, 900]
    assert simhash.one_of_each(copies.limit(0)).count() == 0


def test_bitmaps_are_not_written_out_in_plans(spark, monkeypatch):
    """The driver describes each plan many times and keeps that; with literals of a bitmap's size that was most of its memory."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k // 2}x{j}" for j in range(60))) for k in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(f"w3x{j}" for j in range(40)))], "item_id long, text string")
    described, tables = [], []

    def seen(df, label, *options):
        described.append(len(df._jdf.queryExecution().toString()))
        tables.append(label)
        return common.cut(df, label, *options)

    monkeypatch.setattr(simhash, "cut", seen)
    monkeypatch.setattr(spaced_seeds, "cut", seen)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == list(range(0, 20, 2))
    found = spaced_seeds.decontaminated(docs, items)
    assert sorted({*range(20)} - {r.doc_id for r in found.collect()}) == [6, 7]
    assert "similar-sets" in tables and max(*described, len(found._jdf.queryExecution().toString())) < 400_000


def test_bitmap_holds_its_hashes(spark):
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    bits = common.bitmap(rows.where("id % 2 = 0"), "h")
    kept = {r.id for r in rows.where(common.in_bitmap(F.col("h"), bits)).collect()}
    assert {*range(0, 3000, 2)} <= kept and len(kept) < 1520
    assert rows.where(common.in_bitmap(F.col("h"), common.bitmap(rows.limit(0), "h"))).count() == 0


def test_tables_of_a_finished_round_go(spark):
    files = []
    with common.passing(spark):
        files.append(common.cut(spark.range(3), "test-passing"))
        files.append(common.cut(files[0].where("id > 0"), "test-passing"))
        paths = [df.inputFiles()[0].removeprefix("file:") for df in files]
    assert [os.path.exists(p) for p in paths] == [False, True] and files[1].count() == 2


def test_texts_just_apart_from_a_large_group_are_sorted_out_before_sets_are_compared(spark, monkeypatch):
    rng, words, looked = random.Random(4), [f"w{j}" for j in range(100)], []
    places = [rng.sample(range(4, 96), 1) for _ in range(120)] + [[10 + k % 5, 40 + k % 7, 80 - k % 11] for k in range(30)]
    texts = [" ".join(f"e{k}.{j}" if j in at else w for j, w in enumerate(words)) for k, at in enumerate(places)]
    real = simhash._verified

    def verified(pairs, *rest):
        looked.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", verified)
    group = {r.doc_id: r.group for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    assert not any(similarity(sets[i], sets[j]) >= 0.8 for i in range(120, 150) for j in range(150) if i != j)
    assert len({group[k] for k in range(120)}) == 1 and len({group[k] for k in range(119, 150)}) == 31
    assert looked[-1] < 300  # of 30 x 120 pairs and more


def test_parities_lose_no_pair(spark):
    rng, sets, pairs = random.Random(6), [], []
    for k in range(400):
        every = [rng.getrandbits(63) for _ in range(rng.choice([1, 9, 90, 900, 5000]))]
        share = rng.choice([0.02, 0.08, 0.11, 0.3])
        for _ in "ab":
            own = simhash.np.array(sorted(x for x in every if rng.random() >= share) or every[:1], simhash.np.uint64)
            sets.append((len(sets), len(own), [0] * 4, simhash._odd(own), {*own.tolist()}))
        pairs.append((2 * k, 2 * k + 1))
    frame = spark.createDataFrame([s[:4] for s in sets], "node long, n int, bits array<long>, odd array<long>")
    kept = {(r.a, r.b) for r in simhash._close(spark.createDataFrame(pairs, "a long, b long"), frame).collect()}
    near = {(a, b) for a, b in pairs if similarity(sets[a][4], sets[b][4]) >= 0.8}
    assert near <= kept and len(pairs) - len(kept) > 50
