import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from driftframe.llm import langid, queries

SF = "/root/testdata/sf0.01"
WORDS = {"xx": ["baba", "bobo", "bubu"], "yy": ["kiki", "koko", "kaka"], "zz": ["sese", "sasa", "susu"]}


def texts(lang, n, seed=1):
    rng = random.Random(f"{lang}{seed}")
    return [" ".join(rng.choice(WORDS[lang]) for _ in range(30)) for _ in range(n)]


def test_op1_accuracy_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_error_correcting_codes(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or ""))
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert np.mean(right) > 0.97


@pytest.mark.parametrize("n", [2, 3, 5, 7, 12])
def test_codewords_are_far_apart(n):
    code = langid.codewords(n)
    near = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert code.shape[0] == n and near >= max(1, code.shape[1] // 4) and all(0 < (column == 1).sum() < n for column in code.T)


def test_learns_and_flags_ambiguity(spark):
    rows = [(i, t, lang, "s") for lang in WORDS for i, t in enumerate(texts(lang, 60))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))
    for lang in WORDS:
        assert all(model.predict(t)[0] == lang for t in texts(lang, 20, 2))
    mixes = [model.predict("baba " * k + "kiki " * (100 - k)) for k in range(101)]
    assert all({m[0], m[2]} == {"xx", "yy"} for m in mixes[20:80]) and mixes[0][0] == "yy" and mixes[100][0] == "xx"
    assert any(m[3] for m in mixes[20:80]) and not any(m[3] for m in mixes[:10] + mixes[-10:])


def test_odd_rows(spark):
    rows = [(1, None, "xx"), (2, "", "xx"), (3, "123 !?", "yy"), (None, "baba bobo", None), (5, "x" * 2_500_000, None), (5, "kiki", "yy"), (5, "kiki", "yy")]
    docs = spark.createDataFrame([(*r, 1.5, "keep") for r in rows], "doc_id long, text string, lang string, score double, other string")
    labelled = docs.unionByName(spark.createDataFrame([(i, t, k, 1.5, "o") for k in ("xx", "yy") for i, t in enumerate(texts(k, 9))], docs.schema))
    found = langid.predict(docs, langid.fit(labelled)).collect()
    assert len(found) == len(rows) and all(r.other == "keep" for r in found) and found[0].asDict().keys() == {"doc_id", "text", "lang", "other", "lang_pred", "score", "runner_up", "ambiguous"}
    assert [r.lang_pred for r in found if r.doc_id in (1, 2, 3)] == ["und"] * 3 and [r.score for r in found if r.doc_id == 1] == [0.0]
    empty = langid.fit(docs.limit(0))
    assert empty.languages == () and langid.predict(docs, empty).where("lang_pred <> 'und'").count() == 0
    one = langid.fit(labelled.where("lang = 'xx'"))
    assert one.predict("kiki")[:2] == ("xx", 1.0)
    assert langid.predict(docs.limit(0), one).count() == 0


def test_parts_of_long_texts_count_alike():
    text = "".join(random.Random(3).choice("abc de") for _ in range(5000))
    whole, size = langid.ngram_counts(text), langid._PART
    langid._PART = 700
    try:
        assert abs(langid.ngram_counts(text).sum() - whole.sum()) < 0.01 * whole.sum()
    finally:
        langid._PART = size


def test_documents_stay_if_no_language_can_be_learned(spark):
    rows = [(1, "some words", None), (2, "12 34", None), (3, None, None), (None, "more words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.text for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == ["more words", "some words"]


def test_decoding_is_the_brute_force_one(spark):
    """N-gram counts, classifiers, margins and losses in plain Python, without hashing tricks of arrays."""
    docs = [(i, t, lang) for lang in WORDS for i, t in enumerate(texts(lang, 25))]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))

    def grams(text):
        text, out = " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split(" ")), {}
        text = __import__("re").sub(" +", " ", text)
        for n in langid.ORDERS:
            for at in range(len(text) - n + 1):
                h = 0
                for k, c in enumerate(text[at : at + n]):
                    h = (h ^ ord(c)) * int(langid._MIX[k]) % 2**32
                b = (h ^ h >> 15) % langid.BUCKETS
                out[b] = out.get(b, 0) + 1
        return out

    languages, share = sorted(WORDS), {}
    for lang in languages:
        total = {}
        for _, t, own in docs:
            if own == lang:
                counts = grams(t)
                for b, n in counts.items():
                    total[b] = total.get(b, 0) + round(n * 1e6 / sum(counts.values()))
        share[lang] = {b: n / sum(total.values()) for b, n in total.items()}
    code = langid.codewords(3)

    def margins(text):
        counts, out = grams(text), []
        for j in range(code.shape[1]):
            sides = [[k for i, k in enumerate(languages) if code[i, j] == s] for s in (1, -1)]
            weight = lambda b: np.log((np.mean([share[k].get(b, 0) for k in sides[0]]) + 1e-6) / (np.mean([share[k].get(b, 0) for k in sides[1]]) + 1e-6))  # noqa: E731, B023
            out.append(sum(n * weight(b) for b, n in counts.items()) / sum(counts.values()))
        return np.array(out)

    seen = {k: [margins(t) for _, t, own in docs if own == k] for k in languages}
    trust = []
    for i, k in enumerate(languages):
        rate = (sum((np.sign(m) == code[i]).astype(float) for m in seen[k]) + 1) / (len(seen[k]) + 2)
        trust.append(rate / rate.mean())
    scale = 2 / np.mean([np.abs(m).mean() for k in languages for m in seen[k]])
    for text in [*(t for k in WORDS for t in texts(k, 5, 3)), "baba kiki", "Bubu, 12 SASA!"]:
        loss = [sum(t * np.exp(-c * m * scale) for t, c, m in zip(trust[i], code[i], margins(text))) for i in range(3)]
        order = np.argsort(loss)
        got = model.predict(text)
        assert got[0] == languages[order[0]] and got[2] == languages[order[1]]
        assert abs(got[1] - 1 / sum(np.exp(min(loss) - x) for x in loss)) < 1e-4
        assert got[3] == (loss[order[1]] - loss[order[0]] < langid.AMBIGUOUS * code.shape[1])
