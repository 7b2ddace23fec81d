import hashlib
import re

import pytest

from driftframe.llm import pii, queries

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    None, "", "a@b.c_d@e.f", "x@@y.z a@b a@b.c.d. -@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 007.0.0.255 0000000255.1.1.1 1.2.3 256.1.1.1",
    "4111111111111111 4111-1111 1111-1111 4111111111111112 41111111111111111111 3782 822463 10005 4111111111111111 12",
    "+1 (017) 555-7713 and +1 (017) 555-7713+44 20 7946 0958 +1 +12 +1234567 +12345678 +1234567890123456 +1--)(",
    "😀 é write to bob@mail.example.com, 😀 call (017) 555-7713 or 017-555-7713x; bob [at] mail [dot] com",
    "a" * 3000 + "@x.yz " + "9" * 3000 + " " + "1." * 2000 + "5 " + "a." * 3000 + "@", "q@" + "a." * 6000 + "b", "\n+1 555 1234567\n8", "ſ@K.com İ@x.yz ١٢٣.١.١.١",
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")) if len(m[0]) < 3000 else False,
                "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_is_the_plain_patterns(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "x")], "doc_id long, text string, spans string")
    got = {r.doc_id: [(pii.KINDS[s.k], s.s, s.e) for s in r.spans if s.base] for r in pii.spans_of(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (i, (t or "")[:80])


def test_op2(spark):
    rows = {r.doc_id: r for r in queries.op2_weak_supervision(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base, r = brute(d.text), rows.pop(d.doc_id)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in PATTERNS]
        spans = r.spans.split(",") if r.spans else []
        assert set(listed.split(",")) - {""} <= set(spans)
        keys = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert keys == sorted(keys)
    assert not rows


def test_method_adds_wide_spans_and_leaves_numbers_alone(spark):
    texts = ["call (017) 555-7713 now", "phone: 017-555-1234.", "mail bob [at] mail [dot] com please", "order 1234 5678 9012 3456 shipped", "version 1.2.3.400 is out", "in 2019 12 of 300 came"] * 5
    texts += ["email bob@mail.example.com.", "call +1 (017) 555-7713 now", "card 4111 1111 1111 1111,"] * 10
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[s.k], texts[r.doc_id][s.s : s.e]) for s in r.spans] for r in pii.spans_of(docs).collect()}
    assert got[0] == [("phone", "(017) 555-7713")] and got[1] == [("phone", "017-555-1234")]
    assert got[2] == [("email", "bob [at] mail [dot] com")]
    assert got[3] == got[4] == got[5] == []
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "call [PHONE] now" and clean[30] == "email [EMAIL]." and clean[32] == "card [CARD]," and clean[5] == texts[5]


def test_very_long_texts(spark):
    """400,000 characters each, with up to fifty thousand candidates; quadratic work would take hours."""
    units = ["123 x ", "+1 555 123 4567, ", "call 555-123-4567, ", "ab@cd.ef ", "1", "@", "+1(", "4111 1111 1111 1111, ", "1.", "a.", "(017) 555-7713 a@b.cd "]
    texts = [(u * (1 + 400_000 // len(u)))[:400_000] for u in units]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [(pii.KINDS[s.k], s.s, s.e) for s in r.spans if s.base] for r in pii.spans_of(docs).collect()}
    for i, t in enumerate(texts):
        if len(set(t)) > 2:  # the plain patterns take forever on the others, which hold nothing
            assert got[i] == brute(t)
    assert not (got[4] or got[5] or got[9])
    clean = {r.text[:20]: len(r.text) for r in pii.redact(docs).collect()}
    assert clean["[EMAIL] [EMAIL] [EMA"] == sum(len("[EMAIL]") - e + s for _, s, e in got[3]) + 400_000


def test_overlaps_are_those_of_brute_force(spark):
    rng = __import__("random").Random(6)
    for base in (True, False):
        cands = [[(rng.randrange(2), s := rng.randrange(60), s + rng.randrange(1, 12), base and rng.random() < 0.2, [1, 1, 1, 1]) for _ in range(rng.randrange(30))] for _ in range(60)]
        cands = [[c for c in own if c[3] or not any(b[3] and b[1] < c[2] and c[1] < b[2] for b in own)] for own in cands]
        cands = [[c for i, c in enumerate(own) if not (c[3] and any(b[3] and b[0] == c[0] and b[1] < c[2] and c[1] < b[2] for b in own[:i]))] for own in cands]
        found = spark.createDataFrame([(i, "abcdefghij" * 8, own) for i, own in enumerate(cands)], "doc_id long, text string, cands array<struct<k:int,s:int,e:int,base:boolean,v:array<int>>>")
        spans = pii.classified(found, pii.Model({}, {}, {k: [1.0, 1.0, 1.0, 1.0, 1.0] for k in range(4)}))
        for r, s in zip(sorted(spans.collect(), key=lambda r: r.doc_id), sorted(pii.redacted(spans).collect(), key=lambda r: r.doc_id)):
            own = sorted({c[:4] for c in map(tuple, r.cands)}, key=lambda c: (c[0], c[1], -c[2]))
            want = [c for c in own if c[3] or not any(not d[3] and d[0] == c[0] and d[1] < c[2] and c[1] < d[2] and (d[1] < c[1] or d[1] == c[1] and d[2] > c[2]) for d in own)]
            assert sorted({tuple(x) for x in r.spans}) == sorted(want)
            text, at = "", 0
            for k, a, b, _ in sorted(map(tuple, r.spans), key=lambda x: (x[1], -x[2], x[0])):
                text += r.text[at:a] + f"[{pii.KINDS[k].upper()}]" if a >= at else ""
                at = max(at, b)
            assert s.text == text + r.text[at:]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a@b.cd", 1), (None, "a@b.cd", 1), (3, None, 2)], "doc_id long, text string, cands int")
    assert sorted(str(r.text) for r in pii.redact(docs).collect()) == ["None", "[EMAIL]", "[EMAIL]"]
    assert pii.redact(docs).schema == docs.schema and sorted(r.cands for r in pii.redact(docs).collect()) == [1, 1, 2]
    assert pii.spans_of(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
    assert all(r.spans == [] for r in pii.spans_of(docs.where("text is null")).collect())


def test_estimation_learns_who_is_reliable():
    truth = {(3, 1, 1, 1, 1): 400, (3, -1, -1, 0, 0): 300, (3, 0, 1, 1, 1): 40, (3, 0, -1, -1, -1): 40, (3, -1, 1, 0, 0): 3}
    model = pii.estimate(truth)
    rates = model.reliability[3]
    assert rates[0][1][0] > rates[0][1][1] and rates[1][-1][1] > rates[1][-1][0]
    score = lambda v: model.weights[3][0] + sum(a * b for a, b in zip(model.weights[3][1:], v))
    assert score((0, 1, 1, 1)) > 0 > score((0, -1, -1, -1))
    assert pii.estimate({}).weights == {}
    with pytest.raises(KeyError):
        pii.estimate({}).weights[0]
