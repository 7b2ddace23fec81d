import random
import re

import pytest

from driftframe.llm import queries, spaced_seeds

SF = "/root/testdata/sf0.001"
RNG = random.Random(4)
WORDS = [f"w{k}" for k in range(3000)]


def words(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items, masks=spaced_seeds.MASKS, window=spaced_seeds.WINDOW, agree=spaced_seeds.AGREE):
    """{(doc, item): overlap} from every pair of positions at which a seed agrees."""
    out = {}
    for d, text in docs:
        t = tokens(text)
        for i, item in items:
            it = tokens(item)
            if len(it) < spaced_seeds.LEAST:
                continue
            own = masks if len(it) >= len(masks[0]) else ["1" * len(it)]
            size, best = min(window, len(it)), 0
            for m in own:
                ones = [k for k, c in enumerate(m) if c == "1"]
                for p in range(len(t) - len(m) + 1):
                    for q in range(len(it) - len(m) + 1):
                        if all(t[p + k] == it[q + k] for k in ones):
                            for w in range(max(0, q + len(m) - size), min(q, len(it) - size) + 1):
                                best = max(best, sum(0 <= k + p - q < len(t) and it[k] == t[k + p - q] for k in range(w, w + size)) / size)
            if best >= agree:
                out[d, i] = best
    return out


def test_op9(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.overlap for r in queries.op9_spaced_seeds(spark, SF).collect()}
    near = {}
    for d, i in got:  # brute force over all documents is for those with a pair of equal tokens in a row only
        near.setdefault(d, set()).add(i)
    grams = {}
    for i, t in items:
        for g in zip(tokens(t), tokens(t)[1:]):
            grams.setdefault(g, set()).add(i)
    for d, text in docs:
        t = tokens(text)
        chosen = {i for g in zip(t, t[1:]) for i in grams.get(g, ())}
        want = brute([(d, text)], [x for x in items if x[0] in chosen]) if len(t) < 3000 else {}
        if len(t) < 3000:
            assert want == {k: v for k, v in got.items() if k[0] == d}


@pytest.fixture(scope="module")
def planted(spark):
    items = [(k, " ".join(words(n))) for k, n in enumerate([40, 25, 20, 15, 12, 8, 5, 4, 60])]
    docs, n = [], 0
    for k, text in items:
        w = text.split()
        changed = [c if j % 7 else "other" for j, c in enumerate(w)]
        for body in (w, changed, w[: len(w) // 2], [x.upper() + "," for x in w], w[::-1]):
            docs.append((n, " ".join([*words(30), *body, *words(30)])))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "?! ..."), (None, items[0][1]), (n + 3, items[1][1]), (n + 3, items[1][1]), (n + 3, "clean " * 50), (n + 4, " ".join(words(40_000)) + " " + items[8][1]), (n + 5, items[3][1] + " " + items[0][1])]
    return docs, items


def test_substitutions(spark, planted):
    docs, items = planted
    table = spark.createDataFrame([(d, t, 1, "c") for d, t in docs], "doc_id long, text string, pos int, h string")
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, h string")
    got = {(r.doc_id, r.item_id): r.overlap for r in spaced_seeds.find(table, bench).collect()}
    want = {}
    for k, v in brute([d for d in docs if len(d[1] or "") < 50_000], items).items():
        want[k] = max(v, want.get(k, 0))
    assert {k: v for k, v in got.items() if k[0] != docs[-2][0]} == want and got[docs[-2][0], 8] == 1.0
    assert got[1, 0] >= 0.8 and (4, 0) not in got and (35, 7) not in got
    clean = spaced_seeds.contaminated(table, bench).collect()
    assert len(clean) == len(docs) and [(r.contaminated, r.item_ids, r.overlap) for r in clean if r.doc_id == docs[-9][0]] == [(False, [], 0.0)]
    assert [sorted(r.item_ids) for r in clean if r.doc_id == docs[-1][0]] == [[0, 3]]
    kept = spaced_seeds.decontaminated(table, bench)
    assert kept.columns == table.columns and [r.text for r in kept.collect() if r.doc_id == docs[-3][0]] == ["clean " * 50]
    assert kept.count() == sum(not r.contaminated for r in clean)


def test_recall_against_all_alignments(spark):
    """Without seeds: every alignment of item and text. Windows with exactly a fifth substituted, at each length the masks serve."""
    rng, docs, items = random.Random(8), [], []
    for k in range(330):
        n = 12 + k // 30 if k < 270 else 20 + k % 40
        item = words(n)
        size = min(20, n)
        at = rng.randrange(n - size + 1)
        changed = item[at : at + size]
        for j in rng.sample(range(size), size // 5):
            changed[j] = f"z{rng.random()}".replace(".", "")
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([*words(20), *changed, *words(20)])))
    pairs = list(__import__("itertools").combinations(range(12), 2))
    for i, j in pairs:  # any two of twelve
        item = words(12)
        items.append((1000 + 12 * i + j, " ".join(item)))
        docs.append((1000 + 12 * i + j, " ".join([*words(5), *(f"y{i}x{j}x{k}" if k in (i, j) else w for k, w in enumerate(item)), *words(5)])))
    got = {r.doc_id for r in spaced_seeds.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id == r.item_id}
    want = set()
    for (d, text), (_, item) in zip(docs, items):
        t, it = text.split(), item.split()
        size = min(20, len(it))
        if any(5 * sum(a == b for a, b in zip(t[p : p + size], it[q : q + size])) >= 4 * size for p in range(len(t) - size + 1) for q in range(len(it) - size + 1)):
            want.add(d)
    assert len(want) > 390 and got <= want and len(got) >= 0.99 * len(want) and {d for d in want if d >= 1000} <= got


def test_joined_by_shuffling(spark, planted, monkeypatch):
    docs, items = planted
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    test_substitutions(spark, planted)


def test_empty_tables_and_odd_items(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, None), (None, "a b c d e"), (3, ""), (4, "b c"), (5, "c d e f g"), (5, "a b c d e")], "item_id long, text string")
    assert sorted((r.doc_id, str(r.item_id)) for r in spaced_seeds.find(docs, bench).collect()) == [(1, "5"), (1, "5"), (1, "None")]
    assert [sorted(x for x in r.item_ids) for r in spaced_seeds.contaminated(docs, bench).where("doc_id = 1").collect()] == [[5]]
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert spaced_seeds.find(d, b).count() == 0 and spaced_seeds.decontaminated(d, b).count() == d.count()
    with pytest.raises(ValueError):
        spaced_seeds.find(docs, bench, masks=("101", "1001"))
