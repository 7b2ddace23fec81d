import random
import re

import pytest
from xxhash import xxh64_intdigest

from driftframe.llm import queries, simhash
from driftframe.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_op6(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [brute_fingerprint(t) for _, t in docs]
    want = {(d, f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, brute_components(fps))}
    assert {tuple(r) for r in queries.op6_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("segments, paired", [(2, 64), (3, 64), (4, 64), (2, 3), (3, 3)])
def test_links_connect_all_within_two_bits(spark, monkeypatch, segments, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)  # so that entries are crowded
    rng = random.Random(5)
    fps = [0, 1, 3, 7, 0xFFFF << 48, *(5 << 40 | 1 << k for k in range(20))]
    for _ in range(60):
        x = rng.getrandbits(64)
        fps += [x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), x ^ 7 << rng.randrange(60)]
    fps = sorted(set(fps))
    signed = {simhash._signed(f): k for k, f in enumerate(fps)}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), segments)
    assert all((a ^ b).bit_count() in (1, 2) for a, b in ((fps[signed[r.a]], fps[signed[r.b]]) for r in links.collect()))
    label = {signed[r.node]: r.component for r in connected_components(links).collect()}
    classes = brute_components(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (classes[i] == classes[j]) == (label.get(i, f"own {i}") == label.get(j, f"own {j}"))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "a b c d e"), (6, "a b c d e"), (None, "a b c d e"), (8, "x y z")]
    docs = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted(((r.doc_id or 0, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert [r[2] for r in got if r[0] in (1, 2, 3)] == [1, 1, 1] and [r[2] for r in got if r[0] in (4, 5)] == [4, 4]
    assert [r[2] for r in got if r[0] in (0, 6)] == [6, 6, 6] and len(got) == len(rows)
    assert simhash.fingerprint("x y z") == simhash._signed(brute_fingerprint("x y z"))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 40])
def test_components_of_chains_and_stars(spark, n):
    chain = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, n)] + [(5000, 5000), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(n)}}


def test_all_members_of_an_entry_meet(spark):
    near, far = [0, 0, 0, 0], [-1, -1, 0, 0]
    members = [(7, n, 9, 0, c, near) for n, c in ((1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (9, 9))] + [(7, 20, 9, 0, 20, far)]
    members += [(8, 1, 9, 0, 1, near), (8, 6, 9, 0, 1, near), (9, 1, 9, 0, 1, near), (9, 11, 9, 1, 2, near), (9, 12, 9, 2, 3, near)]
    got = sorted(map(tuple, simhash._met(spark.createDataFrame(members, "key long, node long, n int, pos int, component long, bits array<long>")).select("a", "b").collect()))
    assert got == sorted([(a, b) for a in (1, 2, 3, 4, 5, 9) for b in (1, 2, 3, 4, 5, 9) if a < b and (a, b) != (3, 4)] + [(1, 11)])


def test_all_pairs_at_0_8_and_no_others(spark):
    rng, rows, sets = random.Random(3), [], []

    def add(words):
        rows.append((len(rows), " ".join(words)))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})

    for k in range(250):  # pairs just above and below, whose texts share a line and are near to no other
        n = rng.randrange(30, 120)
        words = [f"t{k}.{i}" for i in range(n)] + ["one", "line", "that", "all", "texts", "share"] * (k % 2)
        add(words)
        add(words[: -rng.randrange(1, 2 + n // 4)] if k % 3 else [*words, *[f"u{k}.{i}" for i in range(rng.randrange(1, 2 + n // 4))]])
    base = [f"g{i}" for i in range(60)]
    for k in range(40):  # a group whose members are near to some others only
        at = rng.randrange(60)
        add([*base[:at], f"h{k}", *base[at + 1 :]])
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    group = {r.doc_id: r.group for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, j) for i in group for j in range(i) if group[i] == group[j]} == {(i, j) for i in group for j in range(i) if root(i) == root(j)}
