"""Fingerprints and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from netquarry.llm import common, simhash


def brute_fp(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_documents_against_all_pairs(spark):
    rng = random.Random(11)
    vocab = ["word%d" % i for i in range(300)] + ["Éa", "ÀB", "XyZ"]
    texts = [None, "", " \n", "One", "one", "two words", "ONE\ttwo three"]
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    rows = [(i * 3 + 5, t, "x") for i, t in enumerate(texts)] + [(5, None, "x"), (8, "", "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fp(t) for i, t, _ in rows}
    ids = sorted(fp)
    pairs = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = brute_components(pairs, ids)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("blocks", [2, 3, 4])
def test_every_pair_within_three_bits_meets(spark, blocks):
    rng = random.Random(blocks)
    fps = set()
    for _ in range(200):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(1, 6)):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.close(spark.createDataFrame([(x,) for x in signed], "fp long"), blocks=blocks).collect()
    mask = (1 << 64) - 1
    assert all((e.a & mask ^ e.b & mask).bit_count() <= 3 for e in edges)
    want = brute_components([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3], signed)
    assert brute_components([(e.a, e.b) for e in edges], signed) == want


def test_a_long_run_gives_a_spanning_forest():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = np.array([base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)], np.uint64)
    a, b = simhash.links(np.zeros(len(fps), np.int64), fps, 3)
    assert len(a) < len(fps) and (np.bitwise_count(a ^ b) <= 3).all()
    pairs = [(int(x), int(y)) for x in fps for y in fps[fps > x] if int(x ^ y).bit_count() <= 3][:200_000]
    want = brute_components(pairs, [int(x) for x in fps])
    assert len(set(brute_components(zip(a.tolist(), b.tolist()), [int(x) for x in fps]).values())) == len(set(want.values()))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3), (300, 301), (300, 301)]
    rng = random.Random(1)
    rng.shuffle(edges)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in [100, *range(200, 260)]} | {300: 300, 301: 300}
    assert got == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
