"""Removed bytes against a table of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from netquarry.llm import repeats
from netquarry.llm.blocks import squeeze
from netquarry.llm.suffixes import suffix_array

N = repeats.LENGTH


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[s:s + N] for t in texts for s in range(len(t) - N + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in range(len(t) - N + 1):
            if seen[t[s:s + N]] > 1:
                gone[s:s + N] = b"\1" * N
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["é", "😀", "line\n"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [make(n) for n in (60, 90, 110, 125, 150, 400)]
    texts = [None, "", "short", "a" * 3000, "ab" * 900, "x" * (N - 1), "y" * N, "z" * (N + 1), make(2000)]
    for _ in range(60):
        t = make(rng.randint(10, 200))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(["", " "]) + rng.choice(passages)[rng.choice([0, 0, 7]):] + " " + make(rng.randint(0, 60))
        texts.append(t)
    for _ in range(30):
        t = rng.choice(texts[8:])
        cut = rng.randrange(len(t))
        texts.append(rng.choice([t, t[:cut] + "#" + t[cut:], t[:cut] + t[cut + 1:], t + t]))
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[20])]


@pytest.mark.parametrize("together", [repeats.TOGETHER, 2])
def test_documents_against_all_strings(spark, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rows = corpus(together)
    blocks = {}
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS spans")
    if together != 2:
        got = sorted(map(tuple, repeats.report(df).collect()), key=str)
        assert got == brute(rows)
    # The same functions beside each other in this process, where the limit above holds.
    import pyarrow as pa

    for k, (i, t) in enumerate(rows):
        blocks.setdefault(k % 4, []).append((i, t or "", k % 4))
    tables = [pa.table({"doc_id": pa.array([r[0] for r in b], pa.int64()), "text": squeeze([r[1] for r in b]), "block": [r[2] for r in b]}) for b in blocks.values()]

    def by(table, *keys):
        out = {}
        for r in table.to_pylist():
            out.setdefault(tuple(r[k] for k in keys), []).append(tuple(r.values()))
        return [repeats.rows_of(v) for v in out.values()]

    answers = pa.concat_tables([repeats.answer_anchors(t) for t in by(pa.concat_tables([repeats.send_anchors(t, 3) for t in tables]), "part")])
    mine = lambda table, k: repeats.rows_of([tuple(r.values()) for r in table.to_pylist() if r["block"] == k])
    moved = pa.concat_tables([repeats.send_segments(t, mine(answers, k), 3) for k, t in zip(blocks, tables)])
    found = pa.concat_tables([answers, *(repeats.answer_segments(t) for t in by(moved, "kind", "part"))])
    assert (repeats.STRING in moved.column("kind").to_pylist()) == (together == 2)
    got = []
    for k, t in zip(blocks, tables):
        for r in repeats.clean_block(t, mine(found, k)).to_pylist():
            gone = sum(s["stop"] - s["start"] for s in r["spans"])
            got.append((r["doc_id"], r["n_bytes"], gone, len(r["spans"]), hashlib.sha256(r["kept_text"]).hexdigest()))
    assert sorted(got, key=str) == brute(rows)


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 20])
        s = [rng.randint(1, k) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_empty_table(spark):
    assert repeats.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_anchors_spread_over_the_parts():
    import numpy as np

    rng = random.Random(5)
    texts = [rng.randbytes(40_000).hex().encode() for _ in range(20)]
    for parts in (24, 84):
        at = repeats.cuts(repeats.distinct_of(repeats.all_anchors(texts)).a, parts)
        held = np.diff(at)
        assert held.sum() > 5000 and held.max() <= 2 * held.mean()
