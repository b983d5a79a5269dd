"""Phrases against brute force over all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from netquarry.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=30, top=2000, inside=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i: i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    long = {c: a for c, a in f.items() if a >= least and len(c[1]) > 1}
    out = set()
    kept = {}
    for (lang, p), a in long.items():
        cut = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(c[0] == lang and len(c[1]) > len(p) and 100 * b >= inside * a and any(c[1][i: i + len(p)] == p for i in range(len(c[1])))
                   for c, b in long.items()):
            kept.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), f[lang, p[: cut[1]]], f[lang, p[cut[1]:]]))
    for lang, found in kept.items():
        for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return out


def got(spark, rows, parts=4, **options):
    docs = spark.createDataFrame([(i, t, c, "x", 1) for i, (t, c) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n long")
    found = [tuple(r) for r in phrases.mine(docs.repartition(parts), **options).collect()]
    assert len(set(found)) == len(found)
    return set(found)


def texts(seed, count=160):
    rng = random.Random(seed)
    words = ["the", "of", "in", "New", "york", "É", "é", "字", "a\x00b", "x-y", " ", "\x1c"]
    out = []
    for _ in range(count):
        t = ""
        for _ in range(rng.randint(0, 40)):
            t += rng.choice([*words, "of the new york", "in the end of"]) + rng.choice([" "] * 8 + ["\t ", ". ", ",", "\n", "\r\n", "  "])
        out.append((t, rng.choice(["en", "en", "en", "fr", None, "und"])))
    return out + [(None, "en"), ("", None), (".,;", "de"), ("word", "de"), ("in the end of " * 3000, "fr"), ("B c. " * 31, "de")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = texts(seed)
    assert got(spark, rows) == plain(rows)
    want = plain(rows, least=5)
    assert got(spark, rows, least=5) == want and len(want) > 60


def test_hot_prefixes_and_small_batches_change_nothing(spark, monkeypatch):
    rows = texts(3)
    want = plain(rows, least=12, top=40)
    assert got(spark, rows, parts=1, least=12, top=40) == want
    # Most windows then begin with listed prefixes, and are dealt by three or four words.
    monkeypatch.setattr(phrases, "PLACE", 20)
    assert got(spark, rows, parts=3, least=12, top=40) == want


def test_sums_of_rows():
    rng = np.random.default_rng(1)
    rows, n = rng.integers(0, 4, (500, 4)), rng.integers(1, 9, 500)
    want = Counter()
    for r, m in zip(rows.tolist(), n.tolist()):
        want[tuple(r)] += m
    found, sums = phrases.summed(rows, n)
    assert list(zip(map(tuple, found.tolist()), sums.tolist())) == sorted(want.items())


def test_empty_table(spark):
    assert phrases.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
