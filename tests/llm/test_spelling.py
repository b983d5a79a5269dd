"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from netquarry.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rows):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1:]] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    count = words(rows)
    around = {a: [b for b in count if near(a, b)] for a in count}
    form = {}
    for a, n in count.items():
        best = min(around[a], key=lambda b: (-count[b], b), default=None)
        form[a] = best if best is not None and count[best] >= 2 * n else None
    out = set()
    for a, n in count.items():
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, n, len(around[a]), count.get(form[a])))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, word string, form string, n long")


def got(spark, rows):
    found = spelling.variants(table(spark, rows)).collect()
    assert len({r.word for r in found}) == len(found)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found}


@pytest.mark.parametrize("alphabet, longest", [("ab", 8), ("abc", 6)])
def test_every_pair_is_found_once(spark, alphabet, longest):
    rng = random.Random(9)
    names = {"".join(rng.choice(alphabet) for _ in range(rng.randint(3, longest))) for _ in range(300)}
    pairs = [frozenset((r.a, r.b)) for r in spelling.neighbours(spark.createDataFrame([(w, 1) for w in names], "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {frozenset((a, b)) for a in names for b in names if a < b and near(a, b)}


@pytest.mark.parametrize("alphabet, count", [("ab", 60), ("abÀÿ×", 150), ("abcdefgh", 150)])
def test_equals_brute_force(spark, alphabet, count):
    rng = random.Random(len(alphabet))
    names = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 8))) for _ in range(count)]
    for w in list(names):
        at = rng.randrange(len(w) + 1)
        names += [w[:at] + w[at + 1:], w[:at] + rng.choice(alphabet) + w[at:], w[:at] + rng.choice(alphabet) + w[at + 1:]]
    rows = [(rng.randrange(50), " ".join(rng.choice(names) for _ in range(40))) for _ in range(90)]
    want = plain(rows)
    assert got(spark, rows) == want and any(r[1] for r in want) and max(r[4] for r in want) > 2


def test_odd_rows(spark):
    long = "q" * 6000
    rows = [(1, None), (2, ""), (3, "12 ... 字"), (None, "hello hello hello HELLO hell"), (None, "hello hello hello HELLO hell"),
            (4, "hallo,hallo;hallo Hülle hülle\x00hülle HÜLLE hÜlle hÜlle hÜlle"), (5, f"{long} {long} {long} {long}x {long}x {long}x"),
            (6, f"{long[:-1]}z {long[:-1]}z {long[:-1]}z a{long} a{long} a{long} " * 3), *[(7, "vielerlei " * 30)] * 2]
    assert got(spark, rows) == plain(rows)


def test_chains_of_forms_end_at_their_root(spark):
    chain = [f"abcde{'f' * k}" for k in range(9)]
    rows = [(i, " ".join([w] * (3 * 2 ** i))) for i, w in enumerate(chain)]
    rows = [(i, t) for i, t in rows] * 3
    want = plain(rows)
    assert got(spark, rows) == want
    assert max(len(r[2]) - len(r[0]) for r in want) >= 4


def test_ties_go_to_the_smallest_word(spark):
    rows = [(1, "bauten " * 3 + "bautel " * 400 + "bautea " * 400 + "bautez " * 400)]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_table_of_words_is_broadcast(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    chain = [f"abcde{'f' * k}" for k in range(5)]
    rows = [(i, " ".join(rng.choices(names, k=40))) for i in range(30)] + [(i, f"{w} " * (3 * 2 ** i)) for i, w in enumerate(chain)]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")  # any broadcast fails
    try:
        assert spark.range(9).join(spark.range(9).hint("merge"), "id").count() == 9
        with pytest.raises(Exception, match="Cannot broadcast"):
            spark.range(9).join(spark.range(9).hint("broadcast"), "id").count()
        found = got(spark, rows)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert found == plain(rows) and len({r[2] for r in found}) < len(found)
