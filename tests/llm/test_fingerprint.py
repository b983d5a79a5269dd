"""Versions against plain sets of paragraphs."""

import hashlib
import random
import re

from netquarry.llm import fingerprint


def paragraphs(text):
    out = set()
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*", line)
        out |= {"".join(words[i:i + fingerprint.WORDS]) for i in range(0, len(words), fingerprint.WORDS)}
    return out


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(6)
    vocab = ["w%d" % i for i in range(500)] + ["é", "😀x"]
    make = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))
    out = [None, "", " \n", "one", make(3000)] + [make(rng.choice([1, 5, 30, 100, 400])) for _ in range(50)]
    for _ in range(20):
        out.append(out[rng.randrange(5, 50)] + make(rng.choice([0, 1, 12])))
    return out


def test_versions_against_sets(spark):
    rng = random.Random(1)
    ids = sorted(rng.sample(range(-70_000, 400_000), len(texts())))
    rows = [(i, t, "x") for i, t in zip(ids, texts())]
    whole = [t or "" for t in texts()]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in fingerprint.compare_versions(df).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for k, i in enumerate(ids):
        text, after = whole[k], whole[(k + 1) % len(whole)]
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(text, edited)) < 1e-9
        assert abs(r.near_next - likeness(text, after)) < 1e-9
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        if edited == text:
            assert r.fingerprint == r.edited_fingerprint
    assert len({r.fingerprint for r in got.values()}) == len({frozenset(paragraphs(t)) for t in whole})


def test_single_repeated_and_missing_ids(spark):
    schema = "doc_id long, text string"
    one = fingerprint.compare_versions(spark.createDataFrame([(5, "a b c d")], schema)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a").hexdigest()
    rows = [(1, "x y"), (1, "x y"), (None, "first"), (2, None)]
    got = sorted(((r.doc_id, r.n_chars, r.near_next) for r in fingerprint.compare_versions(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 3, 0.0), (1, 3, 1.0), (2, 0, 0.0), (None, 5, 0.0)]
    assert fingerprint.compare_versions(spark.createDataFrame([], schema)).collect() == []
