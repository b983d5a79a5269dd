"""Language prediction against a plain kernel regression, on held-out rows and on odd tables."""

import random
import zlib

import numpy as np

from netquarry.llm import langid

SOUNDS = {"aa": "ka lo mi ne su".split(), "bb": "kra plö mitz nör schu".split(), "cc": "оля ка ми не су".split()}


def text(rng, lang, words=60):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def rows(count=240, seed=1):
    rng = random.Random(seed)
    langs = ["aa", "aa", "aa", "bb", "cc"]
    return [(i, text(rng, langs[i % 5]), langs[i % 5]) for i in range(count)]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def plain(text):
    joined = f" {' '.join(langid.LETTERS.findall(text.lower()))} "
    return {joined[i: i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1)}


def test_kernel_and_weights_equal_a_plain_computation():
    data = rows(60)
    texts, langs = [t for _, t, _ in data], [c for _, _, c in data]
    model = langid.fit(texts, langs, landmarks=9)
    turn, seen = [], {}
    for i, c in enumerate(langs):
        seen[c] = seen.get(c, 0) + 1
        turn.append((seen[c], c, i))
    marks = [plain(texts[i]) for *_, i in sorted(turn)[:9]]
    sets = [plain(t) for t in texts]
    like = lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5
    among = np.array([[like(x, y) for y in marks] for x in marks])
    own = np.array([[like(x, y) for y in marks] for x in sets])
    got = langid.kernel([langid.grams(t) for t in texts], model.strings, model.unpacked())
    assert np.allclose(got, own, atol=1e-5)
    names = sorted(set(langs))
    w = np.diag([1 / langs.count(c) for c in langs])
    for k, name in enumerate(names):
        y = np.array([1.0 if c == name else -1.0 for c in langs])
        x = model.weights[:, k]
        loss = lambda b: (own @ b - y) @ w @ (own @ b - y) + langid.RIDGE * len(names) * b @ among @ b
        rng = np.random.default_rng(k)
        # The fitted weights are where the loss is least.
        assert all(loss(x) <= loss(x + rng.normal(0, 1e-2, len(x))) + 1e-6 for _ in range(50))


def test_strings_of_long_texts_are_cut_in_slices(monkeypatch):
    t = text(random.Random(5), "bb", 4000)
    whole = langid.grams(t)
    monkeypatch.setattr(langid, "SLICE", 1000)
    assert np.array_equal(whole, langid.grams(t)) and len(whole) == len(plain(t))


def test_held_out_rows_are_right(spark):
    data = rows()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 ?! _", "cc"), (None, data[0][1], "bb"), (1003, data[3][1] * 200, None),
           (1004, "字", "aa"), data[0], data[0]]
    docs = spark.createDataFrame([(*r, "x", "y") for r in data + odd],
                                 "doc_id long, text string, lang string, held_out string, score string")
    got = langid.predict(docs, labelled=90, landmarks=24).collect()
    assert len(got) == len(data) + len(odd)
    want = {i: c for i, _, c in data}
    for r in got:
        assert r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1
        if r.doc_id in want:
            assert r.lang_pred == want[r.doc_id]
        elif r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id == 1003:
            assert r.lang_pred == "bb"
        else:
            assert r.lang_pred in SOUNDS


def test_only_rows_outside_the_held_part_teach(spark):
    data = rows(80)
    docs = spark.createDataFrame([(i, t, "wrong" if held(i) else c) for i, t, c in data], "doc_id long, text string, lang string")
    texts, langs = langid.sample(docs, labelled=12)
    assert len(texts) == 12 and set(langs) == set(SOUNDS) and all(langs.count(c) == 4 for c in SOUNDS)
    assert {r.lang_pred for r in langid.predict(docs).collect()} == set(SOUNDS)
    assert langid.sample(docs.union(docs).repartition(3), labelled=12) == (texts, langs)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.predict(empty).count() == 0
    docs = spark.createDataFrame([(1, "abc", None), (2, "abc", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.predict(docs).collect()} == {("und", 0.0)}
