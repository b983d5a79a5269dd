"""Scores against a plain model, and probabilities that add up to one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from netquarry.llm import blocks, katz


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in lowered.encode().split()] + ["</s>"]


class Plain:
    def __init__(self, texts):
        self.words, self.pairs, begins = Counter(), Counter(), 0
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            self.pairs.update(zip(["<s>", *w], w))
            begins += 1
        self.n = sum(self.words.values())
        of = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.TURING + 2)]
        self.dw, self.dp = katz.discounts(of(self.words)), katz.discounts(of(self.pairs))
        self.context = Counter(self.words) + Counter({"<s>": begins})
        self.unknown = sum(c * (1 - self.d(self.dw, c)) for c in self.words.values()) / self.n
        self.after = defaultdict(list)
        for (h, w), c in self.pairs.items():
            self.after[h].append((w, c))

    @staticmethod
    def d(table, c):
        return table[min(c, katz.TURING + 1)]

    def p1(self, w):
        c = self.words[w]
        return self.d(self.dw, c) * c / self.n if c else self.unknown

    def p(self, w, h):
        c = self.pairs[h, w]
        if c:
            return self.d(self.dp, c) * c / self.context[h]
        if not self.context[h]:
            return self.p1(w)
        mass = sum(self.d(self.dp, c) * c for _, c in self.after[h]) / self.context[h]
        return (1 - mass) / (1 - sum(self.p1(x) for x, _ in self.after[h])) * self.p1(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = ["w%d" % int(rng.paretovariate(0.8)) for _ in range(3000)] + ["Éa", "ABC", "abc"]
    out = [(i, rng.choice([" ", "\n"]).join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 20, 60])))) for i in range(400)]
    return out + [(1000, None), (1001, ""), (7, out[7][1]), (2000, "x " * 30_000)] + [(3000 + i, out[9][1]) for i in range(100)]


def test_scores_equal_a_plain_model(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = katz.score(df, block_bytes=6000, least=3).collect()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    model = Plain([t for i, t in rows if not held[i]])
    texts = dict(rows)
    v = len(model.words)
    for r in got:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(w), model.n)
        assert r.n_known == sum(x in model.words for x in w)
        base = sum(math.log10((model.words[x] + 0.1) / (model.n + 0.1 * (v + 1))) for x in w)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if len(w) < 1000:
            assert r.score == pytest.approx(sum(math.log10(model.p(x, h)) for h, x in zip(["<s>", *w], w)), rel=1e-7)


def test_probabilities_add_up(rows):
    model = Plain([t for _, t in rows[:200]])
    for h in ["<s>", *list(model.words)[:10]]:
        assert sum(model.p(w, h) for w in [*model.words, "never seen"]) == pytest.approx(1)


def test_packing():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (blocks.unpack_keys(blocks.pack_keys(keys), len(keys)) == keys).all()
    at = blocks.cuts(keys, 7)
    assert at[0] == 0 and at[-1] == len(keys) and len(at) == 8


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert katz.score(spark.createDataFrame([], schema)).collect() == []
    r = katz.score(spark.createDataFrame([(None, "a b")], schema), least=2).first()
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == 0.0
