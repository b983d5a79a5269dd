"""Held-out accuracy and the cases at the edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquarry.llm import cotrain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def corpus(n=3000):
    rng = random.Random(9)
    vocab = ["w%d" % i for i in range(2000)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.15
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[3] = rng.choice(["nastyword", "vileword"])
        text = " ".join(words)
        rows.append((i, text, rng.choice(["en", "de", None]), "junk" if bad and rng.random() < 0.8 else "web", len(text), "x"))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_repeatability(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels[:1500], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotrain.classify(docs, known, labelled=1200, pool=600).collect()}
    assert len(got) == len(rows)
    for i, name in ((1, "quality_score"), (2, "toxic_score")):
        hit = [(got[x[0]][name] >= 0.5) == bool(x[i]) for x in labels[1500:]]
        assert np.mean(hit) > 0.95, name
    assert all(r.kept == (r.quality_score >= 0.5 and r.toxic_score < 0.5) for r in got.values())
    kept = cotrain.accepted(docs, known, labelled=1200, pool=600)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.kept}
    again = cotrain.classify(docs.repartition(5), known, labelled=1200, pool=600).collect()
    assert all(r == got[r.doc_id] for r in again)


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    y = (rng.random(1200) < 0.5).astype(float)
    texts = ["good kind words" if a else "BAD!! BAD!!" for a in y]
    text, meta = cotrain.views(texts, ["s%d" % a for a in y], [None] * 1200, [None] * 1200)
    seen = y.copy()
    seen[60:] = -1
    model = cotrain.cotrain(text, meta, seen)
    for p in model.predict(text, meta):
        assert ((p >= 0.5) == y).mean() > 0.99


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None), (1, 1, None), (2, 1, 0), (2, 1, 0), (None, 0, 1)]])
def test_edges(spark, labels):
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (2, "", "en", "s", 0, "b"), (None, "x " * 90_000, "", "", -4, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = cotrain.classify(docs, table).collect()
    assert len(got) == 4 and all(r.kept and 0 <= r.quality_score <= 1 for r in got)
    assert cotrain.accepted(docs, table).count() == 4
    assert cotrain.classify(docs.where("false"), table).collect() == []
    assert docs.where(F.lit(True)).count() == 4
