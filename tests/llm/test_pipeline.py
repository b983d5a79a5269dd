"""The pipeline stage by stage against plain computations."""

import hashlib
import random
from array import array
from collections import Counter

import pytest

import corpus_pipeline
from netquarry.llm import mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(3000)]
    rows, labels, bases = [], [], []
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(rng.randint(60, 160))]
        kind = rng.random()
        if kind < 0.2:
            words = [w.upper() + "!!" for w in words]
        elif kind < 0.3:
            words[5] = "x%d@mail.example" % i
        text = " ".join(words)
        labels.append((i, int(kind >= 0.2), 0))
        rows.append((i, text, "en", rng.choice(["a", "a", "a", "b", None]), len(text), "e"))
        if kind >= 0.3:
            bases.append(i)
    for k, i in enumerate(bases[:60]):
        words = rows[i][1].split()
        if k % 2:
            words[len(words) // 2] = "changed"
        text = " ".join(words)
        rows.append((1000 + k, text, "en", "b", len(text), None))
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "a", 0, ""), rows[bases[100]], rows[bases[100]]]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, rows, bases


def jaccard(a, b, k=5):
    sets = [{tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stages(spark, tables, tmp_path):
    where, rows, bases = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, where)
        assert k == 4 or out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    quality, single, clean, mixed, ids = seen
    names = {r.doc_id for r in quality}
    junk = {r[0] for r in rows if r[1] and r[1].isupper()} | {r[0] for r in rows if r[1] and "!!" in r[1]}
    assert len(names & junk) <= 2 and len(set(bases) - names) <= 2
    # Copies of a document that stayed are gone; no two that stayed are close; every document has one close to it.
    left = {r.doc_id: r.text or "" for r in single}
    assert len(left) == len(single)
    assert not {1000 + k for k, i in enumerate(bases[:60]) if i in left and k % 2 == 0} & set(left)
    assert len({1000 + k for k in range(1, 60, 2)} & set(left)) < 15
    for r in quality:
        assert r.doc_id in left or any(jaccard(r.text or "", t) >= 0.8 for i, t in left.items() if i < r.doc_id)
    # Masks, where personal data were.
    for r in clean:
        assert "@mail" not in (r.text or "") and (r.n_chars == (len(r.text) if r.text is not None else r.n_chars))
    plain = {r.doc_id: r for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    assert Counter(r.doc_id for r in mixed) == {i: r.copies for i, r in plain.items() if r.copies}
    want = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed)
    assert Counter((r.doc_id, r.decoded_sha256) for r in ids) == want
    for r in ids:
        assert r.n_tokens == len(r.token_ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", r.token_ids).tobytes()).hexdigest()


def test_run_gives_the_same(spark, tables):
    where, _, _ = tables
    out = corpus_pipeline.run(spark, where)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert out.count() > 100


def test_close_documents_are_found(spark):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(5000)]
    rows, groups = [], 0
    for g in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(100, 500))]
        for c in range(2):
            w = list(words)
            for _ in range(c * len(w) // 60):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((g * 10 + c, " ".join(w)))
        groups += jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    stay = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(jaccard(a[1], b[1]) >= 0.8 and b[0] not in stay for a, b in zip(rows[::2], rows[1::2]))
    assert {a[0] for a in rows[::2]} <= stay and caught >= 0.7 * groups > 50


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.one_of_each(empty).collect() == []


def stays(rows):
    """Ids that brute force over all pairs of texts keeps: the smallest of each component."""
    root = {i: i for i, _ in rows}
    for n, (i, a) in enumerate(rows):
        for j, b in rows[n + 1:]:
            if root[i] != root[j] and jaccard(a, b) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i for i in root if root[i] == i}


def test_links_hidden_behind_a_far_head_are_found(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        # The same distinct words: one in another order, and two near copies of that.
        plain = ["g%dw%d" % (g, i) for i in range(300)]
        other = rng.sample(plain, len(plain))
        swapped = list(other)
        swapped[20], swapped[200] = swapped[200], swapped[20]
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((plain, other, swapped))]
    # A template with over eight fillings, each of which has a near copy that is no copy of the others.
    frame = ["t%d" % i for i in range(120)]
    for f in range(12):
        own = ["f%dw%d" % (f, i) for i in range(60)]
        copy = list(own)
        copy[30] = "changed"
        rows += [(len(rows) + k, " ".join(frame + w)) for k, w in enumerate((own, copy))]
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == stays(rows)


def components_of(nodes, links):
    root = {i: i for i in nodes}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    return root


def apart(spark, texts, comp, block=256):
    marks = [(i, bytearray(simhash.traits(t, 5, 128))) for i, t in texts]
    table = spark.createDataFrame(texts, "node long, text string")
    roots = spark.createDataFrame(list(comp.items()), "node long, component long")
    shared = spark.createDataFrame([(1, i) for i, _ in texts], "key long, node long")
    found = simhash.apart(shared, roots, spark.createDataFrame(marks, "node long, least binary"), table, 5, 0.8, 0.66, 0.94, block=block)
    return [(r.a, r.b) for r in found.collect()]


def test_groups_in_blocks_are_joined_like_all_pairs(spark):
    rng = random.Random(3)
    bases = [["b%dw%d" % (b, i) for i in range(200)] for b in range(8)]
    texts = []
    for i in range(70):
        words = list(rng.choice(bases))
        for k in rng.sample(range(200), rng.choice([0, 1, 3, 4, 5, 6])):
            words[k] = "c%dw%d" % (rng.randrange(3), k)
        texts.append((i, " ".join(words)))
    comp = {i: 0 for i in range(0, 70, 9)}
    given = [(0, i) for i in comp]
    close = [(i, j) for i, a in texts for j, b in texts if i < j and jaccard(a, b) >= 0.8]
    want = components_of(range(70), given + close)
    assert 8 <= len(set(want.values())) < 60
    for block in (4, 256):
        got = apart(spark, texts, comp, block)
        assert all(jaccard(texts[a][1], texts[b][1]) >= 0.8 for a, b in got)
        assert components_of(range(70), given + got) == want


def test_a_template_gives_no_more_edges_than_texts(spark):
    rng = random.Random(5)
    frame = ["t%d" % i for i in range(200)]
    for n in (100, 200, 400):
        # Fillings share some 0.6 to 0.8 of their shingles, which the least hashes cannot tell from 0.8.
        texts = [(i, " ".join(frame + ["f%dw%d" % (i, k) for k in range(rng.randint(24, 48))])) for i in range(n)]
        got = apart(spark, texts, {})
        close = [(i, j) for i, a in texts[:60] for j, b in texts[:60] if i < j and jaccard(a, b) >= 0.8]
        assert len(got) < n
        root = components_of(range(n), got)
        assert all(root[i] == root[j] for i, j in close) and all(jaccard(texts[a][1], texts[b][1]) >= 0.8 for a, b in got)


def test_the_share_of_shingles_is_exact(spark):
    rng = random.Random(6)
    rows, near, far = [], 0, 0
    for g in range(300):
        words = ["g%dw%d" % (g, i) for i in range(rng.randint(80, 300))]
        other = list(words)
        for k in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.015, 0.035)))):
            other[k] = "changed%d" % k
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        share = jaccard(rows[-2][1], rows[-1][1])
        near, far = near + (0.8 <= share < 0.84), far + (0.76 < share < 0.8)
    assert near > 20 and far > 20
    got = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i for i, _ in rows} - {b[0] for a, b in zip(rows[::2], rows[1::2]) if jaccard(a[1], b[1]) >= 0.8}
    assert got == want


def test_fingerprints_within_three_bits_are_asked_about(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for g in range(40):
        words = ["g%dw%d" % (g, rng.randrange(10 ** 6)) for _ in range(600)]
        other = list(words)
        other[rng.randrange(600)] = "changed"
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((words, other))]
    fp = {i: simhash.simhash(t, 3) for i, t in rows}
    table = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fp.items()], "node long, fp long")
    close = {(i, j) for i in fp for j in fp if i < j and (fp[i] ^ fp[j]).bit_count() <= 3}
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.balls(table).collect()}
    assert len(close) > 25 and got <= close
    assert components_of(fp, got) == components_of(fp, close)
    # With no runs in common and so nothing but fingerprints, just these pairs come together.
    monkeypatch.setattr(simhash, "bands", lambda least: simhash.np.random.default_rng().integers(0, 1 << 63, (len(least), 1), dtype=simhash.np.uint64))
    stay = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(fp) - stay == {max(p) for p in close}


def test_a_large_group_goes_to_few_cells(spark, monkeypatch):
    rng = random.Random(13)
    frame = ["t%d" % i for i in range(40)]
    texts = [(i, " ".join(frame + ["f%dw%d" % (i, k) for k in range(rng.randint(20, 40))])) for i in range(300)]
    sent, plain = [], simhash.by_cell

    def counted(rows, decide):
        sent.append(rows.count())
        return plain(rows, decide)

    monkeypatch.setattr(simhash, "by_cell", counted)
    got = apart(spark, texts, {i: 0 for i in range(0, 300, 3)}, block=4)
    assert sent[0] <= 2 * simhash.SIDES * len(texts) and len(got) < 300


@pytest.mark.parametrize("portion", [1, 50, 1 << 20])
def test_a_forest_in_portions_joins_the_same(monkeypatch, portion):
    monkeypatch.setattr(simhash, "PORTION", portion)
    rng = simhash.np.random.default_rng(14)
    least = rng.integers(0, 2, (60, 16)).astype(simhash.np.uint32)
    share = [[(x == y).mean() for y in least] for x in least]
    holds = lambda x, y: (x * 7 + y * 7) % 5 == 0
    edges, _ = simhash.forest(simhash.np.arange(60), least, 0.6, 0.85, holds)
    want = [(x, y) for x in range(60) for y in range(x + 1, 60) if share[x][y] >= 0.85 or share[x][y] >= 0.6 and holds(x, y)]
    assert components_of(range(60), edges) == components_of(range(60), want)


def test_a_pair_is_in_doubt_at_one_of_its_keys_only(spark, monkeypatch):
    rng = random.Random(15)
    frame = ["t%d" % i for i in range(150)]
    texts = [(i, " ".join(frame + ["f%dw%d" % (i, k) for k in range(34)])) for i in range(40)]
    texts += [(100 + i, t + " more%d" % i) for i, t in rng.sample(texts, 10)]
    marks = [(i, bytearray(simhash.traits(t, 5, 128))) for i, t in texts]
    least = {i: simhash.np.frombuffer(bytes(m), simhash.np.uint32) for i, m in marks}
    keys = {i: simhash.bands(x[None])[0].view(simhash.np.int64).tolist() for i, x in least.items()}
    sent, plain = [], simhash.by_cell

    def counted(rows, decide):
        sent.append((rows.count(), rows.columns))
        return plain(rows, decide)

    monkeypatch.setattr(simhash, "by_cell", counted)
    roots = spark.createDataFrame([], "node long, component long")
    shared = spark.createDataFrame([(k, i) for i, own in keys.items() for k in own], "key long, node long")
    table = spark.createDataFrame(texts, "node long, text string")
    got = [(r.a, r.b) for r in simhash.apart(shared, roots, spark.createDataFrame(marks, "node long, least binary"), table, 5, 0.8, 0.66, 0.94).collect()]
    run = {(i, j): set(keys[i]) & set(keys[j]) for i in keys for j in keys if i < j}
    close = [(i, j) for (i, j), k in run.items() if k and jaccard(dict(texts)[i], dict(texts)[j]) >= 0.8]
    assert len(close) >= 10 and components_of(keys, got) == components_of(keys, close)
    # Members that pairs in doubt would send to every key that they share, and to their first one.
    doubt = [p for p, k in run.items() if k and 0.66 <= (least[p[0]] == least[p[1]]).mean() < 0.94]
    every = {(k, x) for p in doubt for k in run[p] for x in p}
    first = {(next(k for k in keys[p[0]] if k in run[p]), x) for p in doubt for x in p}
    # A key has a cell of its rest and one of the rest and the base.
    assert len(first) < 0.7 * len(every) and sent[1][0] <= 2 * len(first)
    assert "least" not in sent[1][1]
