"""Quality classifier by co-training (operator 7).

Two logistic classifiers see different views of a document: its text (hashed words and the shape of the
writing) and its metadata (source, language, length). Both learn from labelled documents; then, for some
rounds, each labels unlabelled documents that it is sure about for the other one. Their calibrated scores
are combined on labelled documents that neither has learned from. Two properties are learned this way:
quality and toxicity; a document is kept if it is likely good and not likely toxic.

The models are fitted on bounded samples (LABELLED and POOL rows, the smallest hashes of their ids); all
documents are scored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import small_batches

#: Bounds of the samples that models are fitted on, share of labelled rows kept for calibration, rounds.
LABELLED, POOL, CALIBRATION, ROUNDS = 8000, 4000, 0.3, 2
WORD_SPACE, META_SPACE = 1 << 17, 1 << 12
#: Strengths of the penalty to choose from, by the loss on the rows for calibration.
DECAYS = (2e-4, 2e-5)
#: A view labels documents for the other one beyond this calibrated probability of either class.
SURE = 0.97
TARGETS = ("quality", "toxic")

def shape(text: str, words: list[str]) -> list[float]:
    """Traits of the writing, each about 0 to 1."""
    raw = text.encode()
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = max(len(raw) - int(c[128:192].sum()), 1), max(len(words), 1)
    upper, lines = c[65:91].sum(), text.split("\n")
    marks = sum(c[ord(x)] for x in "<>{}[]#@=_\\^~*")
    return [
        upper / n, c[48:58].sum() / n, (c[9:14].sum() + c[32]) / n, (upper + c[97:123].sum() + c[192:].sum()) / n,
        min(1.0, c[33] / k), min(1.0, c[124] / k), min(1.0, marks / k),
        min(1.0, (text.count("...") + text.count("…")) * 4 / k), min(1.0, (c[33] + c[46] + c[63]) * 4 / k),
        len(set(words)) / k, len(set(lines)) / len(lines),
        min(2.0, n / k / 10), min(1.0, max(map(len, words), default=0) / 60), math.log1p(k) / 10, float(k < 5),
    ]


SHAPES = len(shape("", []))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of the text view: words and their beginnings by a hash, weighted by the length, then traits and their squares."""
    text = text or ""
    words = text.lower().split()
    crc, mask = zlib.crc32, WORD_SPACE - 1
    bare = {w.strip(".,;:!?\"'()") for w in set(words)}
    # The beginnings of words stand for families of words, few of which each document shows.
    ids = np.fromiter({crc(w.encode()) & mask for w in bare | {w[:4] + "-" for w in bare}}, np.int32)
    traits = np.array(shape(text, words))
    both = np.concatenate([traits, traits * traits])
    return (np.concatenate([ids, np.arange(WORD_SPACE, WORD_SPACE + 2 * SHAPES, dtype=np.int32)]),
            np.concatenate([np.full(len(ids), 4 / math.sqrt(len(ids) + 16)), both]).astype(np.float32))


TEXT_SPACE = WORD_SPACE + 2 * SHAPES


def metadata(source: object, lang: object, n_chars: object) -> list[int]:
    """Indexes of the metadata view: source, language, length class, and source with language."""
    size = -1 if n_chars is None else int(math.log2(max(int(n_chars), 0) + 1) * 2)
    return [zlib.crc32(repr(x).encode()) & (META_SPACE - 1)
            for x in (("s", source), ("l", lang), ("n", size), ("sl", source, lang))]


@dataclass
class Rows:
    """Sparse rows: row i has index[start[i]:start[i+1]] and the values beside them."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(start[-1]) + np.repeat(self.start[:-1][rows] - start[:-1], size)
        return Rows(start, self.index[at], self.value[at])

    def score(self, w: np.ndarray) -> np.ndarray:
        if len(self.start) == 1:
            return np.empty(0)
        # Every row has some features, as each view has some of its own whatever the document.
        return np.add.reduceat(self.value * w[self.index], self.start[:-1]) + w[-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: Rows, y: np.ndarray, space: int, decay: float, steps: int = 70, rate: float = 0.25) -> np.ndarray:
    """Logistic regression by Adam over all rows; the last weight is the constant."""
    w, m, v = np.zeros(space + 1), np.zeros(space + 1), np.zeros(space + 1)
    row = np.repeat(np.arange(len(y)), np.diff(x.start))
    for t in range(1, steps + 1):
        gap = (sigmoid(x.score(w)) - y) / len(y)
        g = np.bincount(x.index, gap[row] * x.value, minlength=space + 1)
        g[-1] = gap.sum()
        g[:-1] += decay * w[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def calibrated(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights for columns of scores, then a constant; Newton steps with a small ridge."""
    x = np.concatenate([scores, np.ones((len(y), 1))], 1)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    for _ in range(30):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Model:
    """Weights of both views and of their combination; flat is the answer where one class alone was seen."""

    text: np.ndarray | None
    meta: np.ndarray | None
    own: tuple[np.ndarray, np.ndarray] | None
    both: np.ndarray | None
    flat: float

    def predict(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability by text, by metadata, and by both."""
        n = len(text.start) - 1
        if self.text is None:
            return (np.full(n, self.flat),) * 3
        a, b = text.score(self.text), meta.score(self.meta)
        (wa, wb), w = self.own, self.both
        return sigmoid(a * wa[0] + wa[1]), sigmoid(b * wb[0] + wb[1]), sigmoid(a * w[0] + b * w[1] + w[2])


def cotrain(text: Rows, meta: Rows, y: np.ndarray, rounds: int = ROUNDS, seed: int = 1) -> Model:
    """y: 1 or 0, or -1 for rows without a label."""
    rng = np.random.default_rng(seed)
    known, pool = rng.permutation(np.flatnonzero(y >= 0)), np.flatnonzero(y < 0)
    cut = int(len(known) * CALIBRATION)
    held, train = known[:cut], known[cut:]
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
        return Model(None, None, None, None, float(y[known].mean()) if len(known) else 0.5)
    given = {"text": {}, "meta": {}}
    views = {"text": (text, TEXT_SPACE), "meta": (meta, META_SPACE)}
    weights: dict[str, np.ndarray] = {}

    def loss(view: str, decay: float) -> float:
        x, space = views[view]
        scores = x.take(held).score(fit(x.take(train), y[train], space, decay))
        w = calibrated(scores[:, None], y[held])
        p = sigmoid(scores * w[0] + w[1])
        return float(-np.log(np.where(y[held] > 0, p, 1 - p) + 1e-9).mean())

    decay = {view: min(DECAYS, key=lambda d: loss(view, d)) for view in views}
    for r in range(rounds + 1):
        own = {}
        for view, (x, space) in views.items():
            extra = given[view]
            rows = np.concatenate([train, np.fromiter(extra, np.int64, len(extra))]).astype(np.int64)
            labels = np.concatenate([y[train], np.fromiter(extra.values(), np.float64, len(extra))])
            weights[view] = fit(x.take(rows), labels, space, decay[view])
            own[view] = calibrated(x.take(held).score(weights[view])[:, None], y[held])
        if r == rounds or not len(pool):
            break
        for view, other in (("text", "meta"), ("meta", "text")):
            x = views[view][0]
            p = sigmoid(x.take(pool).score(weights[view]) * own[view][0] + own[view][1])
            # As many of each class as its share among the labelled rows allows, the surest first.
            share = y[train].mean()
            for label, sure, part in ((1, p, share), (0, 1 - p, 1 - share)):
                order = np.argsort(-sure, kind="stable")
                order = order[sure[order] >= SURE][: int(len(pool) * part / (rounds + 1)) + 1]
                given[other].update((int(i), label) for i in pool[order] if int(i) not in given[other])
    scores = np.stack([text.take(held).score(weights["text"]), meta.take(held).score(weights["meta"])], 1)
    return Model(weights["text"], weights["meta"], (own["text"], own["meta"]), calibrated(scores, y[held]), 0.5)


def sparse(parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    start = np.concatenate([[0], np.cumsum([len(i) for i, _ in parts])]).astype(np.int64)
    if not parts:
        return Rows(start, np.empty(0, np.int32), np.empty(0, np.float32))
    return Rows(start, np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]))


def views(texts: list, sources: list, langs: list, sizes: list) -> tuple[Rows, Rows]:
    one = np.ones(4, np.float32)
    return (sparse([features(t) for t in texts]),
            sparse([(np.array(metadata(*m), np.int32), one) for m in zip(sources, langs, sizes)]))


def inputs(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("bigint").alias("n_chars"))


def smallest(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """The rows with the smallest hashes of their ids: a sample of at most so many, the same in every run."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, seed: int = 3) -> dict[str, Model]:
    """One model per target. Repeated labels of a document count once, the stricter one; nulls are no label."""
    by_doc = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    chosen = smallest(by_doc.where("quality IS NOT NULL OR toxic IS NOT NULL"), labelled, seed)
    none = F.lit(None).cast("int")
    free = smallest(inputs(docs).select("doc_id").where("doc_id IS NOT NULL").join(by_doc, "doc_id", "left_anti"), pool, seed)
    wanted = chosen.unionByName(free.distinct().select("doc_id", none.alias("quality"), none.alias("toxic")))
    # Both samples are bounded by their parameters, whatever the tables hold.
    sample = inputs(docs).join(F.broadcast(wanted), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            found = [features(t) for t in col["text"]]
            meta = [metadata(*m) for m in zip(col["source"], col["lang"], col["n_chars"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([i for i, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.list_(pa.float32())), pa.array(meta, pa.list_(pa.int32())),
                 batch.column("quality"), batch.column("toxic")], ["doc_id", "i", "v", "meta", "quality", "toxic"])

    table = sample.mapInArrow(run, "doc_id bigint, i array<int>, v array<float>, meta array<int>, quality int, toxic int").toArrow()
    # Rows of one id may come in any order, so ties are put in order by what they hold.
    rows = sorted(range(table.num_rows), key=lambda k: (table["doc_id"][k].as_py(), table["v"][k].as_py()[-2 * SHAPES:]))
    table = table.take(pa.array(rows, pa.int64()))

    def lists(name: str) -> tuple[np.ndarray, np.ndarray]:
        c = table[name].combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        return np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), c.flatten().to_numpy()

    if not table.num_rows:
        return {t: Model(None, None, None, None, 0.5) for t in TARGETS}
    start, index = lists("i")
    text = Rows(start, index, lists("v")[1])
    start, index = lists("meta")
    meta = Rows(start, index, np.ones(len(index), np.float32))
    return {t: cotrain(text, meta, np.array([-1 if v is None else int(v > 0) for v in table[t].to_pylist()], np.float64))
            for t in TARGETS}


def verdicts(models: dict[str, Model], columns: list[list], least: float, most_toxic: float) -> tuple[np.ndarray, ...]:
    """Quality and toxicity, quality by text and by metadata, and whether the document is kept."""
    text, meta = views(*columns)
    by_text, by_meta, quality = models["quality"].predict(text, meta)
    toxic = models["toxic"].predict(text, meta)[2]
    keep = np.ones(len(quality), bool)
    if models["quality"].text is not None:
        keep &= quality >= least
    if models["toxic"].text is not None:
        keep &= toxic < most_toxic
    return quality, toxic, by_text, by_meta, keep


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, most_toxic: float = 0.5, **options: int) -> DataFrame:
    """doc_id, quality_score, toxic_score (probabilities by both views), text_score, meta_score (quality by one
    view) and kept of every row.

    A null or empty text is scored by its traits and metadata; null metadata are values of their own.
    Repeated rows give a row each. Without labels of both classes every score of a target is the share of
    its positive labels, or 0.5 without any; such a target rejects nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = verdicts(shared.value, [part.column(i).to_pylist() for i in range(1, 5)], least, most_toxic)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, found)],
                    ["doc_id", "quality_score", "toxic_score", "text_score", "meta_score", "kept"])

    return inputs(docs).mapInArrow(
        run, "doc_id bigint, quality_score double, toxic_score double, text_score double, meta_score double, kept boolean")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, most_toxic: float = 0.5, **options: int) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = [part.column(n).to_pylist() for n in ("text", "source", "lang", "n_chars")]
                yield part.filter(pa.array(verdicts(shared.value, columns, least, most_toxic)[-1]))

    return docs.mapInArrow(run, docs.schema)
