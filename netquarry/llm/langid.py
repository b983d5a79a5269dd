"""Language of texts by string kernels (operator 12).

A text is the set of its strings of one, two and three code points (lower-case letters, one blank for whatever
lies between words). The blended-spectrum presence kernel of two texts is the number of strings that both have,
divided by the root of the product of their numbers. A bounded sample of landmark texts spans the kernel's
feature space (Nystroem); kernel ridge regression in that span gives one scorer per language against the rest.
Scoring multiplies a batch of texts by the landmarks, and the result by the scorers' weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from netquarry.llm.common import small_batches

#: The sample to learn from: rows in all, and code points of the longest text that may be in it.
LABELLED, LONGEST = 2000, 20_000
#: Texts that span the feature space, weight of the ridge, longest string, texts of one matrix product.
LANDMARKS, RIDGE, ORDER, TOGETHER = 128, 1e-4, 3, 256
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bits of a code point in the key of a string, and code points cut at a time.
POINT, SLICE = 21, 1 << 20


def grams(text: str | None, order: int = ORDER) -> np.ndarray:
    """Keys of the distinct strings of one to `order` (at most three) code points, in order; none without a letter."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found = []
    for at in range(0, len(points), SLICE):
        part = points[at: at + SLICE + order - 1].astype(np.uint64)
        keys = [part[:SLICE]]
        for n in range(1, order):
            keys.append(keys[-1][: max(0, len(part) - n)] | part[n: n + len(keys[-1])] << np.uint64(POINT * n))
        found.append(np.unique(np.concatenate(keys)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class Model:
    """Languages; the landmarks' strings; which landmark has which (bits); weight of a landmark for a language."""

    langs: list[str]
    strings: np.ndarray
    bits: np.ndarray
    weights: np.ndarray

    def unpacked(self) -> np.ndarray:
        """Strings by landmarks, each landmark divided by its length."""
        has = np.unpackbits(self.bits, axis=1, count=len(self.weights)).astype(np.float32)
        return has / np.sqrt(np.maximum(has.sum(0), 1))


def kernel(sets: list[np.ndarray], strings: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Texts by landmarks: shares of common strings, batch by batch as one matrix product."""
    out = np.zeros((len(sets), landmarks.shape[1]), np.float32)
    for at in range(0, len(sets), TOGETHER):
        part = sets[at: at + TOGETHER]
        has = np.zeros((len(part), len(strings)), np.float32)
        for row, own in zip(has, part):
            if len(own) and len(strings):
                place = np.minimum(np.searchsorted(strings, own), len(strings) - 1)
                row[place[strings[place] == own]] = 1 / np.sqrt(len(own))
        out[at: at + len(part)] = has @ landmarks
    return out


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Regression on targets 1 and -1. The first texts of every language in turn become landmarks."""
    names = sorted(set(langs))
    sets = [grams(t) for t in texts]
    seen: dict[str, int] = {}
    turn = []
    for i, name in enumerate(langs):
        seen[name] = seen.get(name, -1) + 1
        turn.append((seen[name], names.index(name), i))
    chosen = [sets[i] for _, _, i in sorted(turn)[:landmarks]]
    strings = np.unique(np.concatenate([np.empty(0, np.uint64), *chosen]))
    has = np.stack([np.isin(strings, own, assume_unique=True) for own in chosen], 1) if chosen else np.zeros((0, 0), bool)
    model = Model(names, strings, np.packbits(has, axis=1), np.zeros((len(chosen), len(names))))
    if not len(strings):
        return model
    span = model.unpacked()
    among = kernel(chosen, strings, span).astype(np.float64)
    own = kernel(sets, strings, span).astype(np.float64)
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many texts of the sample it has.
    share = np.array([1 / langs.count(n) for n in langs])[:, None]
    left = own.T @ (share * own) + ridge * len(names) * (among + among.T) / 2 + 1e-9 * np.eye(len(chosen))
    model.weights = np.linalg.solve(left, own.T @ (share * target))
    return model


def part_of(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 4."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4))


def sample(docs: DataFrame, labelled: int = LABELLED, longest: int = LONGEST, seed: int = 7) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from, the same in every run: rows whose remainder is not 2, of every language alike.

    In each language rows go by a hash of their id; repeated rows count once. At most `labelled` rows, of at most
    `longest` code points each, come to the driver.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
    ).where((part_of() != 2) & F.col("lang").isNotNull() & (F.length("text") <= longest) & F.col("text").rlike(r"\p{L}"))
    marked = rows.withColumn("digest", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "digest")
    keys = marked.select("lang", F.xxhash64("doc_id", F.lit(seed)).alias("place"), "doc_id", "digest")
    first = keys.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= 2 * labelled)
    first = first.dropDuplicates(["lang", "doc_id", "digest"])
    first = first.orderBy("turn", "lang").limit(labelled)
    # At most `labelled` rows of numbers, whatever the tables hold.
    texts = marked.join(F.broadcast(first), ["lang", "doc_id", "digest"]).dropDuplicates(["lang", "doc_id", "digest"])
    found = sorted(texts.select("turn", "lang", "text").toArrow().to_pylist(), key=lambda r: (r["turn"], r["lang"], r["text"]))
    return [r["text"] for r in found], [r["lang"] for r in found]


def predict(docs: DataFrame, labelled: int = LABELLED, longest: int = LONGEST, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text, mod 4, is 2), lang_pred and score (0 to 1) of every row.

    The language comes from the whole text alone. A text that is null or has no letter gets `und` and score 0, and so
    do all texts where there is nothing to learn from. The score is the winning scorer's value, -1 to 1 moved to 0 to 1;
    of equal scorers the first language wins. A row without an id is not held out, and nothing is learned from it.
    Repeated rows give a row each. Languages are learned as they are written; null ones are not learned.
    """
    texts, langs = sample(docs, labelled, longest)
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts, langs, landmarks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        span = model.unpacked()
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            sets = [grams(t) for t in batch.column(2).to_pylist()]
            best = np.full(len(sets), len(model.langs))
            score = np.zeros(len(sets))
            some = np.array([len(s) > 0 for s in sets], bool)
            if len(model.strings) and some.any():
                values = kernel([s for s in sets if len(s)], model.strings, span) @ model.weights
                best[some] = values.argmax(1)
                score[some] = np.clip((values.max(1) + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(part_of() == 2, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
