"""Spelling variants by a relational trie frontier (operator 11).

The words lie in a trie that is a table of edges (node, label, child). A state (word, position, node, edits) has
read the word up to its position and stands at a node. Words without an edit stand on their own path, so all such
states start at once, at every node where the trie branches: there a word either replaces its next code point by
that of another edge or skips it. States with one edit then follow edges whose label goes on as their word does,
level by level, by joins with the edge table; a state that ends at a leaf has found a neighbour.

An edit lies in the second half of a word or in the first half. One trie therefore holds the words and serves the
former, one holds the reversed words and serves the latter, both only from the middle of a word on, where nodes have
few edges. Prefixes that lead to one node are equal by 64-bit hashes.

Every table here grows with the words, and Catalyst sizes a table of paths, exploded forks or short Parquet columns at
a small part of what its rows take in memory. All joins are therefore merged by hint and none is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import small_batches, stored
from netquarry.llm.simhash import LOWER

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a code point.
TYPO = 97
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 20
MASK = (1 << 64) - 1


def tally(docs: DataFrame, least: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of at least so many code points in whole texts, after the rule that makes typing errors."""
    run_ = re.compile(f"{RUN.pattern[:-1]}{{{max(least, 1)},}}")

    def words(i: object, text_: str) -> Iterator[str]:
        start = crc32(f"{'' if i is None else i}:".encode())
        for w in run_.findall(text_.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")):
            h = crc32(w.encode(), start)
            if h % TYPO:
                yield w
            elif len(w) > least:
                at = h % len(w)
                yield w[:at] + w[at + 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    count.update(words(i, t))
            if len(count) > HELD:
                yield packed(count)
                count = Counter()
        yield packed(count)

    def packed(count: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["word", "n"])

    rows = small_batches(docs).select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def path(word: str, way: int) -> list[tuple[int, int, int]]:
    """(depth, node, next code point or 0 at the end) from the middle of a word on."""
    node, half, out = way, (len(word) + way) // 2, []
    for depth, point in enumerate([*map(ord, word), 0]):
        if depth >= half:
            out.append((depth, node - (1 << 64) if node >> 63 else node, point))
        node = (node * 0x9E3779B97F4A7C15 + point + 0x1D8E4E27C47D124F) & MASK
        node ^= node >> 29
    return out


def places(words: DataFrame) -> DataFrame:
    """id, way, depth, node, point: the paths of all words (way 0) and of all reversed words (way 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for way, spelled in ((0, w), (1, w[::-1])):
                    rows += [(i, way, *p) for p in path(spelled, way)]
                if len(rows) > 100_000:
                    yield table(rows)
                    rows = []
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int8(), pa.int32(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "way", "depth", "node", "point"])

    return words.select("id", "word").mapInArrow(run, "id bigint, way tinyint, depth int, node bigint, point int")


def forks(words: DataFrame) -> DataFrame:
    """way, spelled (word or reversed word), n, at: its nodes with several edges, by depth, as (depth, node)."""
    all_ = places(words)
    several = all_.groupBy("node").agg(F.min("point").alias("a"), F.max("point").alias("b")).where("a <> b").select("node")
    own = all_.join(several.hint("merge"), "node").groupBy("id", "way").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("at"))
    return own.join(words.hint("merge"), "id").select("way", turned(F.col("word")).alias("spelled"), "n", "at")


def turned(text: Column) -> Column:
    """A word as its trie spells it, or back."""
    return F.when(F.col("way") == 0, text).otherwise(F.reverse(text))


def piece(text: Column, start: Column, length: Column | None = None) -> Column:
    """Code points from a place counted from 0."""
    return F.substring(text, start + 1, F.lit(1 << 30) if length is None else length)


def edges(own: DataFrame) -> DataFrame:
    """node, label (empty where a word ends), and the child or the leaf's n; in the partitions of its nodes."""
    after = F.expr("get(at, i + 1)")
    here = own.select("spelled", "n", "at", F.posexplode("at").alias("i", "here"))
    size = F.coalesce(after["depth"], F.length("spelled")) - F.col("here.depth")
    rows = here.select(
        F.col("here.node").alias("node"), piece(F.col("spelled"), F.col("here.depth"), size).alias("label"),
        after["node"].alias("child"), F.when(after["node"].isNull(), F.col("n")).alias("leaf_n"))
    return rows.repartition("node").distinct()


def neighbours(words: DataFrame, levels: int = 3) -> DataFrame:
    """a, a_n, b, b_n: every pair of words one edit apart, once, in some order. words: word, n, without repeats.

    A state is (way, spelled, n, target, pos, node): the word, the word that its edit makes of it, and how far that
    has been read. So many levels are joined at once before the states are written down.
    """
    numbered = stored(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    own = stored(forks(numbered))
    trie = stored(edges(own))
    ahead = trie.select(F.col("node").alias("key"), "label", "child", "leaf_n").hint("merge")
    pos, spelled, target = F.col("pos"), F.col("spelled"), F.col("target")
    reads = (piece(target, pos, F.length("label")) == F.col("label")) & (
        # An edge to a leaf must end with the word.
        F.col("child").isNotNull() | (F.length(target) == pos + F.length("label")))
    state = ["way", "spelled", "n", "target", "pos", "node", "target_n"]
    moved = [(pos + F.length("label")).alias("pos"), F.col("child").alias("node")]

    # Words without an edit stand at every fork of their paths. There the next code point is replaced by a larger
    # one, so that a pair is met from one side only, or skipped, where the one after it differs from it.
    size, half = F.length(spelled), F.expr("length(spelled) div 2")
    start = own.select("way", "spelled", "n", F.explode("at").alias("here")).select(
        "way", "spelled", "n", F.col("here.depth").alias("pos"), F.col("here.node").alias("key"))
    here, next_ = piece(spelled, pos, F.lit(1)), piece(spelled, pos + 1, F.lit(1))
    head, first = F.substring(spelled, F.lit(1), pos), F.substring("label", 1, 1)
    # A word without one of several equal code points is met at the last of them: by the first trie if that is in
    # the second half, else by the other one.
    twice = (F.col("way") == 1) & (F.replace(piece(spelled, size - 1 - half, pos - size + half + 2), here, F.lit("")) == "")
    edited = F.array(
        F.when(first > here, F.concat(head, first, piece(spelled, pos + 1))),
        F.when((first == next_) & ~twice, F.concat(head, piece(spelled, pos + 1))))
    front = start.where(here != "").join(ahead, "key").where((first != here) & ((first > here) | (first == next_)))
    front = front.withColumn("target", F.explode(edited)).where(target.isNotNull() & reads)
    front = front.select("way", "spelled", "n", "target", *moved, F.col("leaf_n").alias("target_n"))

    def follow(front: DataFrame) -> DataFrame:
        """One level further. What has arrived goes along, by keys of its own."""
        on = front.withColumn("key", F.coalesce("node", F.xxhash64("spelled", "target")))
        same = (on["key"] == ahead["key"]) & on["node"].isNotNull() & reads
        joined = on.join(ahead, same, "left").where("node IS NULL OR label IS NOT NULL")
        going = F.col("label").isNotNull()
        return joined.select(
            "way", "spelled", "n", "target", F.when(going, moved[0]).otherwise(pos).alias("pos"),
            moved[1], F.coalesce("target_n", "leaf_n").alias("target_n"))

    found = []
    while True:  # Labels are not empty, so every level brings states nearer to their words' ends.
        front = stored(reduce(lambda f, _: follow(f), range(levels - 1 if not found else levels), front).select(state))
        found.append(front.where("node IS NULL"))
        front = front.where("node IS NOT NULL")
        if front.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).select(
        turned(spelled).alias("a"), F.col("n").alias("a_n"), turned(target).alias("b"), F.col("target_n").alias("b_n"))


def last(forms: DataFrame) -> DataFrame:
    """word, root of every row of forms (word, form): where the chain of forms ends. Each round doubles the steps."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        after = stored(after)
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, shortest: int = 5, seldom: int = 3, times: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word of at least `shortest` code points and `seldom` occurrences.

    Words are runs of ASCII letters and U+00C0 to U+00FF, A-Z in lower case; one in 97 loses a code point by a rule
    over the document's id. Words are near at one inserted, deleted or replaced code point. The form is the near
    word of largest n (of equal ones the smallest), if that is at least `times` (over 1) the word's own; else null.
    root ends the chain of forms. Null and empty texts hold no words; a null id counts as an empty one in the
    rule; repeated rows count again. Words of any length take part.
    """
    if times <= 1:
        raise ValueError("chains of forms end only if a form is more frequent than the word")
    words = stored(tally(docs, shortest, doc_id, text).where(F.col("n") >= seldom))
    pairs = neighbours(words)
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )).alias("s")).select("s.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    around = stored(sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"), best.alias("best")).select(
        "word", "n_near", F.when(-F.col("best.less") >= times * F.col("n"), F.struct(
            F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")).select("word", "n_near", "f.form", "f.form_n"))
    roots = last(around.where("form IS NOT NULL"))
    return words.join(around.join(roots.hint("merge"), "word", "left").hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
