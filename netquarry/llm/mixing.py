"""Mixing sources to target weights by systematic sampling, in DataFrame operations only (operator 1).

Documents of a source stand in a fixed order: by size, then by a hash of their id. Each has the same
expected number of copies, its source's rate; with the prefix sum of these and one offset per source, a
document is emitted once for every whole number its interval crosses. As the order is by size, the words
taken come near the target, within about the size of the source's largest document.

The prefix sum is hierarchical: the digits of a document's place (size class, finer size, two digits of
the hash) form a tree whose nodes have few children, so no task holds a source, a size or a group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import WORD, kept, whole

WEIGHTS = (5, 2, 1)
MOST = 3
#: Digits of a document's place; each but the first has at most 256 values, the first about 8 per octave.
DIGITS = ("__class", "__fine", "__h1", "__h2")
SRC, SIZE, HASH = "__src", "__size", "__hash"


def placed(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """docs with a source key in the order of sources, its size in words, and the digits of its place."""
    size = F.regexp_count(whole(F.col(text)), F.lit(WORD)).cast("bigint")
    octave = F.log2(F.col(SIZE)) * 8
    return (
        # A generator of one row, so that the words are counted once and not again in each digit.
        docs.select("*", F.explode(F.array(size)).alias(SIZE))
        .withColumn(SRC, F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string"))))
        .withColumn(HASH, F.xxhash64(F.col(doc_id), F.lit(seed)))
        .withColumn(DIGITS[0], F.when(F.col(SIZE) == 0, -1).otherwise(F.floor(octave)).cast("int"))
        .withColumn(DIGITS[1], F.when(F.col(SIZE) == 0, 0).otherwise(F.floor((octave - F.floor(octave)) * 64)).cast("int"))
        .withColumn(DIGITS[2], F.pmod(HASH, F.lit(256)).cast("int"))
        .withColumn(DIGITS[3], F.pmod(F.shiftright(HASH, 8), F.lit(256)).cast("int"))
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Target words of each source, from rows (SRC, words): its share of all words by weight, at most `most`
    times its own, the excess reshared by weight.

    That is least(most * words, level * weight), where the level makes the targets add up: sources fill in
    the order of most * words / weight, and the level is what the rest share once the filled ones are out.
    One row per source, in one task: the table is as long as the list of sources.
    """
    order = Window.orderBy(SRC)
    fill = Window.orderBy("__ratio", SRC)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("words") * float(most)
    level = (F.sum("words").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("__weight").over(onward)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    return (
        sizes.withColumn("__weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn))
        .withColumn("__ratio", cap / F.col("__weight"))
        .withColumn("__level", level)
        .withColumn("__level", F.first(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level")), True).over(everything))
        .select(SRC, F.col("words").alias("source_size"),
                F.when(F.col("__level").isNull(), cap).otherwise(F.least(cap, F.col("__level") * F.col("__weight"))).alias("target"))
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The table with size, source_size, target and copies (how often the mix takes the document).

    A null text has size 0, a null source is a source of its own, after all others; documents without
    words are taken at the rate of the rest and add nothing; a source without words has target 0 and
    copies 0. Rows with the same id count as documents of their own. Input columns with the names of new
    ones are replaced. The same rows give the same copies, in any partitioning.
    """
    new = ("size", "source_size", "target", "copies")
    rows = placed(docs.drop(*(set(new) - {doc_id, text, source})), doc_id, text, source, seed)
    # Kept, as each level of the tree reads it again.
    cells = kept(rows.groupBy(SRC, *DIGITS).agg(F.count(F.lit(1)).alias("n"), F.sum(SIZE).alias("words")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(SRC, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    by_source = targets(cells.groupBy(SRC).agg(F.sum("words").alias("words")), weights, most)
    start = by_source.select(SRC, "source_size", "target", rate.alias("__rate"), offset.alias("__offset"),
                             F.lit(0).cast("bigint").alias("__start"))
    carried = ("source_size", "target", "__rate", "__offset")
    for depth, digit in enumerate(DIGITS):
        keys = [SRC, *DIGITS[:depth]]
        node = cells.groupBy(*keys, digit).agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        node = node.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        start = node.join(start, keys).select(
            *keys, digit, *carried, (F.col("__start") + F.col("__before")).alias("__start"))
    place = F.col("__start") + F.row_number().over(Window.partitionBy(SRC, *DIGITS).orderBy(HASH, doc_id))

    def crossed(upto: Column) -> Column:
        return F.floor(F.col("__offset") + F.col("__rate") * upto)

    copies = F.least(crossed(F.col("__place")) - crossed(F.col("__place") - 1), F.ceil("__rate"))
    return (
        rows.join(start, [SRC, *DIGITS])
        .withColumn("__place", place)
        .withColumn("copies", copies.cast("bigint"))
        .withColumn("size", F.col(SIZE))
        .drop(SRC, SIZE, HASH, *DIGITS, "__rate", "__offset", "__start", "__place")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs."""
    return (
        mix(docs, **options)
        .where("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, copies)"))).select(*docs.columns)
    )
