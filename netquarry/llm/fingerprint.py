"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only (operator 2).

A text is a set of paragraph digests (a line, or each run of WORDS words of a longer one). Each digest
falls into one cell of each of three parts of a table; a cell holds a count, the XOR of its digests and
the XOR of their checks. The table of a fixed size is the fingerprint. Two versions are compared by
subtracting cell from cell, so that common digests vanish; then cells with a single digest left are peeled,
part after part, which frees others, until the digests that differ are recovered. Where some cells stay,
a larger table with other hashes is tried, sized by both texts' digests and growing from try to try; what the
last try leaves is compared set by set, so that the likeness is exact in every row.

Texts are dealt once, by ranges of 256 ids, and turned into their digests and those of their edited texts. The
digests are dealt alike, and every step of a document runs beside the others in the task that holds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import kept, stored, whole

WORDS = 12
#: Cells of the fingerprint, and the steps of peeling of a try (each looks at one third of the table).
CELLS, STEPS = 48, 8
CHECK = 977
#: Bits of an id within its range, and of a range within the next larger one.
SHIFT = 8
PARAGRAPH = rf"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*+){{1,{WORDS}}}"


def digests(text: Column) -> Column:
    """The set of a text's paragraph digests, as 64-bit hashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def cells_of(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows (keys, third, which, d) to rows (keys, third, cell) with count, key and check of versions 0 and 1."""
    at = lambda i: F.lit(i) * F.col("third") + F.pmod(F.xxhash64("d", F.lit(seed * 3 + i)), F.col("third"))
    spread = rows.withColumn("cell", F.explode(F.array(at(0), at(1), at(2)))).withColumn("c", F.xxhash64("d", F.lit(CHECK)))
    one = lambda w, x: F.when(F.col("which") == w, x)
    none = F.lit(0).cast("bigint")
    return spread.groupBy(*keys, "third", "cell").agg(*(
        F.coalesce(f(one(w, x)), none).alias(f"{n}{w}") for w in (0, 1)
        for n, f, x in (("n", F.sum, F.lit(1)), ("key", F.bit_xor, F.col("d")), ("check", F.bit_xor, F.col("c")))))


# code: the row within its range of ids, the pair (0: edited, 1: next), the size of both sets.


def pair_of() -> Column:
    return F.shiftright("code", 32).bitwiseAND(F.lit(1))


def both_of() -> Column:
    return F.col("code").bitwiseAND(F.lit((1 << 32) - 1))


def third_of(attempt: int) -> Column:
    """A third of a try's cells: the fingerprint's at first for an edited text, else what both sets may need."""
    needed = lambda k: F.ceil(both_of() * (0.67 * 2.0**k)).cast("bigint") + 8
    first = F.lit(CELLS // 3).cast("bigint") if attempt == 0 else needed(attempt - 1)
    return F.when(pair_of() == 0, first).otherwise(needed(attempt))


def differing(pairs: DataFrame, attempt: int) -> DataFrame:
    """Rows (bucket, code, a, b: sets of digests) to (bucket, code, found, left): digests in one of the sets
    only that this try recovers, and the cells that it leaves. Equal sets have no row."""
    keys, cell = ["bucket", "code"], F.col("cell")
    third, seed = third_of(attempt), attempt + 1

    def row(at: Column, n: Column, key: Column, check: Column) -> Column:
        return F.struct(at.cast("bigint").alias("cell"), n.cast("bigint").alias("n"), key.alias("key"), check.alias("check"))

    def summed(rows: DataFrame, array: Column) -> DataFrame:
        return (
            rows.select(*keys, F.explode(array).alias("x")).groupBy(*keys, F.col("x.cell").alias("cell"))
            .agg(F.sum("x.n").alias("n"), F.bit_xor("x.key").alias("key"), F.bit_xor("x.check").alias("check"))
            .where("n <> 0 OR key <> 0")
        )

    def spots() -> list[Column]:
        return [F.lit(i) * third + F.pmod(F.xxhash64("key", F.lit(seed * 3 + i)), third) for i in range(3)]

    # The cells of one version less those of the other, cell by cell: what both hold is gone.
    signed = lambda c, n: F.transform(c, lambda d: F.struct(F.lit(n).alias("n"), d.alias("key")))
    rows = pairs.select(*keys, F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("x")).select(
        *keys, "x.*", F.xxhash64("x.key", F.lit(CHECK)).alias("check"))
    rows = summed(rows, F.array(*(row(at, F.col("n"), F.col("key"), F.col("check")) for at in spots())))
    zero = F.lit(0).cast("bigint")
    own = row(cell, F.col("n"), F.col("key"), F.col("check"))
    for step in range(STEPS + 2 * attempt):
        part = step % 3
        pure = (
            (cell >= F.lit(part) * third) & (cell < F.lit(part + 1) * third) & (F.abs("n") == 1)
            & (F.col("check") == F.xxhash64("key", F.lit(CHECK)))
        )
        # Within one third a digest has one cell only, so no digest is taken out twice.
        out = [row(at, -F.col("n"), F.col("key"), F.col("check")) for i, at in enumerate(spots()) if i != part]
        rows = summed(rows, F.when(pure, F.array(row(F.lit(-1), F.lit(1), zero, zero), *out)).otherwise(F.array(own)))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(cell < 0, F.col("n"))), zero).alias("found"), F.count(F.when(cell >= 0, 1)).alias("left"))


def following(keys: DataFrame, high: int) -> DataFrame:
    """Distinct longs k from 0 to high to (k, next), the next larger one, null for the last; in small groups.

    Within a range of 256 numbers the next one is at hand; from the last of a range it is the first of the
    next range that has any, which the same way finds among the ranges.
    """
    w = Window.partitionBy("g").orderBy("k")
    rows = keys.withColumn("g", F.shiftright("k", SHIFT)).withColumn("next", F.lead("k").over(w))
    if high >> SHIFT == 0:
        return rows.select("k", "next")
    firsts = keys.groupBy(F.shiftright("k", SHIFT).alias("g")).agg(F.min("k").alias("first"))
    ranges = following(firsts.select(F.col("g").alias("k")), high >> SHIFT)
    beyond = ranges.join(firsts.withColumnRenamed("g", "next"), "next").select(F.col("k").alias("g"), "first")
    return rows.join(beyond, "g", "left").select("k", F.coalesce("next", "first").alias("next"))


def hexed(cells: Column) -> Column:
    """A table's cells as text: base64 of count, key and half the check of each."""
    wide = lambda x, n: F.right(F.lpad(F.hex(x), 16, "0"), F.lit(n))
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(
        cells, lambda c: F.concat(wide(c["n"], 4), wide(c["key"], 16), wide(c["check"], 8))), ""))), "\r\n", "")


def compare_versions(docs: DataFrame, tries: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text of a document has its last quarter replaced by the beginning of the next document, by
    ascending id (of the last one: the first). likeness: digests in both over digests in either, 1 if
    neither has any. A null text is an empty one. Rows with the same id follow each other by their texts;
    rows without an id stand before all others. Leading white space and blank lines carry no digest.
    """
    none = -(1 << 54)
    base = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), whole(F.col(text)).alias("text"),
        F.coalesce(F.shiftright(F.col(doc_id).cast("bigint"), SHIFT), F.lit(none - 1).cast("bigint")).alias("bucket"))
    ends = base.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    low, high = (ends.low, ends.high) if ends.low is not None else (0, 0)
    # Joins by range and row keep to the dealing by range, as each range is whole in one task.
    docs.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    dealt = base.repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ranges = kept(following(base.select((F.col("bucket") - low).alias("k")).distinct(), high - low)).select(
        (F.col("k") + low).alias("bucket"), (F.coalesce("next", F.lit(0)) + low).alias("next"))

    # The first row of each range goes to the range before it, that of the first range to the last.
    head = dealt.withColumn("r", F.row_number().over(order)).where("r = 1").select(F.col("bucket").alias("next"), F.col("text").alias("beyond"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substr("next", F.lit(1), quarter))
    # Generators of one row, so that the edited text and the digests are made once and not again in each use.
    versions = (
        dealt.withColumn("rid", F.row_number().over(order)).withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn("lead", F.lead("text").over(order)).join(head.join(ranges, "next").select("bucket", "beyond"), "bucket", "left")
        .withColumn("next", F.coalesce("lead", "beyond"))
        .select("bucket", "rid", "doc_id", "n_chars", "text", F.explode(F.array(edited)).alias("edited"))
        .select("bucket", "rid", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"))
    )
    # From here on texts are sets of digests.
    rows = stored(versions)
    own, key = ["bucket", "rid"], ["bucket", "code"]
    sets = rows.select(*own, "a", "e").repartition("bucket")
    beyond = rows.where("rid = 1").select(F.col("bucket").alias("next"), F.col("a").alias("beyond")).join(ranges, "next").select("bucket", "beyond")
    following_a = F.lead("a").over(Window.partitionBy("bucket").orderBy("rid"))
    triples = sets.withColumn("lead", following_a).join(beyond, "bucket", "left").select(
        *own, "a", "e", F.coalesce("lead", "beyond").alias("x"))
    code = lambda p, b: ((F.col("rid") * 2 + p).cast("bigint") * (1 << 32) + F.size("a") + F.size(b)).alias("code")
    two = F.array(*(F.struct(code(p, b), F.col("a").alias("a"), F.col(b).alias("b")) for p, b in ((0, "e"), (1, "x"))))
    pairs = triples.select("bucket", F.explode(two).alias("p")).select("bucket", "p.*")

    def tried(pairs: DataFrame, attempt: int) -> DataFrame:
        """Pairs with what a try finds; those that it leaves keep their digests for the next, larger one."""
        return stored(pairs.join(differing(pairs, attempt), key).select(
            *key, "found", "left", *(F.when(F.col("left") > 0, F.col(c)).alias(c) for c in "ab")))

    state = tried(pairs, 0)
    settled = [state]
    for attempt in range(1, tries):
        failed = settled[-1].where("left > 0")
        if failed.isEmpty():
            break
        settled[-1] = settled[-1].where("left = 0")
        # Dealt once; every step of peeling is within that.
        settled.append(tried(failed.select(*key, "a", "b").repartition("bucket"), attempt))
    # What is still left after the last try is compared set by set.
    rest = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    result = reduce(DataFrame.unionByName, (d.select(
        *key, F.when(F.col("left") > 0, rest).otherwise(F.col("found")).alias("found")) for d in settled))
    missing = F.col("found")
    by_pair = lambda p: F.max(F.when(pair_of() == p, (both_of() - missing) / (both_of() + missing)))
    near = result.groupBy("bucket", F.shiftright("code", 33).cast("int").alias("rid")).agg(
        by_pair(0).alias("near_edited"), by_pair(1).alias("near_next"))

    # The table of fixed size is the fingerprint.
    both = F.array(*(F.struct(F.lit(i).alias("which"), F.col(c).alias("set")) for i, c in enumerate("ae")))
    listed = sets.select(*own, F.explode(both).alias("v")).select(*own, "v.which", F.explode("v.set").alias("d"))
    table = cells_of(listed.withColumn("third", F.lit(CELLS // 3).cast("bigint")), own, 1)
    cell = lambda w: F.array_sort(F.collect_list(F.when(F.col(f"n{w}") > 0, F.struct(
        "cell", F.col(f"n{w}").alias("n"), F.col(f"key{w}").alias("key"), F.col(f"check{w}").alias("check")))))
    prints = table.groupBy(*own).agg(cell(0).alias("f0"), cell(1).alias("f1"))

    def filled(c: str) -> Column:
        at = F.map_from_arrays(F.transform(c, lambda x: x["cell"]), F.col(c))
        empty = F.struct(F.lit(0).cast("bigint").alias("cell"), *(F.lit(0).cast("bigint").alias(k) for k in ("n", "key", "check")))
        full = F.transform(F.expr(f"sequence(0L, {CELLS - 1}L)"), lambda i: F.coalesce(F.try_element_at(at, i), empty))
        return F.when(F.size(c) > 0, hexed(full)).otherwise(F.lit(""))

    return (
        rows.select(*own, "doc_id", "n_chars", "edited_sha256")
        .join(prints, own, "left").join(near, own, "left")
        .select("doc_id", "n_chars", "edited_sha256",
                F.coalesce(filled("f0"), F.lit("")).alias("fingerprint"), F.coalesce(filled("f1"), F.lit("")).alias("edited_fingerprint"),
                # Pairs with equal sets, also with empty ones, have no difference to show.
                F.coalesce("near_edited", F.lit(1.0)).alias("near_edited"), F.coalesce("near_next", F.lit(1.0)).alias("near_next"))
    )
