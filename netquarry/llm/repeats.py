"""Removal of byte strings that occur elsewhere, by suffix arrays (operator 6).

Every string of LENGTH bytes holds an anchor: its leftmost K-gram of least hash, which equal strings share at
the same place. An anchor occurrence sees, to both sides, all such strings that hold it. Documents are dealt
into blocks; a block sends its distinct (anchor, surroundings) to partitions by the anchor's hash.
Surroundings that occur twice repeat wholly. Others that share half a string with another's are sent as bytes
to the anchor's partition, where a suffix array of all of them, in symbols of WIDTH bytes aligned to the
anchor, brings equal strings together. An anchor with very many surroundings is split: its strings are counted
one by one, in partitions by their own hash. What repeats goes back to the block that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.blocks import SENT, cuts, deal, merged, pack, rows_of, sent, texts_of, unpack
from netquarry.llm.common import kept, whole
from netquarry.llm.suffixes import Hashed, mix, sliding_minimum, suffix_array

LENGTH, K, WIDTH = 400, 32, 64
#: Surroundings of an anchor that are compared in one suffix array; those of anchors with more are counted.
TOGETHER = 2048
#: Text bytes of a block, the least number of blocks, bytes hashed at once, symbols of a suffix array.
BLOCK_BYTES, LEAST_BLOCKS, CHUNK, SYMBOLS = 12 << 20, 24, 1 << 20, 40_000
AT = np.uint64((1 << 26) - 1)

ANCHOR, SEGMENT, STRING = range(3)
FULL, SHARES, HOT, OWN = 1, 2, 4, 8


def chunks(texts: list[bytes]) -> Iterator[list[int]]:
    """Indexes of texts of at least LENGTH bytes, in runs of about CHUNK bytes."""
    run: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) >= LENGTH:
            if run and size + len(t) > CHUNK:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(t)
    if run:
        yield run


class Anchors:
    """The anchors of some texts: hash, place, bytes seen to both sides, hashes of the surroundings and of either half.

    run: the texts' indexes in their block. Places count from the beginning of the first text.
    """

    def __init__(self, block: list[bytes], run: list[int]) -> None:
        self.run, texts = run, [block[i] for i in run]
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        hashed = Hashed(np.frombuffer(b"".join(texts), np.uint8))
        n = int(self.end[-1])
        at = np.arange(n - K + 1)
        grams = hashed(at, at + K)
        least = sliding_minimum((grams & ~AT) | at.astype(np.uint64), LENGTH - K + 1)
        inside = np.zeros(len(least), bool)
        for a, b in zip(self.start, self.end):
            inside[a: b - LENGTH + 1] = True
        # The place of the leftmost least never goes back, so repeats stand together.
        p = (least[inside] & AT).astype(np.int64)
        p = p[np.concatenate([[True], p[1:] != p[:-1]])]
        text = np.searchsorted(self.end, p, "right")
        self.p, self.text = p, text
        self.left = np.minimum(p - self.start[text], LENGTH - K)
        self.right = np.minimum(self.end[text] - p, LENGTH)
        # Least hashes are small; mixed, they spread evenly over the ranges of the partitions.
        self.a = mix(grams[p])
        shape = self.left.astype(np.uint64) * np.uint64(1 << 20) + self.right.astype(np.uint64)
        self.c = mix(hashed(p - self.left, p + self.right) ^ mix(shape + np.uint64(1)))
        half = (LENGTH - K) // 2
        before, after = self.left >= half, self.right >= K + half
        self.hl = np.where(before, hashed(np.maximum(p - half, 0), p + K) | np.uint64(1), np.uint64(0)).astype(np.uint32)
        self.hr = np.where(after, hashed(p, np.minimum(p + K + half, n)) | np.uint64(1), np.uint64(0)).astype(np.uint32)


class Distinct:
    """Distinct (anchor, surroundings) of a block, in order, and how often each occurs."""

    def __init__(self, parts: list[tuple]) -> None:
        a, c, hl, hr = (np.concatenate([np.empty(0, k), *(p[i] for p in parts)]) for i, k in enumerate((np.uint64, np.uint64, np.uint32, np.uint32)))
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        self.a, self.c, self.hl, self.hr = a[first], c[first], hl[order][first], hr[order][first]
        self.n = np.diff(np.append(first, len(a))).astype(np.uint32)
        own = mix(self.a + mix(self.c))
        self.order = np.argsort(own)
        self.sorted = own[self.order]

    def find(self, x: Anchors) -> np.ndarray:
        """Indexes of an anchor's pairs, which are all there."""
        return self.order[np.searchsorted(self.sorted, mix(x.a + mix(x.c)))]


def all_anchors(texts: list[bytes]) -> list[Anchors]:
    return [Anchors(texts, run) for run in chunks(texts)]


def distinct_of(anchors: list[Anchors]) -> Distinct:
    return Distinct([(x.a, x.c, x.hl, x.hr) for x in anchors])


def send_anchors(table: pa.Table, parts: int) -> pa.Table:
    d, block = distinct_of(all_anchors(texts_of(table))), table.column("block")[0].as_py()
    at = cuts(d.a, parts)
    return rows_of([
        (p, block, ANCHOR, b - a, pack(d.a[a:b]), pack(d.c[a:b]), packs(d.hl[a:b], d.hr[a:b], d.n[a:b]))
        for p, (a, b) in enumerate(zip(at, at[1:])) if b > a])


def packs(*arrays: np.ndarray) -> bytes:
    return pack(np.concatenate(arrays)) if len(arrays[0]) else b""


def shared(key: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Whether another row has the same key, among the rows that count."""
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    some = np.bincount(inverse, ok, minlength=len(count))
    return ok & (some[inverse] >= 2)


def answer_anchors(table: pa.Table) -> pa.Table:
    """What each of a block's (anchor, surroundings) is: see the flags."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    a, c = (np.concatenate([unpack(r[k], np.uint64, r["n"]) for r in rows]) for k in ("keys", "x"))
    extra = [unpack(r["y"], np.uint32, 3 * r["n"]).reshape(3, -1) for r in rows]
    hl, hr, n = np.concatenate(extra, axis=1)
    order = np.lexsort((c, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
    first = order[new]  # lexsort is stable, so this is the first block's
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    total = np.bincount(of, n)
    ga, gl, gr = a[first], hl[first], hr[first]
    half = shared(mix(ga + gl), gl > 0) | shared(mix(ga ^ mix(gr.astype(np.uint64))), gr > 0)
    _, group = np.unique(ga, return_inverse=True)
    # Where all that share are known to repeat, nothing is to be compared.
    open_ = np.bincount(group, half & (total < 2)) > 0
    half &= open_[group]
    many = np.bincount(group, half) > TOGETHER
    flags = (total >= 2) * FULL + half * SHARES + (half & many[group]) * HOT
    own = np.zeros(len(a), np.int64)
    own[first] = OWN
    answer = (flags[of] + own).astype(np.uint8)
    bounds = np.cumsum([0, *(r["n"] for r in rows)])
    return rows_of([(r["part"], r["block"], ANCHOR, r["n"], b"", pack(answer[x:y]), b"") for r, x, y in zip(rows, bounds, bounds[1:])])


def flags_of(answers: pa.Table) -> np.ndarray:
    rows = sorted((r for r in answers.to_pylist() if r["kind"] == ANCHOR), key=lambda r: r["part"])
    return np.concatenate([np.empty(0, np.uint8), *(unpack(r["x"], np.uint8, r["n"]) for r in rows)])


def chosen(anchors: list[Anchors], d: Distinct, wanted: np.ndarray) -> Iterator[tuple[Anchors, np.ndarray, np.ndarray]]:
    """Of each run of texts, the first occurrences of the wanted pairs: their indexes in the run and in d."""
    left = wanted.copy()
    for x in anchors:
        at = d.find(x)
        hit = np.flatnonzero(left[at])
        _, once = np.unique(at[hit], return_index=True)
        hit = hit[once]
        left[at[hit]] = False
        yield x, hit, at[hit]


def strings_of(block: list[bytes], x: Anchors, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every string of LENGTH bytes that holds the anchors, and which of hit it belongs to."""
    if not len(hit):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashed = Hashed(np.frombuffer(b"".join(block[i] for i in x.run), np.uint8))
    last = np.minimum(x.left[hit], x.left[hit] + x.right[hit] - LENGTH)
    count = np.maximum(last + 1, 0)
    of = np.repeat(np.arange(len(hit)), count)
    s = (x.p[hit] - x.left[hit])[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    # With the anchor's place in it, as a string with two of them must not count as two strings.
    place = (x.p[hit][of] - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(hashed(s, s + LENGTH) + mix(mix(x.a[hit])[of] + place)), of


def send_segments(table: pa.Table, answers: pa.Table, parts: int) -> pa.Table:
    """The surroundings to be compared, as bytes, and the strings to be counted."""
    if not table.num_rows:
        return rows_of([])
    texts, block = texts_of(table), table.column("block")[0].as_py()
    anchors = all_anchors(texts)
    d, flags = distinct_of(anchors), flags_of(answers)
    wanted = (flags & OWN > 0) & (flags & SHARES > 0)
    index, left, size, held, strings, weights = [], [], [], [], [], []
    for x, hit, at in chosen(anchors, d, wanted):
        hot = flags[at] & HOT > 0
        key, of = strings_of(texts, x, hit[hot])
        strings.append(key)
        weights.append(np.where(flags[at[hot]] & FULL, 2, 1)[of])
        for h, i in zip(hit[~hot], at[~hot]):
            index.append(i)
            left.append(x.left[h])
            size.append(x.left[h] + x.right[h])
            at_ = int(x.p[h] - x.start[x.text[h]])
            held.append(texts[x.run[x.text[h]]][at_ - int(x.left[h]): at_ + int(x.right[h])])
    order = np.argsort(np.array(index, np.int64), kind="stable")
    index = np.array(index, np.int64)[order]
    shape = np.stack([np.array(v, np.uint32)[order] for v in (left, size)]) if len(index) else np.empty((2, 0), np.uint32)
    out, at = [], cuts(d.a[index], parts)
    for p, (a, b) in enumerate(zip(at, at[1:])):
        if b > a:
            repeats = (flags[index[a:b]] & FULL).astype(np.uint32)
            out.append((p, block, SEGMENT, b - a, pack(d.a[index[a:b]]), packs(shape[0, a:b], shape[1, a:b], repeats),
                        zstandard.ZstdCompressor(level=1).compress(b"".join(held[i] for i in order[a:b]))))
    keys, inverse = np.unique(np.concatenate([np.empty(0, np.uint64), *strings]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([np.empty(0), *weights]), minlength=len(keys)).astype(np.uint32)
    return rows_of(out + sent(block, STRING, keys, count, None, parts))


def first_last(ok: np.ndarray, of: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest of `where` among the rows that are ok, of each of n; -1 for none."""
    low, high = np.full(n, 1 << 30), np.full(n, -1)
    np.minimum.at(low, of[ok], where[ok])
    np.maximum.at(high, of[ok], where[ok])
    return np.where(high < 0, -1, low).astype(np.int32), high.astype(np.int32)


def repeated(group: np.ndarray, left: np.ndarray, size: np.ndarray, twice: np.ndarray, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of a string that another surroundings of the same group, or one that occurs twice, has.

    A group's surroundings are cut into symbols at the same distances from the anchor; the suffix array of all
    of them gives each symbol's suffix a rank. Strings of one group and one distance are sorted by the bytes up
    to the next symbol and that symbol's rank, so equal ones are neighbours.
    """
    n = len(held)
    data = np.frombuffer(b"".join(held) + bytes(WIDTH), np.uint8)
    start = np.cumsum(size) - size
    hashed = Hashed(data)
    cut0 = left % WIDTH  # the first whole symbol, as seen from the beginning
    number = -(-(size - cut0) // WIDTH)
    of = np.repeat(np.arange(n), number)
    begin = np.cumsum(number) - number
    at = start[of] + cut0[of] + (np.arange(len(of)) - begin[of]) * WIDTH
    raw = data[at[:, None] + np.arange(WIDTH)]
    raw = np.where(np.arange(WIDTH) < (start + size)[of][:, None] - at[:, None], raw, 0).astype(np.uint8)
    words = np.ascontiguousarray(raw).view(">u8").astype(np.uint64).reshape(len(of), WIDTH // 8)
    order = np.lexsort(words.T[::-1])
    new = np.ones(len(of), bool)
    new[1:] = (words[order][1:] != words[order][:-1]).any(1)
    symbol = np.empty(len(of), np.int64)
    symbol[order] = np.cumsum(new) + 1
    # A 1 after each surroundings, a 0 at the very end.
    place = np.arange(len(of)) + of
    line = np.ones(len(of) + n + 1, np.int64)
    line[place] = symbol
    line[-1] = 0
    array = np.array(suffix_array(line.tolist()))
    rank = np.empty(len(line), np.int64)
    rank[array] = np.arange(len(line))
    count = np.maximum(np.minimum(left, size - LENGTH) + 1, 0)
    owner = np.repeat(np.arange(n), count)
    s = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    skip = np.maximum(-(-(s - cut0[owner]) // WIDTH), 0)
    nearest = cut0[owner] + skip * WIDTH
    ahead = hashed(start[owner] + s, start[owner] + nearest)
    kind = mix(mix(group[owner]) + (left[owner] - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ahead
    ranks = rank[begin[owner] + skip + owner]
    # One number to sort by, with the rank below the kind; both are sorted by where two kinds agree above it.
    low = np.uint64((1 << int(len(line)).bit_length()) - 1)
    order = np.argsort((kind & ~low) | ranks.astype(np.uint64))
    sorted_ = kind[order]
    alike = sorted_[1:] == sorted_[:-1]
    if (~alike & ((sorted_[1:] & ~low) == (sorted_[:-1] & ~low))).any():
        order = np.lexsort((ranks, kind))
        sorted_ = kind[order]
        alike = sorted_[1:] == sorted_[:-1]
    one = np.flatnonzero(alike)
    a, b = ((start[owner[i]] + s[i]) for i in (order[one], order[one + 1]))
    same = one[hashed(a, a + LENGTH) == hashed(b, b + LENGTH)]
    ok = twice[owner] > 0
    ok[order[same]] = True
    ok[order[same + 1]] = True
    return first_last(ok, owner, s, n)


def answer_segments(table: pa.Table) -> pa.Table:
    """For each block's surroundings the first and last repeated start; for its strings whether they repeat."""
    rows = table.to_pylist()
    if rows[0]["kind"] == STRING:
        rows, places, keys, _ = merged(table)
        total = np.zeros(len(keys), np.int64)
        for r, at in zip(rows, places):
            total[at] += unpack(r["x"], np.uint32, r["n"])
        return rows_of([(r["part"], r["block"], STRING, r["n"], b"", pack((total[at] >= 2).astype(np.uint8)), b"") for r, at in zip(rows, places)])
    rows.sort(key=lambda r: r["block"])
    group = np.concatenate([unpack(r["keys"], np.uint64, r["n"]) for r in rows])
    left, size, twice = np.concatenate([unpack(r["x"], np.uint32, 3 * r["n"]).reshape(3, -1) for r in rows], axis=1).astype(np.int64)
    data = b"".join(zstandard.ZstdDecompressor().decompress(r["y"]) for r in rows)
    ends = np.cumsum(size)
    order = np.argsort(group, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    low, high = np.full(len(group), -1, np.int32), np.full(len(group), -1, np.int32)
    run: list[np.ndarray] = []
    held = 0
    groups = np.split(order, begins[1:])
    for k, members in enumerate(groups):
        run.append(members)
        held += int((size[members] // WIDTH + 3).sum())
        if held >= SYMBOLS or k == len(groups) - 1:
            m = np.concatenate(run)
            low[m], high[m] = repeated(group[m], left[m], size[m], twice[m], [data[ends[i] - size[i]: ends[i]] for i in m])
            run, held = [], 0
    bounds = np.cumsum([0, *(r["n"] for r in rows)])
    return rows_of([(r["part"], r["block"], SEGMENT, r["n"], b"", pack(low[a:b]), pack(high[a:b])) for r, a, b in zip(rows, bounds, bounds[1:])])


CLEANED = "doc_id bigint, kept_text binary, spans array<struct<start:bigint,stop:bigint>>, n_bytes bigint"


def clean_block(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Each document's remaining bytes and removed runs."""
    kinds = {"doc_id": pa.int64(), "kept_text": pa.binary(),
             "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "n_bytes": pa.int64()}
    texts = texts_of(table)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    if texts:
        anchors = all_anchors(texts)
        d, flags = distinct_of(anchors), flags_of(answers)
        low, high = np.full(len(flags), -1, np.int64), np.full(len(flags), -1, np.int64)
        wanted = (flags & OWN > 0) & (flags & SHARES > 0)
        rows = sorted((r for r in answers.to_pylist() if r["kind"] == SEGMENT), key=lambda r: r["part"])
        mine = np.flatnonzero(wanted & (flags & HOT == 0))
        for v, k in ((low, "x"), (high, "y")):
            v[mine] = np.concatenate([np.empty(0, np.int32), *(unpack(r[k], np.int32, r["n"]) for r in rows)])
        rows = sorted((r for r in answers.to_pylist() if r["kind"] == STRING), key=lambda r: r["part"])
        again = np.concatenate([np.empty(0, np.uint8), *(unpack(r["x"], np.uint8, r["n"]) for r in rows)]) > 0
        if len(again):
            found = [(*strings_of(texts, x, hit), at) for x, hit, at in chosen(anchors, d, wanted & (flags & HOT > 0))]
            keys = np.unique(np.concatenate([k for k, _, _ in found]))
            for key, of, at in found:
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
                s = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
                low[at], high[at] = first_last(again[np.searchsorted(keys, key)], of, s, len(at))
        for x in anchors:
            at = d.find(x)
            full = (flags[at] & FULL > 0) & (x.left + x.right >= LENGTH)
            use = np.flatnonzero(full | (low[at] >= 0))
            at, full = at[use], full[use]
            seen, text = (x.p - x.left)[use], x.text[use]
            begin = np.where(full, seen, seen + low[at])
            stop = np.where(full, (x.p + x.right)[use], seen + high[at] + LENGTH)
            order = np.argsort(begin, kind="stable")
            begin, text, stop = begin[order], text[order], np.maximum.accumulate(stop[order])
            new = np.ones(len(begin), bool)
            new[1:] = (begin[1:] > stop[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(begin)) - 1
            for i, a, b in zip(text[first].tolist(), begin[first].tolist(), stop[last].tolist()):
                spans[x.run[i]].append((a - int(x.start[i]), b - int(x.start[i])))
    rest = []
    for t, cut in zip(texts, spans):
        at = [0, *(v for c in cut for v in c), len(t)]
        rest.append(b"".join(t[p:q] for p, q in zip(at[::2], at[1::2])) if cut else t)
    listed = [[{"start": p, "stop": q} for p, q in c] for c in spans]
    values = [table.column("doc_id").to_pylist(), rest, listed, [len(t) for t in texts]]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds.values())], list(kinds))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, least: int = LEAST_BLOCKS) -> DataFrame:
    """doc_id, kept_text (the remaining bytes), spans (the maximal removed runs) and n_bytes of every row.

    A byte goes if a string of LENGTH bytes over it also starts anywhere else, in any document or the same one.
    A null text is an empty one; texts shorter than LENGTH stay whole; repeated rows repeat each other, whatever
    their ids, and go; a row without an id is a document like any other.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(F.col(text)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(least, -(-size // block_bytes))
    dealt = deal(rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")))
    asked = dealt.groupBy("block").applyInArrow(lambda t: send_anchors(t, parts), SENT)
    answers = kept(asked.groupBy("part").applyInArrow(answer_anchors, SENT))
    segments = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: send_segments(t, a, parts), SENT)
    found = segments.groupBy("kind", "part").applyInArrow(answer_segments, SENT)
    return dealt.groupBy("block").cogroup(answers.unionByName(found).groupBy("block")).applyInArrow(clean_block, CLEANED)


def report(docs: DataFrame) -> DataFrame:
    """Digest columns of the contract."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"))
