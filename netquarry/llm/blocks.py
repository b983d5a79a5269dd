"""Blocks of documents and partitions of sorted keys that exchange packed arrays.

A block sends its distinct 64-bit keys, sorted, to the partitions that hold ranges of them; a partition adds up
what all blocks sent and answers each block in the order of its own keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from netquarry.llm.common import small_batches

SENT = "part int, block int, kind int, n int, keys binary, x binary, y binary"


def squeeze(texts: list[str]) -> list[bytes]:
    zip_ = zstandard.ZstdCompressor(level=1)
    return [zip_.compress(t.encode()) for t in texts]


def texts_of(table: pa.Table) -> list[bytes]:
    """The texts of a block, as UTF-8."""
    unzip = zstandard.ZstdDecompressor()
    return [unzip.decompress(t.as_py()) for t in table.column("text")]


def deal(rows: DataFrame) -> DataFrame:
    """Rows with text and block dealt by block, texts compressed: they are nearly all that moves."""
    names = rows.columns
    schema = ", ".join(f"{n} {'binary' if n == 'text' else t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array(squeeze(batch.column("text").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([packed if n == "text" else batch.column(n) for n in names], names)

    return small_batches(rows).mapInArrow(run, schema).repartition("block")


def pack(a: np.ndarray) -> bytes:
    """An array, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(b: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def pack_keys(sorted_keys: np.ndarray) -> bytes:
    return pack(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64, n), dtype=np.uint64)


def cuts(keys: np.ndarray, parts: int) -> list[int]:
    """Where the sorted keys of each of so many equal ranges begin, and the end."""
    width = (1 << 64) // parts + 1
    return [*np.searchsorted(keys, np.array([width * i for i in range(parts)], np.uint64)).tolist(), len(keys)]


def sent(block: int, kind: int, keys: np.ndarray, x: np.ndarray, y: np.ndarray | None, parts: int) -> list[tuple]:
    at = cuts(keys, parts)
    return [(p, block, kind, b - a, pack_keys(keys[a:b]), pack(x[a:b]), b"" if y is None else pack(y[a:b]))
            for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def rows_of(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    names = [c.split()[0] for c in SENT.split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def merged(table: pa.Table) -> tuple[list, list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows by block, the place of each row's keys among all distinct keys, and which row has a key first."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    lists = [unpack_keys(r["keys"], r["n"]) for r in rows]
    keys, first, inverse = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
    bounds = np.cumsum([0, *map(len, lists)])
    return rows, [inverse[a:b] for a, b in zip(bounds, bounds[1:])], keys, first


def aligned(table: pa.Table, kind: int, column: str, dtype: type) -> np.ndarray:
    """The answers of one kind in the order of the block's keys."""
    rows = sorted((r for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r["part"])
    return np.concatenate([np.empty(0, dtype), *(unpack(r[column], dtype, r["n"]) for r in rows)])
