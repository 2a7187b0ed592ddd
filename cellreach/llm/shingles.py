"""Vectorised word and shingle hashes of whole texts (numpy), used inside Arrow-batched tasks.

Words are maximal runs of bytes other than the six ASCII white-space bytes, A-Z lower-cased.
A word's hash is a polynomial of its bytes modulo 2**64, mixed; a shingle's hash combines the
hashes of its words in order. Texts are handled whole, in chunks of about a MB, as the arrays take eight bytes a byte.

Counts of shingles are kept by hash bucket: BUCKETS numbers a task, added up by part before they reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Buckets of the shingle counts (fixed size, whatever the corpus), and rows of the table that carry them.
BUCKET_BITS = 20
BUCKETS, COUNT_ROWS = 1 << BUCKET_BITS, 64
COUNT_DDL = "part int, counts array<int>"
#: Odd multiplier of the byte polynomial, and odd multipliers of a shingle's words.
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD += 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = (np.full(n, b, np.uint64) for b in (BASE, inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    return up[:n], down[:n]


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """A column's texts one by one, so that no task holds a batch of them twice."""
    return (x.as_py() for x in column)


def text_chunks(ids: Iterable, texts: Iterable, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in runs of about `limit` bytes; a longer text is a run of its own. Null is empty."""
    some, data, size = [], [], 0
    for i, text in zip(ids, texts, strict=True):
        b = text.encode() if text else b""
        if some and size + len(b) > limit:
            yield some, data
            some, data, size = [], [], 0
        some.append(i)
        data.append(b)
        size += len(b)
    if some:
        yield some, data


def word_runs(data: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts one after another (runs of bytes that are not `space`): hashes, and where they start and end in the texts
    joined by line feeds; and each text's first word (one more at the end)."""
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    gap = space[raw]
    before = np.concatenate(([True], gap[:-1]))
    start, end = np.flatnonzero(before & ~gap), np.flatnonzero(~before & gap)
    up, down = powers(len(raw))
    total = np.cumsum(_FOLD[raw] * up)
    left = np.where(start > 0, total[start - 1], np.uint64(0))
    words = mix((total[end - 1] - left) * down[start] + (end - start).astype(np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(b) + 1 for b in data])))
    return words, start, end, np.searchsorted(start, bounds)


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and each text's first word (one more at the end)."""
    words, _, _, first = word_runs(data)
    return words, first


def rolled_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * factors[k]
    return mix(rolled)


def shingle_sets(data: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text; fewer words make one shingle, none make none."""
    words, first = word_hashes(data)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    rolled = rolled_hashes(words, width)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            few = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([few], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def count_columns(counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A task's BUCKETS counts as COUNT_ROWS rows (part, counts)."""
    size = BUCKETS // COUNT_ROWS
    offsets = pa.array(np.arange(COUNT_ROWS + 1, dtype=np.int32) * size)
    values = pa.array(np.minimum(counts, 2**31 - 1).astype(np.int32))
    return pa.array(range(COUNT_ROWS), pa.int32()), pa.ListArray.from_arrays(offsets, values)


def add_up(counts: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts (part, counts): BUCKETS numbers, however large the corpus."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            at, held = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for k, part in enumerate(batch.column(0).to_pylist()):
                more = held[at[k] : at[k + 1]].astype(np.int64)
                sums[part] = sums[part] + more if part in sums else more
        if sums:
            rows = pa.array([s.astype(np.int64) for s in sums.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), rows], names=["part", "total"])

    out = np.zeros((COUNT_ROWS, BUCKETS // COUNT_ROWS), np.int64)
    for row in counts.repartition("part").mapInArrow(run, "part int, total array<long>").toArrow().to_batches():
        at, held = row.column(1).offsets.to_numpy(), row.column(1).values.to_numpy()
        for k, part in enumerate(row.column(0).to_pylist()):
            out[part] += held[at[k] : at[k + 1]]
    return out.reshape(-1)
