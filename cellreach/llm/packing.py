"""Best-fit packing of token sequences by patterns fitted to the length histogram.

Every document is encoded, ended by one separator id and cut, only if it is longer than the
sequence length, into pieces. The corpus is then just a histogram of piece lengths. Few-document
patterns that fill a sequence exactly (one, two or three pieces) get repeat counts by non-negative
least squares against the histogram; counts are rounded down, and what they leave is packed
by best fit, longest first, on the histogram. Pieces learn their place from their rank among the
pieces of their length.

Scale: one pass over the texts writes a narrow table of pieces; the driver sees only the
histogram (at most max_len numbers), and its plan has a bounded number of patterns with repeat counts, whatever
the corpus. Ranks are taken within (length, salt) groups of bounded size and offset by their
counts, so a length that a third of all pieces have is many tasks.

Defined results: a null or empty text is one piece with the separator alone; repeated rows are packed
each for itself; rows with a null id are packed too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellreach.llm.bpe import BulkEncoder
from cellreach.llm.common import fresh_path
from cellreach.llm.shingles import texts_of

MAX_LEN = 2048
SEPARATOR = 0
#: Rows of a (length, salt) group that are ranked together, about.
RANKED_TOGETHER = 100_000
STEPS = 200
#: Characters that a task encodes at once, long texts as a whole.
CHUNK_CHARS = 1 << 19


@lru_cache(maxsize=2)
def _encoder(path: str) -> BulkEncoder:
    return BulkEncoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(
    docs: DataFrame, path: str, id_col: str, text_col: str, max_len: int = MAX_LEN, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document's ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            size, lo, some = 0, 0, []
            for hi, text in enumerate(texts_of(batch.column(1)), 1):
                some.append(text)
                size += len(text or "")
                if size < CHUNK_CHARS and hi < len(keys):
                    continue
                rows = []
                for key, ids in zip(keys[lo:hi], encoder.encode(some), strict=True):
                    ids = np.append(ids, SEPARATOR).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), max_len)):
                        part = ids[at : at + max_len]
                        rows.append((key, k, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [pa.array(list(c), k) for c, k in zip(columns[: len(names)], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                size, lo, some = 0, hi, []

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, kind)


def _patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the sequence length, of lengths that occur."""
    top = len(counts) - 1
    have = np.flatnonzero(counts)
    first, second = np.meshgrid(have, have, indexing="ij")
    third = top - first - second
    ok = (first >= second) & (second >= third) & (third >= 0)
    first, second, third = first[ok], second[ok], third[ok]
    ok = (third == 0) | (counts[third] > 0)
    rows = np.stack([first[ok], second[ok], third[ok]], 1)
    if counts[top]:
        rows = np.concatenate(([[top, 0, 0]], rows))
    return rows


def nnls_repeats(counts: np.ndarray, patterns: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats x that minimise ||A x - counts||, by accelerated projected gradient.

    Column j of A has the lengths of pattern j. Rows are weighted by their length: long pieces are the hard ones.
    """
    top = len(counts) - 1
    weight = np.sqrt(np.arange(top + 1) / top)
    weight[0] = 0
    goal = weight * counts

    def times(x):
        total = sum(np.bincount(patterns[:, k], x, top + 1) for k in range(3))
        total[0] = 0
        return weight * total

    def back(r):
        r = weight * r
        r[0] = 0
        return r[patterns].sum(1)

    v = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue, for the step size
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (norm * 1.05)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(y - step * back(times(y) - goal), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Pack the histogram, longest first, each into the fullest sequences that have room; equal ones together."""
    top = len(counts) - 1
    rooms: list[dict[tuple[int, ...], int]] = [{} for _ in range(top + 1)]
    filled: set[int] = set()
    for length in range(top, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in filled if r >= length), default=0)
            if not room:
                per = top // length
                whole, rest = divmod(left, per)
                for pattern, n in (((length,) * per, whole), ((length,) * rest, 1)):
                    if pattern and n:
                        at = top - length * len(pattern)
                        rooms[at][pattern] = rooms[at].get(pattern, 0) + n
                        filled.add(at)
                break
            pattern, n = rooms[room].popitem()
            per = min(room // length, left)
            use = min(n, left // per)
            if use < n:
                rooms[room][pattern] = n - use
            if not rooms[room]:
                filled.discard(room)
            grown, at = pattern + (length,) * per, room - length * per
            rooms[at][grown] = rooms[at].get(grown, 0) + use
            filled.add(at)
            left -= use * per
    return [(p, n) for r in rooms for p, n in r.items()]


def plan_packing(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): every length occurs in them exactly as often as in the histogram."""
    counts = np.asarray(counts, np.int64)
    left, plan = counts.copy(), []
    patterns = _patterns(counts)
    if len(patterns):
        repeats = np.floor(nnls_repeats(counts.astype(float), patterns) + 1e-6).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if not repeats[j]:
                break
            row = patterns[j][patterns[j] > 0]
            each, times = np.unique(row, return_counts=True)
            n = int(min(repeats[j], (left[each] // times).min()))
            if n > 0:
                left[each] -= n * times
                plan.append((tuple(int(v) for v in row), n))
    return plan + best_fit(left)


def _ranges(plan: list[tuple[tuple[int, ...], int]], top: int) -> dict[str, np.ndarray]:
    """By length and rank: the sequence of a range's first rank, and the offset in each of its sequences."""
    used = np.zeros(top + 1, np.int64)
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"key": (table[:, 0] << 48) + table[:, 1], "from": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with a gapless rank from 0 within each length."""
    most = max(histogram.values(), default=1)
    salts = -(-most // RANKED_TOGETHER)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("before", F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c"))
        .select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), "before")
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    within = salted.withColumn("within", F.row_number().over(order) - 1)
    joined = within.join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    return joined.withColumn("rank", F.col("within") + F.col("before"))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = MAX_LEN,
    path: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked for."""
    spark = docs.sparkSession
    found = pieces_of(docs, path or tokenizer_path(), id_col, text_col, max_len, with_ids)
    at = fresh_path(spark, "pieces")
    found.write.parquet(at)
    pieces = spark.read.schema(found.schema).parquet(at)
    histogram = {r["length"]: r["c"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect()}
    counts = np.zeros(max_len + 1, np.int64)
    for length, c in histogram.items():
        counts[length] = c
    table = spark.sparkContext.broadcast(_ranges(plan_packing(counts), max_len))

    def place(batches):
        plan = table.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            k = np.searchsorted(plan["key"], (length << 48) + rank, "right") - 1
            out = [batch.column(n) for n in names]
            out += [pa.array(plan["sequence"][k] + rank - plan["from"][k]), pa.array(plan["offset"][k])]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "sequence_id", "offset"])

    names = found.columns
    ranked = _ranked(pieces, histogram).select(*names, "rank")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    return placed.withColumnRenamed("doc_id", id_col)
