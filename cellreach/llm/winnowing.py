"""Document fingerprints by winnowing, and how like neighbouring and edited texts are.

Every k-gram of code points is hashed (differences of prefix sums of a polynomial, mixed), and of each window of w
consecutive hashes the least one is chosen, the rightmost of equal ones. The chosen hashes with their positions are the fingerprint.
Two texts that share a stretch of at least w + k - 1 code points share a chosen hash there; none shorter than k is ever noticed.

`compare_with_next` orders documents by id: a narrow range sort gives the first keys of as many buckets as there are shuffle partitions;
each text goes to its bucket, and the first one of each bucket also to the end of the bucket before. So every task meets
its rows in order, each followed by its next, and no task or driver holds more than a chunk of texts.

Scale: one shuffle of the texts, one more text a bucket; a narrow shuffle of the keys. Only a key a bucket reaches the driver. Long texts are
fingerprinted in blocks.

Defined results: a null text is empty and has no grams; a text of fewer than k code points is one gram, one of fewer than w
grams one window. Ids that are null come last; rows of one id are ordered by a hash of their text; rows equal in both follow each other. The
last document is followed by the first, a single one by itself. Likeness is the Jaccard similarity of the sets of chosen hashes: 1 of two
empty texts, 0 of an empty and another one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellreach.llm.common import RowKey
from cellreach.llm.shingles import mix, powers, texts_of

GRAM, WINDOW = 16, 32
#: Code points fingerprinted at once; longer texts are cut into blocks of so many windows.
CHUNK_CHARS = 1 << 19
_NONE = np.uint64(2**64 - 1)


def _gram_hashes(code: np.ndarray, gram: int, sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Hashes of the k-grams of texts one after another, each text's laid out in its `room` and filled up with the largest number."""
    up, down = powers(len(code))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    grams = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(sizes)), grams)
    place = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams)
    at = (np.cumsum(sizes) - sizes)[text] + place
    width = np.minimum(gram, sizes)[text]
    h = np.minimum(mix((total[at + width] - total[at]) * down[at] + width.astype(np.uint64)), _NONE - np.uint64(1))
    out = np.full(int(room.sum()), _NONE)
    out[(np.cumsum(room) - room)[text] + place] = h
    return out


def _window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of consecutive hashes, the position of the least one, the rightmost of equals."""
    best, at, span = h, np.arange(len(h)), 1
    while span < window:
        step = min(span, window - span)
        right = best[step:] <= best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        span += step
    return at


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, the chosen hashes (uint64) and their positions in code points, in order."""
    blocks = [(k, at) for k, t in enumerate(texts) if t for at in (range(0, max(len(t) - window - gram + 2, 1), CHUNK_CHARS))]
    parts: list[list] = [[] for _ in texts]
    some, size = [], 0
    for i, (k, at) in enumerate(blocks):
        some.append((k, at, texts[k][at : at + CHUNK_CHARS + window + gram - 2]))
        size += len(some[-1][2])
        if size < CHUNK_CHARS and i < len(blocks) - 1:
            continue
        sizes = np.array([len(t) for _, _, t in some])
        code = np.frombuffer("".join(t for _, _, t in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        room = np.maximum(sizes - gram + 1, window)
        h = _gram_hashes(code, gram, sizes, room)
        chosen = _window_minima(h, window)
        first = np.cumsum(room) - room
        for (k, at, _), lo, n in zip(some, first.tolist(), (room - window + 1).tolist(), strict=True):
            mine = chosen[lo : lo + n]
            mine = mine[np.concatenate(([True], mine[1:] != mine[:-1]))]
            parts[k].append((h[mine], mine - lo + at))
        some, size = [], 0
    out = []
    for found in parts:
        if not found:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            continue
        hashes, places = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
        new = np.concatenate(([True], places[1:] != places[:-1]))  # a block may begin with what the one before chose last
        out.append((hashes[new], places[new]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def printed(hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint as hex: of each chosen gram the upper 32 bits of its hash and 16 bits of its distance from the one before."""
    record = np.empty(len(hashes), np.dtype([("h", ">u4"), ("gap", ">u2")]))
    record["h"], record["gap"] = hashes >> np.uint64(32), np.diff(places, prepend=0)
    return record.tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, n_chars, hashes, positions) of every document: the chosen hashes, as longs, and where they are."""

    def run(batches):
        for batch in batches:
            keys, lo, size, some = batch.column(0), 0, 0, []
            for hi, text in enumerate(texts_of(batch.column(1)), 1):
                some.append(text or "")
                size += len(some[-1])
                if size < CHUNK_CHARS and hi < len(keys):
                    continue
                found = winnow(some, gram, window)
                columns = [[len(t) for t in some], [h.view(np.int64) for h, _ in found], [p for _, p in found]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys[lo:hi], *arrays], names=["id", "n_chars", "hashes", "positions"])
                lo, size, some = hi, 0, []

    kinds = "id long, n_chars long, hashes array<long>, positions array<long>"
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def _with_times(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, id, text, times): rows equal in id and text once, where ids repeat at all."""
    key, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row_key = RowKey(docs, id_col)
    rows = docs.select(*row_key.columns(key, text), key.cast("long").alias("id"), text.alias("text"))
    if not row_key.repeats:
        return rows.withColumn("times", F.lit(1).cast("long"))
    return rows.groupBy("doc", "th", "id", "text").agg(F.count(F.lit(1)).alias("times"))


def _bucketed(rows: DataFrame) -> DataFrame:
    """rows dealt to buckets of their order and sorted; the first of each bucket is also the last, as `halo`, of the one before it."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("doc", "th").repartitionByRange(parts, "doc", "th")
    least = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc", "th")).alias("first"))
    found = sorted((r["first"]["doc"], r["first"]["th"]) for r in least.collect())
    firsts = np.array(found or [(0, 0)], [("doc", "i8"), ("th", "i8")])
    plain = len(np.unique(firsts["doc"])) == len(firsts) and not firsts["th"].any()

    @F.pandas_udf("bucket int, first boolean")
    def place(doc: pd.Series, th: pd.Series) -> pd.DataFrame:
        own = np.empty(len(doc), firsts.dtype)
        own["doc"], own["th"] = doc, th
        table = firsts["doc"] if plain else firsts
        at = np.maximum(np.searchsorted(table, own["doc"] if plain else own, "right") - 1, 0)
        return pd.DataFrame({"bucket": at.astype(np.int32), "first": firsts[at] == own})

    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("halo"))
    before = F.pmod(F.col("at.bucket") - 1, F.lit(len(firsts)))
    halo = F.struct(before.alias("bucket"), F.lit(True).alias("halo"))
    goes = F.when(F.col("at.first"), F.array(own, halo)).otherwise(F.array(own))
    dealt = rows.withColumn("at", place("doc", "th")).select("*", F.explode(goes).alias("to"))
    dealt = dealt.select(F.col("to.bucket").alias("bucket"), F.col("to.halo").alias("halo"), *rows.columns)
    return dealt.repartitionById(len(firsts), F.col("bucket")).sortWithinPartitions("bucket", "halo", "doc", "th")


def _rows(batches) -> Iterator[tuple[bool, int | None, str, int]]:
    for batch in batches:
        narrow = [batch.column(n).to_pylist() for n in ("halo", "id", "times")]
        for halo, key, times, text in zip(*narrow, texts_of(batch.column("text")), strict=True):
            yield halo, key, text, times


def _chains(batches) -> Iterator[list[tuple[bool, int | None, str, int]]]:
    """Runs of rows of about a chunk; a run begins with the row that the one before ended with."""
    held, size = [], 0
    for row in _rows(batches):
        held.append(row)
        size += len(row[2])
        if size >= CHUNK_CHARS and len(held) > 1:
            yield held
            held, size = held[-1:], len(row[2])
    if len(held) > 1:
        yield held


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """A row per document: n_chars, the SHA-256 of its edited text, both fingerprints, and the likeness to the edited and the next text.

    The edited text has its last quarter of code points (rounded down) replaced by as many first ones of the next document.
    """

    def run(batches):
        for chain in _chains(batches):
            out = []
            pairs = [(a, b[2]) for a, b in zip(chain, chain[1:], strict=False) if not a[0]]
            # Of rows equal in id and text each but the last is followed by an equal one.
            repeated = [(a, a[2]) for a, _ in pairs if a[3] > 1]
            pairs = [((h, key, t, 1), nxt) for (h, key, t, _), nxt in pairs] + [((h, key, t, n - 1), nxt) for (h, key, t, n), nxt in repeated]
            edited = []
            for (_, _, text, _), following in pairs:
                quarter = len(text) // 4
                edited.append(text[: len(text) - quarter] + following[:quarter])
            of_texts = dict(zip([r[2] for r in chain], winnow([r[2] for r in chain], gram, window), strict=True))
            sets = {t: np.unique(h) for t, (h, _) in of_texts.items()}
            for ((_, key, text, times), following), new, fp in zip(pairs, edited, winnow(edited, gram, window), strict=True):
                own = sets[text]
                out.append((
                    key, len(text), hashlib.sha256(new.encode()).hexdigest(), printed(*of_texts[text]), printed(*fp),
                    likeness(own, np.unique(fp[0])), likeness(own, sets[following]), times,
                ))
            if out:
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    ddl = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long"
    found = _bucketed(_with_times(docs, id_col, text_col)).select("halo", "id", "text", "times").mapInArrow(run, ddl)
    each = F.explode(F.when(F.col("times") > 1, F.sequence(F.lit(1), F.col("times").cast("int"))).otherwise(F.array(F.lit(1))))
    return found.withColumn("copy", each).select(F.col("id").alias(id_col), *names[1:-1])
