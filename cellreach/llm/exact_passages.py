"""Exact repeats of a span of tokens that no joined passage holds yet.

A span of tokens that two documents share has its min-hash at the same place c in both, and at least half of its tokens lie on one side of c. So the windows of one
hash function are grouped by min-hash and the tokens on one side (both sides in turn); groups of one document, and those whose windows are held by
passages on all sides, go. Only spans of the windows left are hashed: places of an equal span are joined with the first of them (the first itself with the last), and
runs of joined spans on one diagonal are one passage. A span inside a passage that is known already is not joined again, but others may be joined with it.

Scale: one pass over the texts for narrow rows of windows (some 2 / span a token and side), joined by hash with groups of two documents or more;
then the texts of documents with open windows alone. Everything is shuffled by hash and aggregated on the way, also where one span is in a third of all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellreach.llm.common import released, written
from cellreach.llm.shingles import mix, rolled_hashes, text_chunks, texts_of

_SIDES = "key long, doc long, th long, lo int, hi int"
_SPANS = "h long, doc long, th long, s int, open boolean"


def sides_of(window: tuple, beside: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Of windows (text, c, l, r, key) and both sides of c: text, key, and the first and last start of a span with half of it on that side.

    beside: hashes of the half + 1 tokens from each place on, of all texts one after another; first: each text's first token there.
    """
    text, c, left, right, key = window
    half = span // 2
    out = []
    for before in (True, False):
        lo = np.maximum(left, c - span + 1 if before else c - span + 1 + half)
        hi = np.minimum(c - half if before else c, right - span + 1)
        some = np.flatnonzero(lo <= hi)
        at = first[text[some]] + c[some] - half * before
        out.append((text[some], mix(key[some] ^ mix(beside[at] + np.uint64(before))), lo[some], hi[some]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def _sides(texts: DataFrame, ranks, width: int, span: int) -> DataFrame:
    from cellreach.llm.compact_windows import chunk_windows, token_run

    def run(batches):
        for batch in batches:
            ids, ths = (batch.column(k).to_numpy() for k in (0, 1))
            for rows, data in text_chunks(range(len(ids)), texts_of(batch.column(2))):
                tokens, _, first = token_run(data, width)
                text, c, left, right, key, *_ = chunk_windows(data, ranks.value, width, span, 1)
                beside = rolled_hashes(tokens, span // 2 + 1)
                text, key, lo, hi = sides_of((text, c, left, right, key), beside, first, span)
                at = np.array(rows, np.int64)[text]
                columns = [key.view(np.int64), ids[at], ths[at], lo.astype(np.int32), hi.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in _SIDES.split(", ")])

    return texts.mapInArrow(run, _SIDES)


def _spans(texts: DataFrame, width: int, span: int) -> DataFrame:
    """_SPANS rows of texts (doc, th, text, starts, held): the spans that begin in `starts`, open if no range of `held` has them."""
    from cellreach.llm.compact_windows import token_rows

    def run(batches):
        for batch in batches:
            lists = [batch.column(k).to_pylist() for k in (0, 1, 3, 4)]
            for doc, th, starts, held, text in zip(*lists, texts_of(batch.column(2)), strict=True):
                (tokens,) = token_rows([text.encode()], width)
                rolled = rolled_hashes(tokens, span)
                edge = np.zeros(len(rolled) + 1, np.int64)
                np.add.at(edge, [x["lo"] for x in starts], 1)
                np.add.at(edge, [x["hi"] + 1 for x in starts], -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                known = np.zeros(len(rolled) + 1, np.int64)
                inside = [(x["s"], min(x["e"] - span, len(rolled) - 1)) for x in held or () if x["e"] - span >= x["s"]]
                np.add.at(known, [s for s, _ in inside], 1)
                np.add.at(known, [e + 1 for _, e in inside], -1)
                is_open = np.cumsum(known[:-1])[at] == 0
                columns = [rolled[at].view(np.int64), np.full(len(at), doc), np.full(len(at), th), at.astype(np.int32), is_open]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in _SPANS.split(", ")])

    return texts.select("doc", "th", "text", "starts", "held").mapInArrow(run, _SPANS)


def exact_passages(texts: DataFrame, ranks, found: DataFrame, width: int, span: int) -> DataFrame:
    """Passages (doc, th, s, e, o_doc, o_th, o_s, o_e, percent) of equal spans that `found`, of the same columns, leaves open; a written table.

    With them every span of tokens that two documents (doc, th, text) share is, in either, in a passage as a whole.
    """
    place = F.struct("doc", "th")
    sides = written(_sides(texts, ranks, width, span), "exact-sides")
    ends = sides.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key")
    shared = written(sides.join(ends, "key", "left_semi"), "exact-shared")
    held = found.select("doc", "th", "s", "e").union(found.select("o_doc", "o_th", "o_s", "o_e")).distinct()
    # All spans of a side lie in one passage: it is closed.
    closed = shared.join(held, ["doc", "th"]).where(f"s <= lo and hi + {span} <= e").select(*shared.columns).distinct()
    open_keys = shared.join(closed, shared.columns, "left_anti").select("key").distinct()
    starts = shared.join(open_keys, "key", "left_semi").groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    known = held.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "e")).alias("held"))
    chosen = written(starts.join(known, ["doc", "th"], "left"), "exact-starts")
    spans = written(_spans(texts.join(chosen, ["doc", "th"]), width, span), "exact-spans")
    released(sides, shared, chosen)
    at = F.struct("doc", "th", "s")
    classes = spans.groupBy("h").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.max("open").alias("any")).where("any and struct(a.doc, a.th) <> struct(b.doc, b.th)")
    mine = spans.where("open").join(classes.select("h", "a", "b"), "h")
    other = mine.select("doc", "th", "s", F.when(F.struct("a.doc", "a.th") == place, F.col("b")).otherwise(F.col("a")).alias("o"))
    # The later document first, as in other passages.
    swap = F.struct("doc", "th") < F.struct("o.doc", "o.th")
    one, two = F.when(swap, F.col("o")).otherwise(at), F.when(swap, at).otherwise(F.col("o"))
    pairs = other.select(one.alias("p"), two.alias("q")).select(
        F.col("p.doc").alias("doc"), F.col("p.th").alias("th"), F.col("p.s").alias("s"), F.col("q.doc").alias("o_doc"), F.col("q.th").alias("o_th"), F.col("q.s").alias("o_s")
    ).distinct()
    by = Window.partitionBy("doc", "th", "o_doc", "o_th", F.col("s") - F.col("o_s")).orderBy("s")
    new = F.when(F.col("s") <= F.lag("s").over(by) + span, 0).otherwise(1)
    runs = pairs.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy("doc", "th", "o_doc", "o_th", (F.col("s") - F.col("o_s")).alias("shift"), "run").agg(F.min("s").alias("s"), (F.max("s") + span).alias("e"))
    rows = joined.select(
        "doc", "th", "s", "e", "o_doc", "o_th", (F.col("s") - F.col("shift")).alias("o_s"), (F.col("e") - F.col("shift")).alias("o_e"), F.lit(100).alias("percent")
    )
    out = written(rows.select(*[F.col(f.name).cast(f.dataType) for f in found.schema]), "exact-passages")
    released(spans)
    return out
