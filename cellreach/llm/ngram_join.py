"""N-gram Jaccard join of whole documents by vertical partitioning.

The distinct 5-word shingles of all documents have one global order: hash buckets of shingles, the rarest first (counted over all
documents), and in a bucket the hashes. The order is cut into FRAGMENTS ranges of equal weight, and with it every set into as many
parts; each fragment counts its part of a pair's overlap on its own, and the parts are summed per pair.

Pairs are those that share a shingle in the sets' prefixes, the first n - ceil(t n) + 1 shingles in the global order, without one of which
two sets cannot be similar at t. Documents with equal sets are one class. Groups of copies never become all their pairs: each shingle's members are first
tried against one pivot, the member whose set has it earliest in the order (the least mutated copy). After these links are
united, only pairs of *different* components that still share a prefix shingle are tried; length and
positional bounds drop pairs before any counting. Pairs inside a component could only repeat links
that the result (component and set size) already has, so no link between different texts is lost.

Scale: texts are read twice and shuffled once (documents that share a prefix shingle); the shuffle of
prefixes is about a fifth of the shingles, 8-byte hashes. Shingles in hot buckets are salted by
document; pairs across the components of a crowded shingle are tried in blocks of it. Nothing but the fixed-size bucket counts goes to the driver; rounds of the component search
and the candidate tables are written to the shared folder, so lost executors cost only a recomputation.

Defined results: null, empty or blank text has no shingles and is linked with nothing; fewer than five
words are one shingle; rows that repeat a doc_id each keep their own output row; a null doc_id is counted and links others, but has
component null; empty tables give empty results; other columns are ignored. Shingles are compared by
64-bit hashes, and a set's class is the 64-bit sum of its shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellreach.llm.common import RowKey, released, row_struct, small_side, unpack, written
from cellreach.llm.components import connected_components
from cellreach.llm.shingles import BUCKETS, COUNT_DDL, COUNT_ROWS, add_up, buckets, count_columns, shingle_sets, text_chunks, texts_of

WIDTH = 5
PERCENT = 80
#: A bucket this much above the average holds a hot shingle; it is dealt out in salted parts of about this size.
HOT = 8192
FRAGMENTS = 4
#: Members of a shingle that a block of pairs across components takes from either side.
BLOCK = 2000

def _surveyed(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc, th, id, n, node) of every document (doc, th, text, id), and rows (part, counts) of every task's bucket counts."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        names = ["doc", "th", "id", "n", "node", "part", "counts"]
        for batch in batches:
            docs_of, ths = (batch.column(k).to_numpy() for k in (0, 1))
            for rows, data in text_chunks(range(len(docs_of)), texts_of(batch.column(2))):
                at = np.array(rows, np.int64)
                sets = shingle_sets(data, width)
                every = np.concatenate(sets)
                counts += np.bincount(buckets(every), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs_of[at]),
                        pa.array(ths[at]),
                        batch.column(3).take(pa.array(at)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(np.array([_set_key(s) for s in sets], np.uint64).view(np.int64)),
                        pa.nulls(len(at), pa.int32()),
                        pa.nulls(len(at), pa.list_(pa.int32())),
                    ],
                    names=names,
                )
        none = pa.nulls(COUNT_ROWS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(COUNT_ROWS, pa.int32()), none, *count_columns(counts)], names=names)

    return docs.mapInArrow(run, "doc long, th long, id long, n int, node long, " + COUNT_DDL)


def _global_order(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket its place in the global order, and the fragment of the order that it is in."""
    order = np.argsort(counts, kind="stable")
    place = np.empty(len(counts), np.int32)
    place[order] = np.arange(len(counts), dtype=np.int32)
    weight = np.cumsum(counts[order])
    fragment = np.minimum(weight * FRAGMENTS // max(1, int(weight[-1])), FRAGMENTS - 1)
    return place, fragment[place].astype(np.int32)


def _set_key(s: np.ndarray) -> int:
    """The 64-bit key of a set: the sum of its shingle hashes."""
    return int(s.sum(dtype=np.uint64))


def _prefixes(docs: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(shingle, salt, node, n, pos, hot): the prefix of each set, under its key; equal sets of one chunk once."""
    extra = np.maximum(counts - int(counts.mean()), 0)
    held = docs.sparkSession.sparkContext.broadcast((_global_order(counts)[0], np.where(extra > HOT, extra // HOT + 1, 1).astype(np.int32)))

    def run(batches):
        place, salts = held.value
        for batch in batches:
            for _, data in text_chunks(range(batch.num_rows), texts_of(batch.column(0))):
                seen, parts = set(), []
                for s in shingle_sets(data, width):
                    if not len(s) or (key := _set_key(s)) in seen:
                        continue
                    seen.add(key)
                    bucket = buckets(s)
                    n = len(s)
                    take = n - -(-n * percent // 100) + 1
                    order = np.argsort(place[bucket], kind="stable")[:take]  # s is sorted
                    parted = salts[bucket[order]].astype(np.int64)
                    parts.append((s[order], (key >> 1) % parted, parted > 1, key, n))
                if parts:
                    sizes = [len(p[0]) for p in parts]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
                            pa.array(np.concatenate([p[1] for p in parts]).astype(np.int32)),
                            pa.array(np.repeat(np.array([p[3] for p in parts], np.uint64).view(np.int64), sizes)),
                            pa.array(np.repeat(np.array([p[4] for p in parts], np.int32), sizes)),
                            pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
                            pa.array(np.concatenate([p[2] for p in parts])),
                        ],
                        names=["shingle", "salt", "node", "n", "pos", "hot"],
                    )

    return docs.mapInArrow(run, "shingle long, salt int, node long, n int, pos int, hot boolean")


def _fragments(docs: DataFrame, width: int, counts: np.ndarray) -> DataFrame:
    """(node, frag, part): each set, under its key, cut at the borders of the global order's fragments."""
    held = docs.sparkSession.sparkContext.broadcast(_global_order(counts)[1])

    def run(batches):
        for batch in batches:
            for _, data in text_chunks(range(batch.num_rows), texts_of(batch.column(0))):
                rows = []
                for s in shingle_sets(data, width):
                    key = np.array([_set_key(s)], np.uint64).view(np.int64)[0]
                    frag = held.value[buckets(s)]
                    rows += [(key, f, s[frag == f].view(np.int64)) for f in range(FRAGMENTS)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    ],
                    names=["node", "frag", "part"],
                )

    return docs.mapInArrow(run, "node long, frag int, part array<long>")


def _sets(texts: DataFrame, bearers: DataFrame, pairs: DataFrame, width: int, counts: np.ndarray) -> DataFrame:
    """The fragments of the sets in pairs, each from the first document that bears it."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = written(bearers.join(wanted, "node", "left_semi").select("rep.*"), "ngram-bearers")
    own = texts.join(small_side(chosen), ["doc", "th"], "left_semi")
    return written(_fragments(own.select("text"), width, counts), "ngram-sets")


def _partial(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with frag and, of that fragment, the sizes of both parts (ka, kb) and of their overlap (c)."""
    left = sets.select(F.col("node").alias("a"), "frag", F.col("part").alias("pa"))
    right = sets.select(F.col("node").alias("b"), "frag", F.col("part").alias("pb"))
    wanted = pairs.select("b").distinct()  # so that only sets of pairs are shuffled
    both = left.join(small_side(pairs), "a").join(right.join(small_side(wanted), "b", "left_semi"), ["b", "frag"])
    return both.select(*pairs.columns, "frag", F.size("pa").alias("ka"), F.size("pb").alias("kb"), F.size(F.array_intersect("pa", "pb")).alias("c"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, na, b, nb) whose fragments' overlaps sum to a Jaccard similarity of percent or more.

    The fragment of the rarest shingles is counted first: pairs whose other fragments could not make up for it go no further.
    """
    enough = lambda c: 100 * c >= percent * (F.col("na") + F.col("nb") - c)
    rarest = _partial(pairs, sets.where("frag = 0"))
    most = F.col("c") + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    open_ones = written(rarest.where(enough(most)).select("a", "na", "b", "nb", F.col("c").alias("c0")), "ngram-open")
    rest = _partial(open_ones, sets.where("frag > 0"))
    total = rest.groupBy("a", "na", "b", "nb", "c0").agg((F.col("c0") + F.sum("c")).alias("c"))
    return total.where(enough(F.col("c"))).select("a", "b")


def _possible(percent: int, p: str, q: str) -> str:
    """Length and positional bounds of a pair sharing a prefix shingle, as SQL over columns p.n, p.pos, q.n, q.pos.

    A pair that is similar enough meets the positional bound at the first shingle that both have, where all common
    ones are still to come; it need not meet it at the others.
    """
    need = f"{percent} * ({p}.n + {q}.n)"
    most = f"least({p}.n - {p}.pos, {q}.n - {q}.pos)"
    return (
        f"{p}.n * 100 >= {percent} * {q}.n and {q}.n * 100 >= {percent} * {p}.n and {most} * {100 + percent} >= {need}"
    )


def _grouped(docs: DataFrame, key: RowKey, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(doc, th, id, n, united) of every row: its key, id, set size, and a number that linked rows share, null without shingles."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    texts = docs.select(*key.columns(own, text), text.alias("text"))
    survey = written(_surveyed(docs.select(*key.columns(own, text), text.alias("text"), own.cast("long").alias("id")), width), "ngram-survey")
    counts = add_up(survey.where("part is not null").select("part", "counts"))
    rows = survey.where("part is null").select("doc", "th", "id", "n", "node")

    same = Window.partitionBy("shingle", "salt")
    shared = (
        _prefixes(texts.select("text"), width, percent, counts)
        .repartition("shingle", "salt")
        .dropDuplicates(["shingle", "salt", "node"])  # no second shuffle: copies are in one partition already
        .withColumn("lo", F.min("node").over(same))
        .withColumn("hi", F.max("node").over(same))
        .withColumn("pivot", F.min(F.struct("pos", "node", "n")).over(same))
        .where("hot or lo <> hi")
    )
    live = written(shared.select("shingle", "node", "pos", "n", "pivot"), "ngram-live")

    def ordered(x: str, y: str) -> list:
        up = F.col(f"{x}.node") < F.col(f"{y}.node")
        return [
            F.least(f"{x}.node", f"{y}.node").alias("a"),
            F.when(up, F.col(f"{x}.n")).otherwise(F.col(f"{y}.n")).alias("na"),
            F.greatest(f"{x}.node", f"{y}.node").alias("b"),
            F.when(up, F.col(f"{y}.n")).otherwise(F.col(f"{x}.n")).alias("nb"),
        ]

    starred = live.select(F.struct("node", "pos", "n").alias("x"), F.col("pivot").alias("y"))
    first = written(
        starred.where(f"x.node <> y.node and {_possible(percent, 'x', 'y')}").select(*ordered("x", "y")).distinct(),
        "ngram-pairs",
    )
    bearers = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("doc", "th")).alias("rep"))
    sets = _sets(key.once(texts), bearers, first, width, counts)
    links = written(_linked(first, sets, percent), "ngram-links")
    released(sets)
    comp = written(connected_components(links), "ngram-comps")

    placed = (
        live.select("shingle", "node", "pos", "n")
        .join(small_side(comp), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    spans = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = written(spans.where("lo <> hi").select("shingle"), "ngram-mixed")
    apart = written(placed.join(small_side(mixed), "shingle", "left_semi"), "ngram-apart")
    released(live, mixed)
    crowds = apart.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("parts > 1")
    blocks = apart.join(small_side(written(crowds, "ngram-crowds")), "shingle", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine, others = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tried = (
        blocks.select("*", mine.alias("p"), others.alias("q"))
        .alias("x")
        .join(
            blocks.select("*", mine.alias("q"), others.alias("p")).alias("y"),
            (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q")),
        )
        .where(f"x.node < y.node and x.component <> y.component and {_possible(percent, 'x', 'y')}")
    )
    second = written(tried.select(*ordered("x", "y")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"), "ngram-pairs")
    released(first, apart)
    final = comp
    if second.head(1):
        sets = _sets(key.once(texts), bearers, second, width, counts)
        more = written(_linked(second, sets, percent), "ngram-links")
        released(sets)
        final = connected_components(links.union(more)) if more.head(1) else comp
    released(second)

    united = final.select("node", F.col("component").alias("united"))
    return rows.join(united, "node", "left").select(
        "doc", "th", "id", "n", F.when(F.col("n") > 0, F.coalesce("united", "node")).alias("united")
    )


def ngram_jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents linked by 100 * overlap >= percent * union."""
    rows = _grouped(docs, RowKey(docs, id_col), id_col, text_col, width, percent)
    names = rows.where("n > 0").groupBy("united").agg(F.min("id").alias("first"))
    return rows.join(names, "united", "left").select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("first", "id")).alias("component_id"),
    )


def keep_first_of_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """The documents that come first of their component; every column of docs.

    The order is by id, null ids last, then by a hash of the text where an id repeats; rows equal in id and text are one
    document and stay or go together. Documents without shingles stay.
    """
    key = RowKey(docs, id_col)
    rows = written(_grouped(docs, key, id_col, text_col, width, percent), "ngram-rows")
    names = rows.where("n > 0").groupBy("united").agg(F.min(F.struct("doc", "th")).alias("first"))
    gone = rows.join(names, "united").where(F.struct("doc", "th") != F.col("first")).select("doc", "th").distinct()
    packed = docs.select(row_struct(docs).alias("row"))
    keyed = packed.select("row", *key.columns(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    return unpack(keyed.join(small_side(written(gone, "ngram-gone")), ["doc", "th"], "left_anti"), "row", docs.columns)
