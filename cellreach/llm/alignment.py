"""Alignment of two tokenizers over a corpus: which of their tokens cover the same bytes, and how often.

Each text is encoded by tokenizer A (byte-level BPE, as a space and the text) and by B (pieces with byte fallback, which adds the space itself). Both
token sequences must spell the same bytes, else the text has no tokens. An A and a B token that overlap are linked; as
an overlap ends where either token ends, the links of a text are the distinct token ends, in order, and the ends that both
have cut it into groups.

A linked pair of ids is one 64-bit key, the B id above the A id. Tasks count their keys with `np.unique`; the partial counts are
sorted globally by key (range-partitioned), runs of a key are summed, and every range is kept as a shard of two sorted arrays in the
shared folder. Documents then look their links' counts up by binary search in the memory-mapped shards.

Scale: texts are encoded once and kept as ids (a table in the shared folder, deleted at the end, as the shards are); what is shuffled are
distinct pairs a task. The driver holds a row a shard, and the largest count of each B id (as many numbers as the vocabulary has). Tasks
map shards rather than hold them, and visit each in key order. A file system that cannot be mapped is read a shard at a time.

Defined results: a null or empty text, or one whose tokens spell other bytes (as B does for a text with U+2581), has zeros and
empty groups. Repeated rows count each, null ids too. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellreach.llm.bpe import _byte_symbols
from cellreach.llm.common import fresh_path, released, written
from cellreach.llm.packing import tokenizer_path
from cellreach.llm.shingles import texts_of

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters that a task encodes at once, ids that it aligns at once, and distinct pairs that it holds before it sends them on.
CHUNK_CHARS, CHUNK_IDS, HELD_PAIRS = 1 << 18, 1 << 18, 1 << 21
ID_BITS = 32
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def paths(a: str | None = None, b: str | None = None) -> tuple[str, str]:
    return a or tokenizer_path(A_FILE), b or tokenizer_path(B_FILE)


@lru_cache(maxsize=2)
def _encoder_a(path: str):
    """The byte-level encoder, and the bytes of each id."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["id"] for t in spec["added_tokens"]}
    of_symbol = {s: b for b, s in _byte_symbols().items()}
    table = [b""] * (max(spec["model"]["vocab"].values(), default=-1) + 1)
    for token, k in spec["model"]["vocab"].items():
        table[k] = token.encode() if k in special else bytes(of_symbol[c] for c in token)
    ranks = {token: k for k, token in enumerate(table) if k not in special and token}
    return tiktoken.Encoding(os.path.basename(path), pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), table


@lru_cache(maxsize=2)
def _encoder_b(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for k in range(model.vocab_size()):
        piece = model.id_to_piece(k)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return model, table


@lru_cache(maxsize=2)
def _tables(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Bytes an id has (A, B), and how ids are printed: A's inside a group, A's last of it, then the same of B's."""
    a, b = _encoder_a(path_a)[1], _encoder_b(path_b)[1]
    printed = [b"%d%c" % (k, end) for n, ends in ((len(a), b",|"), (len(b), b",;")) for end in ends for k in range(n)]
    return np.array([len(t) for t in a]), np.array([len(t) for t in b]), printed


def encode(texts: list[str | None], path_a: str, path_b: str) -> list[tuple[list[int], list[int]]]:
    """The A and the B ids of each text; none if they do not spell a space and the text."""
    (a, a_bytes), (b, b_bytes) = _encoder_a(path_a), _encoder_b(path_b)
    full = [k for k, t in enumerate(texts) if t]
    out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
    for k, other in zip(full, b.encode([texts[k] for k in full], num_threads=1), strict=True):
        want, one = b" " + texts[k].encode(), a.encode_ordinary(" " + texts[k])
        if b"".join(map(a_bytes.__getitem__, one)) == want == b"".join(map(b_bytes.__getitem__, other)):
            out[k] = one, other
    return out


def encoded(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """(id, a, b): the ids of every document."""

    def run(batches):
        for batch in batches:
            keys, lo, size, some = batch.column(0), 0, 0, []
            for hi, text in enumerate(texts_of(batch.column(1)), 1):
                some.append(text)
                size += len(text or "")
                if size < CHUNK_CHARS and hi < len(keys):
                    continue
                found = encode(some, path_a, path_b)
                ids = [pa.array([f[side] for f in found], pa.list_(pa.int32())) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([keys[lo:hi], *ids], names=["id", "a", "b"])
                lo, size, some = hi, 0, []

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, a array<int>, b array<int>")


@dataclass
class Links:
    """The links of several texts one after another."""

    key: np.ndarray  # of each link: B id, A id
    common: np.ndarray  # whether both tokens of the link end there, which ends a group
    a_token: np.ndarray  # the places of its tokens among all
    b_token: np.ndarray
    bounds: np.ndarray  # each text's first link, and one more at the end


def links_of(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, path_a: str, path_b: str) -> Links:
    """Links of texts whose ids are joined in a and b; n_a has how many of a are each text's."""
    a_size, b_size, _ = _tables(path_a, path_b)
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    ends = np.zeros((int(a_end[-1]) if len(a) else 0) + 1, np.uint8)
    ends[a_end] = 1
    ends[b_end] += 2
    at = np.flatnonzero(ends)
    kind = ends[at]
    of_a, of_b = kind & 1, kind >> 1
    a_token, b_token = np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b
    last = np.concatenate(([0], a_end))[np.cumsum(n_a)]
    bounds = np.concatenate(([0], np.searchsorted(at, last, "right")))
    key = (b[b_token].astype(np.int64) << ID_BITS) | a[a_token]
    return Links(key, kind == 3, a_token, b_token, bounds)


def printed_groups(links: Links, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, path_a: str, path_b: str) -> list[bytes]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
    a_size, b_size, table = _tables(path_a, path_b)
    cut = np.flatnonzero(links.common)
    a_upto, b_upto = links.a_token[cut] + 1, links.b_token[cut] + 1
    a_group = np.searchsorted(a_upto, np.arange(len(a)), "right")
    b_group = np.searchsorted(b_upto, np.arange(len(b)), "right")
    # In print the A ids of a group come before its B ids.
    code = np.empty(len(a) + len(b), np.int64)
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[a_upto - 1] = b_last[b_upto - 1] = True
    code[np.arange(len(a)) + np.concatenate(([0], b_upto))[a_group]] = a + len(a_size) * a_last
    code[np.arange(len(b)) + a_upto[b_group]] = b + 2 * len(a_size) + len(b_size) * b_last
    stops = np.cumsum(n_a + n_b)
    return [b"".join(map(table.__getitem__, code[lo:hi].tolist()))[:-1] for lo, hi in zip((stops - n_a - n_b).tolist(), stops.tolist(), strict=True)]


def _blocks(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK_IDS ids: keys, all A ids, all B ids, and how many of each a row has."""
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        a_at, b_at = a.offsets.to_numpy(), b.offsets.to_numpy()
        lo = 0
        while lo < len(batch):
            hi = max(int(np.searchsorted(a_at, a_at[lo] + CHUNK_IDS)), lo + 1)
            hi = min(hi, len(batch))
            ids = [c.values[int(at[lo]) : int(at[hi])].to_numpy() for c, at in ((a, a_at), (b, b_at))]
            yield batch.column("id")[lo:hi], *ids, np.diff(a_at[lo : hi + 1]), np.diff(b_at[lo : hi + 1])
            lo = hi


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def partial_counts(tokens: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, c): each task's counts of the pairs it meets."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=["key", "c"])

        for _, a, b, n_a, _ in _blocks(batches):
            held.append(np.unique(links_of(a, b, n_a, path_a, path_b).key, return_counts=True))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield out()
                    size = 0
        if size:
            held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            yield out()

    return tokens.mapInArrow(run, "key long, c long")


@dataclass
class CountShards:
    """Sorted (key, count) arrays by range of keys, kept as files; and each B id's largest count."""

    folder: str
    names: list[str]
    firsts: np.ndarray
    best: np.ndarray

    def _read(self, name: str) -> np.ndarray:
        store, path = fs.FileSystem.from_uri(f"{self.folder}/{name}")
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path, np.int64, "r")
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read(), np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys in ascending order."""
        out = np.empty(len(keys), np.int64)
        if not len(keys):
            return out
        cuts = np.append(np.searchsorted(keys, self.firsts[1:]), len(keys))
        lo = 0
        for name, hi in zip(self.names, cuts.tolist(), strict=True):
            if hi > lo:
                at = np.searchsorted(self._read(f"{name}.keys"), keys[lo:hi])
                out[lo:hi] = self._read(f"{name}.counts")[at]
            lo = hi
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(a, b, links) of every pair, a task a shard."""
        found, names = self, "name string"

        def run(batches):
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    keys, counts = found._read(f"{name}.keys"), found._read(f"{name}.counts")
                    for lo in range(0, len(keys), 1 << 16):
                        k = np.asarray(keys[lo : lo + (1 << 16)])
                        columns = [k & ((1 << ID_BITS) - 1), k >> ID_BITS, np.asarray(counts[lo : lo + (1 << 16)])]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "links"])

        shards = spark.createDataFrame([(n,) for n in self.names], names).repartition(max(len(self.names), 1))
        return shards.mapInArrow(run, "a long, b long, links long")

    def delete(self) -> None:
        store, path = fs.FileSystem.from_uri(self.folder)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def count_shards(partial: DataFrame, vocabulary: int) -> CountShards:
    """Sum partial counts into shards; `partial` is a table already written, as ranges are sampled from it."""
    spark = partial.sparkSession
    folder = fresh_path(spark, "pair-counts")

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = uuid.uuid4().hex  # of this attempt alone: a file of a lost one is never read
        first, left, best = None, None, np.zeros(vocabulary, np.int64)
        with store.open_output_stream(f"{path}/{name}.keys") as keys_to, store.open_output_stream(f"{path}/{name}.counts") as counts_to:

            def put(keys, counts):
                keys_to.write(keys.tobytes())
                counts_to.write(counts.tobytes())
                np.maximum.at(best, keys >> ID_BITS, counts)

            for batch in batches:
                if not len(batch):
                    continue
                keys, counts = (batch.column(k).to_numpy() for k in (0, 1))
                if left is not None:
                    keys, counts = np.concatenate((left[0], keys)), np.concatenate((left[1], counts))
                begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                keys, counts = keys[begins], np.add.reduceat(counts, begins)
                first = int(keys[0]) if first is None else first
                put(keys[:-1], counts[:-1])
                left = keys[-1:], counts[-1:]  # its run may go on
            if left is not None:
                put(*left)
        if first is not None:
            ids = np.flatnonzero(best)
            columns = [[name], [first], [ids.astype(np.int32)], [best[ids]]]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "first", "b", "best"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    shards = sorted(dealt.mapInArrow(run, "name string, first long, b array<int>, best array<long>").collect(), key=lambda r: r["first"])
    best = np.zeros(vocabulary, np.int64)
    for r in shards:
        np.maximum.at(best, np.array(r["b"], np.int64), np.array(r["best"], np.int64))
    return CountShards(folder, [r["name"] for r in shards], np.array([r["first"] for r in shards], np.int64), best)


def documents_with_counts(tokens: DataFrame, shards: CountShards, path_a: str, path_b: str, groups: str = "sha256") -> DataFrame:
    """A row per document: its tokens, groups and links, how many links are the best of their B id, and the sum of the links' counts.

    groups="text" has the groups themselves, groups="sha256" their digest.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(shards)
    column = "groups" if groups == "text" else "groups_sha256"

    def run(batches):
        counted = shared.value
        for keys, a, b, n_a, n_b in _blocks(batches):
            links = links_of(a, b, n_a, path_a, path_b)
            pairs, which = np.unique(links.key, return_inverse=True)
            count = counted.counts(pairs)
            best = count == counted.best[pairs >> ID_BITS]
            upto = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[links.bounds])
            text = printed_groups(links, a, b, n_a, n_b, path_a, path_b)
            last = [t.decode() if groups == "text" else hashlib.sha256(t).hexdigest() if t else "" for t in text]
            numbers = [n_a, n_b, upto(links.common), np.diff(links.bounds), upto(best[which]), upto(count[which])]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(x, pa.int64()) for x in numbers], pa.array(last, pa.string())], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", column]
    return tokens.mapInArrow(run, "id long, " + "".join(f"{n} long, " for n in names[1:-1]) + f"{column} string")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, groups: str = "sha256") -> DataFrame:
    """documents_with_counts of docs; what it is made from is deleted again."""
    path_a, path_b = paths(a, b)
    tokens = written(encoded(docs, id_col, text_col, path_a, path_b), "tokens")
    partial = written(partial_counts(tokens, path_a, path_b), "pairs")
    shards = count_shards(partial, len(_encoder_b(path_b)[1]))
    released(partial)
    found = written(documents_with_counts(tokens, shards, path_a, path_b, groups), "aligned")
    released(tokens)
    shards.delete()
    return found.withColumnRenamed("id", id_col)


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """(a, b, links): how many links of the corpus each pair of ids has; the shards behind it stay in the shared folder."""
    path_a, path_b = paths(a, b)
    tokens = written(encoded(docs, id_col, text_col, path_a, path_b), "tokens")
    partial = written(partial_counts(tokens, path_a, path_b), "pairs")
    shards = count_shards(partial, len(_encoder_b(path_b)[1]))
    released(tokens, partial)
    return shards.table(docs.sparkSession)
