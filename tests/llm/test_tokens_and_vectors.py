"""Embedding whitening, document fingerprints and tokenizer alignment against brute-force versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellreach.llm import alignment, whitening, winnowing
from tests.llm import corpus

VECTORS = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v]


def brute_whitening(rows):
    xs = {i: whole(v) for i, v in rows}
    n, d = len(rows), len(rows[0][1])
    total = [sum(x[k] for x in xs.values()) for k in range(d)]
    exact = {i: [n * x[k] - total[k] for k in range(d)] for i, x in xs.items()}
    centred = np.array([[c / n for c in exact[i]] for i, _ in rows])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, {i: sum(c * c for c in v) for i, v in exact.items()}, {i: centred[k] for k, (i, _) in enumerate(rows)}, values[::-1], vectors[:, ::-1]


def test_whitening(spark):
    r = np.random.default_rng(3)
    turn = r.normal(size=(12, 12))
    good = [(k, (r.normal(size=12) * np.linspace(3, 0.1, 12) @ turn / 8).tolist()) for k in range(300)]
    bad = [(900, None), (901, []), (902, [float("nan")] + [0.0] * 11), (903, [float("-inf")] + [0.0] * 11), (904, [None] + [0.0] * 11), (905, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 0) for i, v in good + bad], VECTORS).repartition(5)
    got = whitening.whiten(corpus.clashing(df.withColumn("v", F.lit(1)).withColumn("w", F.lit(2)).withColumn("id", F.lit(3)))).collect()
    n, deviation, centred, values, vectors = brute_whitening(good)
    assert len(got) == 300 * 8 and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == set(range(300))
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(deviation.items())
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    for k in range(8):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        want = {i: float(c @ vectors[:, k]) / np.sqrt(values[k]) for i, c in centred.items()}
        sign = np.sign(mine[0]["whitened"] * want[0])
        assert max(abs(mine[i]["whitened"] - sign * want[i]) for i in want) < 1e-8
        assert all(abs(r["explained"] - values[k] / values.sum()) < 1e-9 for r in mine.values())


def test_whitening_of_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert make([]) == [] and make([(1, None, 0)]) == [] and make([(1, [1.0, 2.0], 0)]) == [] and make([(1, [1.0], 0)] * 4) == []
    two = make([(1, [0.0, 0.0], 0), (None, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, [1.0, 0.0], 1)])
    assert {r["component"] for r in two} == {1} and len(two) == 4 and {abs(round(r["whitened"], 9)) for r in two} == {1.0}
    far = make([(1, [3e38, 0.0], 0), (2, [-3e38, 3e38], 0), (3, [0.0, -3e38], 0)])
    assert len(far) == 6 and {r["deviation"] for r in far} == {None} and far[0]["identity_error"] < 1e-9


def brute_winnow(text, k=winnowing.GRAM, w=winnowing.WINDOW):
    """Grams chosen and their positions, by the grams' own hashes."""
    grams = [text[i : i + k] for i in range(max(len(text) - k + 1, min(len(text), 1)))]
    value = {g: int(h) for g in set(grams) for h in winnowing.winnow([g], k, w)[0][0][:1]}
    at = set()
    for i in range(max(len(grams) - w + 1, min(len(grams), 1))):
        part = [(value[g], -j) for j, g in enumerate(grams[i : i + w], i)]
        at.add(-min(part)[1])
    return [(value[grams[j]], j) for j in sorted(at)]


@pytest.mark.parametrize("chunk", [200, 1 << 19])
def test_winnow(monkeypatch, chunk):
    monkeypatch.setattr(winnowing, "CHUNK_CHARS", chunk)
    r = random.Random(8)
    texts = ["", "a", "ab" * 9, "x" * 300, "".join(r.choice("abé𝄞") for _ in range(700)), "tail " * 60, "".join(r.choice("ab") for _ in range(47)), "".join(map(chr, range(40, 1500)))]
    for text, (hashes, places) in zip(texts, winnowing.winnow(texts), strict=True):
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == brute_winnow(text)


def test_shared_stretches_share_a_fingerprint():
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        common = some(winnowing.GRAM + winnowing.WINDOW - 1)
        a, b = winnowing.winnow([some(90) + common + some(70), some(11) + common + some(200)])
        assert set(a[0].tolist()) & set(b[0].tolist())


def brute_fingerprints(rows):
    """rows (id, text) in order."""
    out = []
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        sets = [{h for h, _ in brute_winnow(t)} for t in (text, edited, after)]
        like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2])))
    return out


def test_compare_with_next(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "CHUNK_CHARS", 3000)
    rows = [(i, t, *x) for i, t, *x in corpus.make(4, 40)[0] if t is None or len(t) < 20000]
    df = corpus.clashing(spark.createDataFrame(random.Random(2).sample(rows, len(rows)), corpus.COLUMNS))
    got = sorted(winnowing.compare_with_next(df).collect(), key=lambda r: r["doc_id"])
    want = brute_fingerprints([(r[0], r[1]) for r in sorted(rows)])
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == [w[:3] for w in want]
    assert all(abs(r["near_edited"] - w[3]) < 1e-12 and abs(r["near_next"] - w[4]) < 1e-12 for r, w in zip(got, want, strict=True))
    texts = {r[0]: r[1] or "" for r in rows}
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)
    table = {r["doc_id"]: r for r in winnowing.fingerprints(df).collect()}
    assert all(winnowing.printed(np.array(r["hashes"], np.int64).view(np.uint64), np.array(r["positions"], np.int64)) == g["fingerprint"] for g in got for r in [table[g["doc_id"]]])


def test_compare_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert winnowing.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    one = winnowing.compare_with_next(spark.createDataFrame([(7, "alone in here")], schema)).collect()
    assert [(r["doc_id"], r["near_next"], r["near_edited"]) for r in one] == [(7, 1.0, one[0]["near_edited"])]
    a, b, c = ("".join(random.Random(s).choices("abcdef", k=90)) for s in (1, 2, 3))
    rows = [(3, a)] * 5 + [(1, b), (None, c), (None, c), (None, None)]
    got = winnowing.compare_with_next(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 3) == [0.0, 1.0, 1.0, 1.0, 1.0]
    assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] is None and r["n_chars"]) == 1


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path_a, path_b = alignment.paths()
    one, two = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    one.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbol = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    docs, count = {}, Counter()
    for i, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        a_bytes = [bytes(symbol[c] for c in one.id_to_token(t)) for t in a]
        b_bytes = [bytes([int(two.id_to_piece(t)[3:5], 16)]) if two.is_byte(t) else two.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            docs[i] = ([], [], [], [])
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        links = [(b[y], a[x]) for x, (s, e) in enumerate(spans[0]) for y, (s2, e2) in enumerate(spans[1]) if s < e2 and s2 < e]
        count.update(links)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(t) for t, (s, e) in zip(ids, span, strict=True) if lo <= s and e <= end) for ids, span in zip((a, b), spans, strict=True)))
            lo = end
        docs[i] = (a, b, groups, links)
    best = {}
    for (y, _), c in count.items():
        best[y] = max(best.get(y, 0), c)
    return count, {
        i: (len(a), len(b), len(g), len(ln), sum(count[x] == best[x[0]] for x in ln), sum(count[x] for x in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for i, (a, b, g, ln) in docs.items()
    }


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 4000)
    monkeypatch.setattr(alignment, "CHUNK_IDS", 700)
    rows = [(i, t if t is None else t[:4000], *x) for i, t, *x in corpus.make(6, 30)[0]]
    odd = ["a ▁ b", "<|endoftext|> <s> <unk>", "\U0001f600 \x00\x85 ﻿", "  two  spaces \n\n", "12345 ½", "ﬁ ① é", "z" * 900, "<0x41>"]
    rows += [(1000 + k, t, "en", "s", len(t)) for k, t in enumerate(odd)]
    df = corpus.clashing(spark.createDataFrame(rows, corpus.COLUMNS)).withColumns({"a": F.lit(1), "b": F.lit(2), "key": F.lit(3), "id": F.lit(4)}).repartition(3)
    count, want = brute_alignment([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df).collect()}
    assert got == want and want[1000] == (0, 0, 0, 0, 0, 0, "") and want[1001][0] > 3
    texts = {r["doc_id"]: r["groups"] for r in alignment.align(df, groups="text").collect()}
    assert all((hashlib.sha256(texts[i].encode()).hexdigest() if texts[i] else "") == w[6] for i, w in want.items())
    assert {((r["b"], r["a"]), r["links"]) for r in alignment.pair_counts(df).collect()} == set(count.items())


def test_alignment_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 3)
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema)).count() == 0
    none = alignment.align(spark.createDataFrame([(None, None), (1, "")], schema)).collect()
    assert {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "")}
    got = alignment.align(spark.createDataFrame([(None, "some words here and some more of them"), (2, "words"), (2, "words")], schema)).collect()
    count, want = brute_alignment([(0, "some words here and some more of them"), (1, "words"), (2, "words")])
    assert sorted(tuple(r)[1:] for r in got) == sorted(want.values())
