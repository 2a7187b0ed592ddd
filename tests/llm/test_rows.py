"""Repeated and null ids in any order of the rows, short lines, and near copies of many lengths."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from cellreach.llm import compact_windows, decontaminate, line_dedup, ngram_join, packing, suffix_dedup, url_filter
from cellreach.llm.common import RowKey, folded_words
from tests.llm import brute


def odd_rows():
    r = random.Random(21)
    prose = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    lines = [" ".join(prose(14)) for _ in range(12)]
    text = lambda *ks: "\n".join(lines[k] for k in ks)
    rows = [(1, text(0, 1, 2)), (1, text(3, 4, 5)), (1, text(3, 4, 5)), (2, text(0, 6, 7)), (None, text(8, 9)), (None, text(1, 10)), (3, text(8, 3, 11)), (None, None), (1, None)]
    return rows + [(7, text(9, 2, 4)), (5, "short"), (5, "")]


def keyed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = RowKey(df, "doc_id")
    found = df.select("doc_id", "text", *key.columns(F.col("doc_id"), F.col("text"))).collect()
    return df, [((r["doc"], r["th"]), r["doc_id"], r["text"]) for r in found]


ORDERS = [lambda x: x, lambda x: x[::-1], lambda x: random.Random(4).sample(x, len(x))]


@pytest.mark.parametrize("order", ORDERS)
def test_suffix_dedup_of_rows(spark, order):
    df, rows = keyed(spark, order(odd_rows()))
    want = brute.repeats(sorted({(k, t) for k, _, t in rows}, key=lambda x: x[0]))
    expected = sorted((str(i), *want[k]) for k, i, _ in rows)
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == expected
    assert sum(r["n_removed"] for r in got) > 0


@pytest.mark.parametrize("order", ORDERS)
def test_line_dedup_of_rows(spark, order):
    df, rows = keyed(spark, order(odd_rows()))
    gone = brute.repeated_lines(list({(k, t) for k, _, t in rows}))
    expected = sorted((str(i), len((t or "").split("\n")), ",".join(str(n) for d, n in sorted(gone) if d == k)) for k, i, t in rows)
    got = line_dedup.line_dedup(df).collect()
    assert gone and sorted((str(r["doc_id"]), r["n_lines"], r["removed_lines"]) for r in got) == expected
    left = sorted(str(r["text"]) for r in line_dedup.drop_repeated_lines(df).collect())
    texts = [(t, {n for d, n in gone if d == k}) for k, _, t in rows]
    cut = [t if not x else "\n".join(line for n, line in enumerate(t.split("\n")) if n not in x) for t, x in texts]
    assert left == sorted(str(c) for c, (_, x) in zip(cut, texts, strict=True) if not x or brute.words(c))


def test_short_lines(spark):
    df = spark.createDataFrame([(1, "a b\nB A\nlong line of five words\nA  b"), (2, "a b\n\nnew"), (3, "a b c d e\na b c d")], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: "3", 2: "0", 3: ""}
    assert {r["removed_lines"] for r in line_dedup.line_dedup(df, short_lines=False).collect()} == {""}


def test_folding_tells_all_other_characters_apart(spark):
    texts = ["É", "é", "Ã©", "ã©", "µ", "Μ", "×", "÷", "İ", "i", "K", "ß", "ẞ", "\x85", "\xa0", "中", "丽", "A", "z", "ϴ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded_words(F.col("t")).alias("w")).collect()
    assert len({tuple(r["w"]) for r in rows}) == len(texts) and all(len(r["w"]) == 1 for r in rows)
    one = spark.createDataFrame([("Ab\tÉx\x0b\x0cQ\r ",), ("aB Éx q",)], "t string").select(folded_words(F.col("t"))).collect()
    assert one[0] == one[1] and len(one[0][0]) == 3


def test_groups_of_rows(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    near = " ".join([*base[:90], "other", *base[91:]])
    rows = [(4, " ".join(base)), (4, "something else entirely of six words"), (None, near), (9, near), (9, near), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.ngram_jaccard_groups(df).collect())
    assert got == sorted([("4", 196, "4"), ("4", 2, "4"), ("9", 196, "4"), ("9", 196, "4"), ("None", 0, "None"), ("None", 196, "None")])
    kept = sorted((str(r["doc_id"]), str(r["text"])[:9]) for r in ngram_join.keep_first_of_groups(df).collect())
    assert kept == sorted([("4", " ".join(base)[:9]), ("4", "something"), ("None", "None")])


def test_links_through_a_null_id(spark):
    """Two documents that only a third one without an id is like."""
    r = random.Random(8)
    ws = [f"w{r.randrange(10**6)}" for _ in range(200)]
    edit = lambda ws, *places: [f"x{p}" if p in places else w for p, w in enumerate(ws)]
    rows = [(1, " ".join(edit(ws, 20, 40))), (None, " ".join(ws)), (2, " ".join(edit(ws, 100, 120, 140)))]
    sets = [brute.shingles(t.split()) for _, t in rows]
    assert brute.similar(sets[0], sets[1]) and brute.similar(sets[1], sets[2]) and not brute.similar(sets[0], sets[2])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, None: None}


def test_packing_of_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "other words"), (None, "x"), (None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), max_len=64, with_ids=True).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "None", "None"]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5
    assert all(zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"] for r in got)


def test_decontamination_of_rows(spark):
    item = " ".join(f"q{k}" for k in range(12))
    rows = [(1, f"a {item} b"), (1, "clean"), (1, f"a {item} b"), (None, item), (None, "clean"), (2, None)]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == sorted([("1", 14, 12, [5]), ("1", 14, 12, [5]), ("1", 1, 0, []), ("None", 12, 12, [5]), ("None", 1, 0, []), ("2", 0, 0, [])])
    assert sorted(str(r["text"]) for r in decontaminate.drop_contaminated(df, bench).collect()) == ["None", "clean", "clean"]


def test_url_rules_of_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/"), (1, "http://a.com/de/"), (1, "http://b.org/"), (None, "http://b.org/")], "page_id long, url string")
    got = sorted((str(r["page_id"]), r["verdict"]) for r in url_filter.judge_urls(df).select("row.page_id", "verdict").collect())
    assert got == [("1", "allow"), ("1", "block"), ("1", "block"), ("None", "allow")]


def test_near_passages_of_rows(spark):
    r = random.Random(5)
    prose = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    shared, copy = prose(70), " ".join(prose(80))
    rows = [(1, " ".join(prose(20) + shared)), (1, " ".join(shared + prose(30))), (None, " ".join(shared)), (3, copy), (3, copy), (4, copy), (5, None)]
    for order in ORDERS:
        got = compact_windows.near_passages(spark.createDataFrame(order(rows), "doc_id long, text string")).collect()
        assert sorted((x["doc_id"], x["other_id"], x["n_words"], x["percent"]) for x in got) == [(1, 1, 70, 100), (4, 3, 80, 100)]


@pytest.mark.parametrize("length", [60, 80, 120, 200])
def test_near_copies_are_found(spark, length):
    """At least 95 in 100 planted near copies of similarity 0.8 to 0.95, within unlike texts, in a corpus of 800."""
    r = random.Random(length)
    vocabulary = [f"w{k}" for k in range(4000)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    texts, planted = [], set()
    for k in range(200):
        ws = prose(length)
        while True:
            other = list(ws)
            for p in r.sample(range(length), max(1, r.randint(1, length // 40))):
                other[p] = r.choice(vocabulary)
            a, b = brute.shingles(ws), brute.shingles(other)
            if 100 * len(a & b) >= 80 * len(a | b):
                break
        planted.add((2 * k, 2 * k + 1))
        texts += [(2 * k, " ".join(prose(30) + ws + prose(30))), (2 * k + 1, " ".join(prose(25) + other + prose(40)))]
    texts += [(k, " ".join(prose(120))) for k in range(1000, 1400)]
    out = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    found = {(x["other_id"], x["doc_id"]) for x in out}
    assert len(found & planted) >= 190 and len(found - planted) == 0
