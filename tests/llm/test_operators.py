"""Each operator against a brute-force version, with odd texts, clashing columns and empty tables."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from cellreach.llm import bpe, compact_windows, decontaminate, line_dedup, ngram_join, packing, quality_rules, queries, sharding, suffix_dedup, url_filter, warc
from tests.llm import brute, corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return corpus.make()[0]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return corpus.clashing(spark.createDataFrame(rows, corpus.COLUMNS)).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], corpus.COLUMNS)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_quality_rules(docs, rows, nothing):
    want, _ = brute.quality([(r[0], r[1], r[3]) for r in rows], max_docs=3)
    got = quality_rules.quality_rules(docs, max_docs_per_line=3).collect()
    assert {r["doc_id"]: tuple(r)[1:8] for r in got} == {i: w[:7] for i, w in want.items()}
    assert {r["doc_id"]: r["n_boilerplate_lines"] for r in got} == {i: len(w[7]) for i, w in want.items()}
    assert quality_rules.quality_rules(nothing).count() == 0


def test_quality_stage(docs, rows):
    want, norm = brute.quality([(r[0], r[1], r[3]) for r in rows], max_docs=3)
    got = quality_rules.apply_quality_rules(docs, max_docs_per_line=3)
    assert got.columns == docs.columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert set(texts) == {i for i, w in want.items() if w[6]}
    for i, text, *_ in rows:
        if i in texts:
            left = "\n".join(x for x in text.split("\n") if norm(x) not in want[i][7])
            assert texts[i] == (left, len(left))


def test_quality_repeated_rows_and_null_ids(spark):
    text = "\n".join(" ".join(f"w{k}x{j}" for k in range(9)) for j in range(9))
    df = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (None, text, None)], "doc_id long, text string, source string")
    got = quality_rules.quality_rules(df, max_docs_per_line=1)
    assert sorted((r["doc_id"] is None, r["kept"]) for r in got.collect()) == [(False, True), (False, True), (True, True)]


def test_line_dedup(docs, rows, nothing):
    gone = brute.repeated_lines(pairs(rows))
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        mine = sorted(k for d, k in gone if d == i)
        assert got[i]["removed_lines"] == ",".join(map(str, mine)) and got[i]["n_removed"] == len(mine)
        assert got[i]["n_lines"] == len((text or "").split("\n"))
    assert line_dedup.line_dedup(nothing).count() == 0


def test_line_dedup_stage(docs, rows):
    gone = brute.repeated_lines(pairs(rows))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, text, *_ in rows:
        mine = {k for d, k in gone if d == i}
        left = text if not mine else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in mine)
        assert got.get(i) == left if not mine or brute.words(left) else i not in got


def test_ngram_groups(docs, rows, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_groups(docs).collect()}
    assert got == brute.groups(pairs(rows))
    assert ngram_join.ngram_jaccard_groups(nothing).count() == 0


def test_ngram_links_that_no_pivot_has(spark):
    """A chain of near copies, each like its neighbour alone."""
    r = random.Random(4)
    ws = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(14):
        ws = list(ws)
        ws[(k * 8) % 120] = f"x{k}{r.random()}"
        docs.append((100 - k, " ".join(ws)))
    df = spark.createDataFrame(docs + docs[:2] + [(None, docs[0][1])], "doc_id long, text string")
    rows = ngram_join.ngram_jaccard_groups(df).collect()
    assert len(rows) == 17 and [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"]} == brute.groups(docs)


def test_keep_first_of_groups(docs, rows):
    want = {i for i, (_, c) in brute.groups(pairs(rows)).items() if i == c}
    out = ngram_join.keep_first_of_groups(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


def test_bulk_encoding_is_the_library_s(rows):
    e = bpe.BulkEncoder(packing.tokenizer_path())
    texts = [r[1] for r in rows] + ["it's WE'RE ''s x'll 'T", "<|endoftext|> a", "中文 é́ İ", "a1²3½--''", "\x85 \xa0x"]
    want = [e.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.encode(texts)] == want
    assert [x.tolist() for x in e.encode(texts)] == want  # from the table of known words


def test_packing(docs, rows, nothing):
    e = bpe.BulkEncoder(packing.tokenizer_path())
    want = {}
    for i, text, *_ in rows:
        ids = np.array(e.library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[i, k // 256] = (k, len(part), zlib.crc32(part.tobytes()))
    got = packing.pack_documents(docs, max_len=256).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    check_places(got, 256)
    assert len({r["sequence_id"] for r in got}) <= best_fit_decreasing([w[1] for w in want.values()], 256)
    assert packing.pack_documents(nothing).count() == 0


def best_fit_decreasing(lengths, top):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else top) - length)
    return len(rooms)


def check_places(got, top):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= top


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(129, np.int64)
    for length in r.integers(1, 129, 40):
        counts[length] += r.integers(1, 500)
    plan = packing.plan_packing(counts)
    used = np.zeros(129, np.int64)
    for pattern, n in plan:
        assert sum(pattern) <= 128 and n > 0
        for length in pattern:
            used[length] += n
    assert (used == counts).all()


def test_decontamination(spark, docs, rows, nothing):
    passage = corpus.make()[1]
    items = [(1, passage), (2, "nothing of the kind here at all, not one word in ten"), (30, passage.upper()[:40]), (4, None), (5, "--"), (None, "the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.hits(pairs(rows), items)
    for block in (1 << 23, 50):
        got = decontaminate.digest(decontaminate.decontaminate(docs, bench, block_bytes=block)).collect()
        for r in got:
            n, hit, found = want[r["doc_id"]]
            listed = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            assert tuple(r)[1:] == (n, hit, len(found), listed, hit > 0)
    out = decontaminate.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, w in want.items() if not w[1]}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, none).count() == len(rows) and decontaminate.drop_contaminated(nothing, bench).count() == 0


@pytest.mark.parametrize("shard_bytes", [1 << 21, 2000])
def test_suffix_dedup(spark, docs, rows, nothing, shard_bytes):
    extra = [(900, "ab" * 300, "", "", 0), (901, "ab" * 200 + "c", "", "", 0)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, corpus.COLUMNS).select("doc_id", "text"))
    got = suffix_dedup.remove_repeats(df, shard_bytes=shard_bytes).collect()
    want = brute.repeats(pairs(rows + extra))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got} == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_array_and_prefixes():
    r = random.Random(8)
    data = "".join(r.choice("ab") for _ in range(300)) + "ab" * 90 + "".join(r.choice("abc") for _ in range(200))
    raw = np.frombuffer((data + data[50:300]).encode(), np.uint8)
    text = raw.tobytes()
    sa = suffix_dedup.suffix_array(raw, 100)
    assert sorted(sa.tolist()) == list(range(len(text)))
    assert all(text[a : a + 100] <= text[b : b + 100] for a, b in zip(sa[:-1], sa[1:], strict=True))
    common = lambda a, b: next((k for k in range(100) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 100)
    assert suffix_dedup.common_prefixes(raw, sa, 100)[1:].tolist() == [common(a, b) for a, b in zip(sa[:-1], sa[1:], strict=True)]


def test_compact_windows():
    r = random.Random(9)
    for _ in range(200):
        v = np.array([r.randint(0, 30) for _ in range(r.randint(1, 60))], np.uint64)
        want, todo, span = set(), [(0, len(v) - 1)], r.choice([3, 5, 8, 16])
        while todo:
            a, b = todo.pop()
            if b - a + 1 >= span:
                c = a + int(np.argmin(v[a : b + 1]))
                want.add((a, c, b))
                todo += [(a, c - 1), (c + 1, b)]
        assert set(zip(*(x.tolist() for x in compact_windows.compact_windows(v, span)), strict=True)) == want


def test_near_passages(docs, rows, nothing):
    """Documents with 50 equal words are joined, through one chain or another; every row is near enough."""
    out = compact_windows.near_passages(docs).collect()
    up = {i: i for i, *_ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    low = {i: brute.words((t or "").lower()) for i, t, *_ in rows}
    for r in out:
        up[find(r["doc_id"])] = find(r["other_id"])
        a = low[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        b = low[r["other_id"]][r["other_start_word"] : r["other_start_word"] + r["other_n_words"]]
        assert brute.similar(brute.shingles(a), brute.shingles(b)) and min(len(a), len(b)) >= 50
    first = {}
    for i, ws in low.items():
        for k in range(len(ws) - 49):
            other = first.setdefault(tuple(ws[k : k + 50]), i)
            assert find(i) == find(other)
    assert compact_windows.near_passages(nothing).count() == 0


def check_passages(out, texts):
    """Every 50 words that two documents share at about one place are in a passage of the pair, on both sides; all rows are similar."""
    ws = {i: t.lower().split() for i, t in texts}
    held = {i: set() for i in ws}
    for r in out:
        a = ws[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        b = ws[r["other_id"]][r["other_start_word"] : r["other_start_word"] + r["other_n_words"]]
        assert brute.similar(brute.shingles(a), brute.shingles(b)) and min(len(a), len(b)) >= 50
        held[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
        held[r["other_id"]] |= set(range(r["other_start_word"], r["other_start_word"] + r["other_n_words"]))
    at = {}
    for i in ws:
        for k in range(len(ws[i]) - 49):
            at.setdefault(tuple(ws[i][k : k + 50]), []).append((i, k))
    shared = [x for places in at.values() if len({i for i, _ in places}) > 1 for x in places]
    assert shared and all(set(range(k, k + 50)) <= held[i] for i, k in shared)


def test_near_passages_of_one_diagonal(spark):
    """Documents of one template: every passage is reported, not the longest alone."""
    r = random.Random(12)
    prose = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    one, two, three, four = prose(60), prose(60), prose(55), prose(90)
    texts = [
        (1, one + prose(200) + two),
        (2, one + prose(200) + two),
        (3, prose(30) + three + prose(70) + four + prose(80) + three[::-1] + prose(40)),
        (4, prose(33) + three + prose(72) + four + prose(75) + three[::-1] + prose(9)),
        (5, prose(200)),
    ]
    texts = [(i, " ".join(t)) for i, t in texts]
    out = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_passages(out, texts)
    assert len({(x["doc_id"], x["start_word"] // 100) for x in out}) == 5 and {x["doc_id"] for x in out} == {2, 4}


def test_near_passages_with_an_edit_are_rarely_missed(spark):
    """Pairs of 0.82 without 50 equal words, one word changed and one put in: the places shift, and min-hashes alone find them."""
    r = random.Random(3)
    texts = []
    for k in range(300):
        ws = [f"w{r.randrange(10**6)}" for _ in range(60)]
        texts += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join([*ws[:30], "new", "word", *ws[31:]]))]
    assert brute.similar(brute.shingles(texts[0][1].split()), brute.shingles(texts[1][1].split()))
    out = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    found = {(x["other_id"], x["doc_id"]) for x in out}
    assert all(a + 1 == b and a % 2 == 0 for a, b in found) and len(found) >= 297


def test_near_passages_of_texts_unlike_the_first(spark):
    """Many families about one passage shorter than the span, which decides most min-hashes: a text's one partner is seldom first or next."""
    r = random.Random(7)
    prose = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    middle, families = prose(42), [(prose(9), prose(9)) for _ in range(40)]
    texts = []
    for k in range(80):
        left, right = families[k % 40]
        texts.append((k, " ".join([*left[:2], f"x{k}", *left[3:], *middle, *right])))
    out = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(x["other_id"], x["doc_id"]) for x in out} == {(k, k + 40) for k in range(40)}


def test_similar_parts_that_the_longest_dense_range_hides():
    """The parts are side by side in one text and apart in the other."""
    r = np.random.default_rng(5)
    p, q, x = (r.integers(0, 2**60, k) for k in (60, 62, 60))
    got = compact_windows.similar_parts(np.concatenate((p, q)), np.concatenate((p, x, q)), 0, 46, 80)
    assert len(got) == 2 and {k for s, e, *_ in got for k in range(s, e)} == set(range(122))


def test_sharding(docs, rows, nothing):
    got = sharding.shard_by_bytes(docs, 4).collect()
    sizes = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (sizes[i], zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    by = {}
    for r in sorted(got, key=lambda r: r["doc_id"]):
        by.setdefault(r["shard"], []).append(r)
    assert [r["shard"] for k in sorted(by) for r in by[k]] == sorted(r["shard"] for r in got)
    for shard in by.values():
        assert [r["slot"] for r in shard] == list(range(len(shard)))
    total, most = sum(sizes.values()), max(sizes.values())
    assert all(abs(sum(r["size"] for r in by.get(k, [])) - total / 4) <= most for k in range(4))
    assert sharding.shard_by_bytes(nothing, 4).count() == 0


def test_sharding_of_equal_ids(spark):
    df = spark.createDataFrame([(7, "x")] * 40 + [(None, None)], "doc_id long, text string")
    got = sharding.shard_by_bytes(df, 3).collect()
    assert len(got) == 41 and len({(r["shard"], r["slot"]) for r in got}) == 41


def test_url_rules(spark):
    urls = ["http://A.example.ORG/es/x", "https://example.org/en/12?q", "http://example.org", "http://org/", "http://xorg/", "ftp://a.com/de/", "http://a.com/DE/",
            "http://a.com/fr/casino", "http://b.net/Casino", "no scheme casino", None, "", "http://h://x/y", "http://n.net/a\n#b"]
    df = corpus.clashing(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"))
    rows = url_filter.judge_urls(df).select("row.page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "", None, "allow"),
        ("org", "/", "org/", "allow"),
        ("xorg", "/", None, "allow"),
        ("a.com", "/de/", "com/de/", "block"),
        ("a.com", "/DE/", None, "allow"),
        ("a.com", "/fr/casino", "com/fr/", "allow"),
        ("b.net", "/Casino", None, "block"),
        ("", "", None, "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("h:", "//x/y", None, "allow"),
        ("n.net", "/a\n", None, "allow"),
    ]


def test_url_rule_tokens():
    assert url_filter.site_rule("block", "example.org/en/1").tokens == ("example", "org", "en")
    assert url_filter.pattern_rule("block", r"\bcasino\b").tokens == ("casino",)
    assert url_filter.pattern_rule("block", r"/wp-login\.php").tokens == ("wp", "login")
    assert url_filter.pattern_rule("block", r"ab*c").tokens == ()


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>é</p>", "same", "same", None, "", "x" * 70_000, "same", "small"]
    pages = spark.createDataFrame([(9 - k, None if k == 5 else f"http://a/{k}\r\nEvil: 1", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(pages, folder, archive_bytes=30_000)
    assert index.count() == 8 and index.select("archive").distinct().count() > 0
    got = {r["page_id"]: r for r in warc.read_records(index, folder).collect()}
    for k, h in enumerate(html):
        data = (h or "").encode()
        r = got[9 - k]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.payload_digest(data))
        first = min(9 - j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == 9 - k else ("revisit", first))
        assert r["payload"] is None if r["refers_to"] else bytes(r["payload"]) == data
    chosen = index.where("page_id in (8, 2)")
    assert {r["page_id"] for r in warc.read_records(chosen, folder).collect()} == {8, 2}
    files = [f for f in os.listdir(tmp_path / "warc") if f.endswith(".warc.gz")]
    assert all(open(tmp_path / "warc" / f, "rb").read(2) == b"\x1f\x8b" for f in files)


def test_warc_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, "a"), (None, "u", "a"), (3, "u", "b"), (3, "u", "b"), (4, "u", "b")], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(spark, pages).collect())
    assert got == [("3", "response", None)] * 2 + [("4", "revisit", 3)] + [("None", "response", None)] * 2
    assert warc.archive_round_trip(spark, pages.where("false")).count() == 0
    big = warc.archive_round_trip(spark, pages, min_bytes=2)
    assert {r["record_type"] for r in big.collect()} == {"response"}


def test_ranges_are_coalesced():
    groups = warc.coalesce_ranges([(0, 10), (12, 5), (100, 5), (105, 50)], gap=4, most=20)
    assert groups == [[(0, 10), (12, 5)], [(100, 5)], [(105, 50)]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    want = sorted(repr(tuple(r[order.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == want
