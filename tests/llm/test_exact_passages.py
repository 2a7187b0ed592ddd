"""Exact repeats among common lines and families: every 50 words that two documents share are in a row, on both sides."""

import random

from cellreach.llm import compact_windows
from tests.llm import brute


def corpus_of(seed, n):
    r = random.Random(seed)
    prose = lambda k: [f"w{r.randrange(40_000)}" for _ in range(k)]
    lines = [prose(30), prose(44)]
    passages = [prose(r.randint(50, 120)) for _ in range(n // 10)]
    texts = []
    for k in range(n):
        ws = prose(r.randint(5, 40))
        for _ in range(r.randint(1, 3)):
            p = list(r.choice(passages))
            kind = r.random()
            if kind < 0.4:  # a near copy
                for _ in range(max(1, len(p) // 30)):
                    p[r.randrange(len(p))] = f"e{r.randrange(10**6)}"
            elif kind < 0.6:  # a part, with a common line beside it
                at = r.randint(0, max(0, len(p) - 50))
                p = p[at : at + r.randint(50, 74)]
            ws += r.choice(lines) * (r.random() < 0.5) + p + r.choice(lines) * (r.random() < 0.3) + prose(r.randint(0, 30))
        texts.append((k, " ".join(ws)))
    return texts


def uncovered(out, texts):
    """Shared windows of 50 words that are in no row's passage as a whole, and how many are shared."""
    ws = {i: t.lower().split() for i, t in texts}
    held = {i: [] for i in ws}
    for r in out:
        held[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
        held[r["other_id"]].append((r["other_start_word"], r["other_start_word"] + r["other_n_words"]))
    at = {}
    for i in ws:
        for k in range(len(ws[i]) - 49):
            at.setdefault(tuple(ws[i][k : k + 50]), []).append((i, k))
    shared = [x for places in at.values() if len({i for i, _ in places}) > 1 for x in places]
    return [(i, k) for i, k in shared if not any(s <= k and k + 50 <= e for s, e in held[i])], len(shared)


def test_every_exact_repeat_is_covered(spark):
    texts = corpus_of(31, 500)
    texts += [(500, texts[3][1]), (501, texts[3][1]), (502, texts[7][1])]
    out = compact_windows.near_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    lost, shared = uncovered(out, texts)
    assert shared > 10_000 and lost == []
    ws = {i: t.lower().split() for i, t in texts}
    for r in out:
        a = ws[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        b = ws[r["other_id"]][r["other_start_word"] : r["other_start_word"] + r["other_n_words"]]
        assert r["doc_id"] != r["other_id"] and min(len(a), len(b)) >= 50 and brute.similar(brute.shingles(a), brute.shingles(b))
    assert len({tuple(r)[:6] for r in out}) == len(out)
    # A row's two passages, and what overlaps them widely, have one component.
    ends = {}
    for r in out:
        for doc, s, n in ((r["doc_id"], r["start_word"], r["n_words"]), (r["other_id"], r["other_start_word"], r["other_n_words"])):
            if not (r["start_word"] == 0 and r["n_words"] == len(ws[r["doc_id"]])):
                assert ends.setdefault((doc, s, n), r["component"]) == r["component"]
