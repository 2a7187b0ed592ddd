"""What op8 leaves out before it verifies a pair is what it would have left out afterwards."""

import numpy as np

from cellreach.llm import compact_windows as cw


def test_shared_tokens_never_misses_one():
    r = np.random.default_rng(5)
    texts = [r.integers(-(2**62), 2**62, 400) for _ in range(20)]
    copies = [np.where(r.random(400) < r.random(), t, r.integers(-(2**62), 2**62, 400)) for t in texts]
    starts, ends = np.sort(r.integers(0, 400, (2, 20)), axis=0)
    base = np.arange(20) * 400
    sides = [(np.concatenate(x), base + starts, base + ends) for x in (texts, copies)]
    got = cw.shared_tokens(*sides)
    want = [np.isin(t[s:e], c[s:e]).sum() for t, c, s, e in zip(texts, copies, starts, ends, strict=True)]
    assert (got >= want).all() and (got <= np.array(want) + 20).all()


def test_only_known_parts_are_left_out():
    r = np.random.default_rng(6)
    left_out = tried = 0
    for _ in range(400):
        n = int(r.integers(60, 500))
        a = r.integers(0, 2**62, n)
        b = np.where(np.repeat(r.random(n // 10 + 1) < r.random(), 10)[:n] | (r.random(n) < 0.4), a, r.integers(0, 2**62, n))
        parts = cw.similar_parts(a, b, 0, 46, 80)
        starts = tuple(int(x) for x in r.integers(0, 300, 2))
        known = ({}, {})
        for s, e, p, q, _ in parts:  # passages in which some of the parts lie, and some of neither
            for side, start, (x, y) in ((0, starts[0], (s, e)), (1, starts[1], (p, q))):
                if r.random() < 0.8:
                    slack = r.integers(-20, 21, 2)
                    lo, hi = start + x + int(slack[0]), start + y + int(slack[1])
                    if hi - lo >= 46:
                        known[side].setdefault(int(r.integers(0, 2)), []).append((lo, hi))
        known = tuple({k: sorted(v) for k, v in x.items()} for x in known)
        fresh = [x for x in parts if not cw.is_known((starts[0] + x[0], starts[0] + x[1], starts[1] + x[2], starts[1] + x[3]), known, cw.merge_of(46))]
        if not cw.may_be_new(a, b, starts, known, 46, 80):
            left_out += bool(parts)
            assert fresh == []
        tried += bool(parts)
    assert left_out > 20 and tried - left_out > 20
