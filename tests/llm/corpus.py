"""A small corpus with copies, near copies, shared passages, repeats and odd texts."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéfgh") for _ in range(r.randint(2, 7))) for _ in range(900)]
    prose = lambda k: [r.choice(vocab) for _ in range(k)]

    def laid_out(ws):
        lines, k = [], 0
        while k < len(ws):
            step = r.randint(3, 30)
            lines.append(" ".join(ws[k : k + step]))
            k += step
        return "\n".join(lines)

    passage, texts = prose(70), []
    base = prose(160)
    for k in range(n):
        kind = k % 6
        if kind == 0:
            texts.append(laid_out(prose(r.randint(60, 200))))
        elif kind == 1 and texts:
            texts.append(r.choice(texts))
        elif kind == 2:
            ws = list(base)
            for _ in range(r.randint(0, 5)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            texts.append(" ".join(ws))
        elif kind == 3:
            at = r.randint(0, 60)
            texts.append(laid_out(prose(at) + passage + prose(60)))
        elif kind == 4:
            texts.append("\n".join([" ".join(prose(12))] * r.randint(2, 9)))
        else:
            texts.append(laid_out(prose(r.randint(1, 80))).upper())
    odd = [None, "", " \n\t", "a", "A b c d", "a b c d", "x" * 400, "é" * 150, " ".join(["the"] * 300), "| # $\n\n\n", " ".join(prose(6000))]
    rows = [(k, t, "en", f"src{k % 3 if k % 2 else 0}", len(t or "")) for k, t in enumerate(texts + odd)]
    return rows, " ".join(passage)


def clashing(df):
    """df with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = ["row", "q_id", "doc", "node", "h", "tokens", "gone", "salt", "Value", "t", "c", "n", "pos", "length", "rank"]
    return df.withColumns({n: F.lit(1) for n in names})
