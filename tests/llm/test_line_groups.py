"""Tokens are grouped by one number, and ASCII texts are folded as they are."""

from pyspark.sql import functions as F

from cellreach.llm import common, line_dedup


def test_folded_of_ascii_and_other_texts(spark):
    texts = ["", "AbC z", "\tA\nB\r\x0b\x0c", "É", "aÉÀZ", "İI", "日本A", "x" * 300 + "Q", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r["k"]: r["f"] for r in df.select("k", common.folded(F.col("t")).alias("f")).collect()}
    want = {k: t and "".join(chr(b) for b in t.encode()).lower() for k, t in enumerate(texts)}
    assert got == want


def test_tokens_are_sorted_by_one_number(spark):
    judged = spark.createDataFrame([(1, 0, 0, 5, [7, 8]), (2, 0, 0, 6, [8]), (3, 0, 0, 9, [1])], "doc long, th long, line_no int, c long, prefix array<long>")
    out = line_dedup._not_alone(judged)
    assert sorted(r["c"] for r in out.collect()) == [5, 6]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan and "salt" not in plan.split("Window [")[1].split("Exchange")[0]
