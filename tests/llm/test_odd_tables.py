"""Empty tables, null and repeated ids and clashing columns through the operators and the whole pipeline."""

import os

from cellreach.llm import url_filter, warc
from tests.llm import corpus


def test_urls_of_no_pages(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_with_clashing_columns(spark):
    rows = [(1, "http://a/b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_round_trip(spark, corpus.clashing(pages)).collect()}
    assert got == {1: ("response", None, 8), 2: ("revisit", 1, 8), 3: ("response", None, 0)}


def run(spark, folder, rows, clash):
    import corpus_pipeline

    df = spark.createDataFrame(rows, corpus.COLUMNS)
    (corpus.clashing(df) if clash else df).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_of_no_documents(spark, tmp_path):
    assert run(spark, tmp_path, [], False) == []


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null texts and languages, columns named as the operators' own; stage tables go."""
    prose = lambda seed: "\n".join(" ".join(f"w{seed}x{k}y{j}" for j in range(12)) for k in range(8))
    rows = [(1, prose(1)), (1, prose(2)), (1, prose(1)), (None, prose(3)), (None, prose(4)), (None, None), (2, ""), (3, prose(3))]
    rows = [(i, t, None, None if k % 2 else "s", None) for k, (i, t) in enumerate(rows)]
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = run(spark, tmp_path, rows, True)
    # One document of each text stays, the first in order (null ids last); rows equal in id and text are one document.
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "3", "None"] and {r["piece"] for r in got} == {0}
    stages = ("quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination")
    assert not [f for f in set(os.listdir(shared)) - before if f.startswith(stages)]
