"""The whole pipeline against its stages' brute-force versions, one after another."""

import zlib

import numpy as np

from tests.llm import brute, corpus


def test_run(spark, tmp_path):
    import corpus_pipeline

    rows, passage = corpus.make(seed=6)
    rows = [(*r[:3], "one", r[4]) for r in rows]
    items = [(1, " ".join(passage.split()[5:30])), (2, "x")]
    spark.createDataFrame(rows, corpus.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    found, norm = brute.quality([(r[0], r[1], r[3]) for r in rows])
    docs = [(i, "\n".join(x for x in t.split("\n") if norm(x) not in found[i][7])) for i, t, *_ in rows if found[i][6]]
    gone, cut = brute.repeated_lines(docs), []
    for i, t in docs:
        mine = {k for d, k in gone if d == i}
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in mine)
        if not mine or brute.words(left):
            cut.append((i, left))
    comps = brute.groups(cut)
    single = [(i, t) for i, t in cut if comps[i][1] == i]
    clean = [(i, t) for i, t in single if not brute.hits([(i, t)], items)[i][1]]
    assert len(rows) > len(docs) > len(cut) >= len(single) > len(clean) > 0

    from cellreach.llm.bpe import BulkEncoder
    from cellreach.llm.packing import tokenizer_path

    library, want = BulkEncoder(tokenizer_path()).library, {}
    for i, t in clean:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want[i, k // 2048] = (k, zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["ids_crc32"]) for r in got} == want
