import random

import pytest
from pyspark.sql import functions as F

from cellreach.sources import readers
from cellreach.streaming.arrivals import on_arrival, renew_legs, stream_pois


def test_arrivals_renew_the_legs_they_touch(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (3, 1, 5)], "u long, v long, w long")
    source, base = str(tmp_path / "in"), str(tmp_path / "legs")
    spark.createDataFrame([(3, "cafe")], "node long, entity string").write.parquet(source)
    stream = stream_pois(spark, source, "node long, entity string").writeStream.foreachBatch(on_arrival(edges, base, 100))
    run = stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = readers.read_legs(spark, base).select("anchor", F.col("seconds")).collect()
    assert {tuple(r) for r in got} == {(1, 10), (2, 5), (3, 0)}


@pytest.mark.parametrize("seed", [3])
def test_five_arrivals_equal_a_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    edges = spark.createDataFrame([(r.randrange(60), r.randrange(60), r.randint(1, 30)) for _ in range(220)], "u long, v long, w long").cache()
    sites = [(r.randrange(60), r.choice(["cafe", "a&b", "café x"])) for _ in range(25)] + [(None, "cafe"), (4, None)]
    base = str(tmp_path / "legs")
    arrive, schema = on_arrival(edges, base, 45, parts=3), "node long, entity string"
    arrive(spark.createDataFrame([], schema), 0)
    for k in range(5):
        arrive(spark.createDataFrame(sites[k::5], schema), k + 1)
    arrive(spark.createDataFrame(sites[1::5], schema), 6)
    got = {(x["anchor"], x["entity"], x["seconds"]) for x in spark.read.parquet(base).collect()}
    whole = renew_legs(edges, spark.createDataFrame([s for s in sites if None not in s], schema), 45, 1)
    assert got == {tuple(x) for x in whole.collect()} and len(got) > 50
