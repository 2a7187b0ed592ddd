"""Tables that depend on each other, built again only where something that they are made from has changed.

A stage names its inputs (files or other stages) and how its table is made. Its manifest holds a fingerprint of its inputs: path, size and time of files,
and the contents of other stages' tables. A table is built if it has no manifest or an other one; if it comes out as it was, what depends on it stays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from cellreach.operators.tables import fingerprint


@dataclass(frozen=True)
class Stage:
    """name: the table's folder; sources: paths of files that it reads; needs: other stages; version: what else the result depends on."""

    name: str
    build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    sources: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    version: str = ""


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def source_stamp(spark: SparkSession, path: str) -> str:
    """Path, size and time of the files of a source, in order of their names; a source that is not there is an error."""
    at, store = _store(spark, path)
    if not store.exists(at):
        raise FileNotFoundError(path)
    files, rows = store.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        rows.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return "\n".join(sorted(rows))


def _manifest(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    at, store = _store(spark, f"{folder}/manifest")
    row = spark.read.parquet(f"{folder}/manifest").first() if store.exists(at) else None
    return (row["inputs"], row["digest"]) if row else None


def run_stages(spark: SparkSession, base: str, stages: list[Stage]) -> list[str]:
    """Bring all tables under base up to date; the names of the stages that were built, in order. The manifest is written last."""
    by_name = {s.name: s for s in stages}
    order = TopologicalSorter({s.name: set(s.needs) for s in stages}).static_order()
    digests: dict[str, str] = {}
    built = []
    for name in order:
        stage = by_name[name]
        parts = [stage.version, *[source_stamp(spark, p) for p in stage.sources], *[f"{n}={digests[n]}" for n in stage.needs]]
        inputs, folder = sha256("\n".join(parts).encode()).hexdigest(), f"{base.rstrip('/')}/{name}"
        known = _manifest(spark, folder)
        if known is None or known[0] != inputs:
            at, store = _store(spark, f"{folder}/manifest")
            store.delete(at, True)
            tables = {n: spark.read.parquet(f"{base.rstrip('/')}/{n}/table") for n in stage.needs}
            stage.build(spark, tables).write.mode("overwrite").parquet(f"{folder}/table")
            table = spark.read.parquet(f"{folder}/table")
            known = inputs, fingerprint(table, table.columns).first()["digest"] + table.schema.simpleString()
            spark.createDataFrame([known], "inputs string, digest string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
            built.append(name)
        digests[name] = known[1]
    return built
