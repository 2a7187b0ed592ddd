"""Pages of a REST search as rows: a data source with a page a partition.

A page is asked for by POST with a JSON body that holds `Page` (from 1) and `PageSize` beside the fields given; its answer has the rows in `Results` and may have how
many there are in `TotalCount`. With a total each page is a partition of its own; without one, one partition goes on until a page is short. Failed requests
are tried again, with growing pauses; a request that keeps failing fails the task, so no rows are lost silently.

    spark.dataSource.register(RestPages)
    spark.read.format("rest_pages").option("url", ...).option("body", '{"State": "MA"}').load()

Rows are (page int, seq int, value string): each result as JSON text, for from_json with the schema that it should have.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class _Pages(InputPartition):
    first: int
    only: bool


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.body = json.loads(options.get("body", "{}"))
        self.size = int(options.get("pagesize", options.get("pageSize", 100)))
        self.tries = int(options.get("tries", 4))
        self.pause = float(options.get("pause", 0.5))
        self.timeout = float(options.get("timeout", 60))

    def page(self, number: int) -> tuple[list, int | None]:
        """Results of a page, and how many there are in all if the answer says so."""
        data = json.dumps(self.body | {"Page": number, "PageSize": self.size}).encode()
        for attempt in range(self.tries):
            try:
                asked = urllib.request.Request(self.url, data, {"Content-Type": "application/json", "Accept": "application/json"})
                with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                    found = json.load(answer)
                return (found, None) if isinstance(found, list) else (found.get("Results") or [], found.get("TotalCount"))
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as e:
                final = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code != 429
                if final or attempt == self.tries - 1:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError("unreachable")

    def partitions(self) -> list[InputPartition]:
        results, total = self.page(1)
        if total is None:
            return [_Pages(1, len(results) < self.size)]
        return [_Pages(k, True) for k in range(1, max(-(-int(total) // self.size), 1) + 1)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        number = partition.first
        while True:
            results, _ = self.page(number)
            for k, row in enumerate(results):
                yield number, k, json.dumps(row)
            if partition.only or len(results) < self.size:
                return
            number += 1


class RestPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "page int, seq int, value string"

    def reader(self, schema) -> RestReader:
        return RestReader(dict(self.options))


def all_results(spark: SparkSession, source: str | None, body: str = "{}") -> DataFrame:
    """(value) of each result as JSON text: of a URL page by page, of a folder of JSON files or of one file (a list, an object with Results, or lines); none for no source."""
    if not source:
        return spark.createDataFrame([], "value string")
    if source.startswith(("http://", "https://")):
        spark.dataSource.register(RestPages)
        return spark.read.format("rest_pages").option("url", source).option("body", body).load().select("value")
    from pyspark.sql import functions as F

    text = spark.read.text(source, wholetext=True, pathGlobFilter="*.json" if not source.endswith((".json", ".ndjson", ".jsonl")) else None)
    trimmed = F.trim("value")
    listed = F.from_json(trimmed, "array<string>")
    inner = F.from_json(F.get_json_object(trimmed, "$.Results"), "array<string>")
    lines = F.filter(F.split(trimmed, "\n"), lambda x: F.trim(x) != "")
    rows = F.when(trimmed.startswith("["), listed).when(inner.isNotNull(), inner).otherwise(lines)
    return text.select(F.explode(rows).alias("value"))
