"""WARC archives of pages, written index first and read by coalesced byte ranges.

Tasks write compressed records (one gzip member each) to archives of bounded size in the shared folder; the result of
the writing job is the index: archive, offset, length, url and payload digest of every record. Reading
starts from any selection of index rows: per archive they are sorted by offset, neighbouring ranges become one read,
and records are parsed from it.

Of equal payloads the page with the smallest id is stored as a response, the others as revisits that refer to it.

Scale: ids and digests alone are shuffled to learn the smallest id of each payload, pre-aggregated; pages are joined with the list of
repeats, which is broadcast if a count allows it. Reads are dealt to tasks by bytes of the archives. Archive names are unique to each task attempt and only
the committed attempt's rows reach the index, so lost executors leave at most unused files.

Defined results: a null html is an empty payload; rows that repeat the smallest id are all responses; a null id is never
referred to, and if all ids of a payload are null each is a response; a null url leaves the target out; control characters
in a url are percent-encoded in the header; an empty table gives an empty index and result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellreach.llm.common import fresh_path, small_side, written

ARCHIVE_BYTES = 1 << 26
#: Ranges closer than this are read in one go, up to READ_BYTES together.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 23
#: Archive bytes that a task reads.
JOB_BYTES = 1 << 23
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _filesystem(uri: str):
    """The pyarrow file system and path of a folder; s3a is the name that Hadoop has for s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response with the payload, or a revisit (refers_to given) with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The record's header, its HTTP header and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write every page to archives in folder (a shared one); the index, kept as Parquet beside them.

    Payloads of fewer than min_bytes are always responses.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Only ids and digests are shuffled to find equal payloads; the pages go to the few that repeat one, if those are few.
    narrow = rows.select("page_id", "sha", F.octet_length("html").alias("size"))
    firsts = narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null")
    later = narrow.join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= min_bytes))
    repeats = written(later.select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "first").distinct(), "warc-repeats")
    same = (F.col("sha") == F.col("r_sha")) & F.col("page_id").eqNullSafe(F.col("r_id"))
    marked = rows.join(small_side(repeats), same, "left").select("page_id", "url", "html", F.col("first").alias("refers_to"))

    def run(batches):
        system, base = _filesystem(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                digest = payload_digest(payload)
                data = gzip.compress(record_bytes(page_id, url, payload, digest, refers_to), 6, mtime=0)
                if out is None or at + len(data) > archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                kind = "response" if refers_to is None else "revisit"
                rows.append((name, at, len(data), url, digest, page_id, kind))
                at += len(data)
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("archive", "offset", "length", "url", "digest", "page_id", "record_type"), r, strict=True)) for r in rows],
                schema=_arrow(_INDEX),
            )
        if out is not None:
            out.close()

    spark_index = marked.mapInArrow(run, _INDEX)
    system, base = _filesystem(folder)
    system.create_dir(base, recursive=True)
    spark_index.write.parquet(f"{folder}/index")
    return spark.read.schema(spark_index.schema).parquet(f"{folder}/index")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges in groups that are read together."""
    groups: list[list[tuple[int, int]]] = []
    for at, size in ranges:
        if groups:
            begin, (last, n) = groups[-1][0][0], groups[-1][-1]
            if at - (last + n) <= gap and at + size - begin <= most:
                groups[-1].append((at, size))
                continue
        groups.append([(at, size)])
    return groups


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows: _RECORD, the payload null for revisits (and if not asked for).

    A response whose payload does not have its digest is an error.
    """
    jobs = index.select("archive", "offset", "length", F.floor(F.col("offset") / JOB_BYTES).alias("job"))
    tasks = math.ceil((index.agg(F.sum("length")).first()[0] or 0) / JOB_BYTES) or 1
    # Reads follow the bytes of the archives, not those of the index.
    chosen = jobs.repartition(tasks, "archive", "job").sortWithinPartitions("archive", "offset").drop("job")

    def parsed(data: bytes) -> dict:
        fields, http, payload = parse_record(zlib.decompress(data, 31))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response" and payload_digest(payload) != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
        number = lambda name: int(fields[name]) if name in fields else None
        return {
            "page_id": number("X-Page-Id"),
            "url": fields.get("WARC-Target-URI"),
            "payload_bytes": int(http["Content-Length"]),
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": number("X-Refers-To-Page-Id"),
            "payload": payload if with_payload and kind == "response" else None,
        }

    def run(batches):
        system, base = _filesystem(folder)
        for batch in batches:
            records = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for name, own in groupby(records, key=lambda r: r[0]):
                with system.open_input_file(f"{base}/{name}") as f:
                    for group in coalesce_ranges([r[1:] for r in own]):
                        begin = group[0][0]
                        data = f.read_at(group[-1][0] + group[-1][1] - begin, begin)
                        rows = [parsed(data[at - begin : at - begin + size]) for at, size in group]
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(_RECORD))

    return chosen.mapInArrow(run, _RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages and read every record back: _RECORD without the payload."""
    folder = fresh_path(spark, "warc")
    return read_records(write_archives(pages, folder, min_bytes=min_bytes), folder, with_payload=False).drop("payload")
