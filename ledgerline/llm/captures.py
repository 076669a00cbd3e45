"""WARC archives with a two-level capture index.

Archives hold a compressed record per page, as the format has it; a page with the same
payload as another is a revisit of it. Every task writes files of its own and returns
where its records are; what a lost task wrote is in no index and so is never read.

The index sorts captures by the URL with its host reversed (com,example)/path). Its lines
are written in compressed blocks; the directory has the first and last key of each block
and its place in a file. Blocks have as many lines as it takes for the directory to have at
most DIRECTORY entries, so that it can be broadcast. A look-up finds the blocks of a key by
binary search in the directory, reads them by range, and searches each the same way; then
records are read by range from the archives.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_dir, materialize

LEAST_PAYLOAD = 1000
BLOCK_LINES = 1000
DIRECTORY = 2**17
MERGE_GAP = 1 << 16
# Bytes of records that a task reads, about.
TASK_BYTES = 64_000_000
MERGE_BYTES = 1 << 22
CAPTURE = "key string, page_id long, file string, offset long, length long"


class Index(NamedTuple):
    """The directory: a row per block, (first, last, file, offset, length)."""

    directory: DataFrame


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def reversed_host(url: str | None) -> str:
    """The key of a URL: com,example,www:8080)/path?query, lower-case host, no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    labels = [x for x in host.split(".") if x]
    number = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(labels))}{number}){parts.path or '/'}{query}"


def _header(lines: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode()


def _id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record, a revisit without payload if ``refers_to`` is given."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\n" + _header(
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    )
    body = http + b"\r\n" + (payload if refers_to is None else b"")
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page_id, digest))]
    if url is not None:
        lines.append(("WARC-Target-URI", quote(url, safe="".join(chr(c) for c in range(33, 127)))))
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _id(refers_to, digest)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    lines += [
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", digest),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    return gzip.compress(b"WARC/1.1\r\n" + _header(lines) + b"\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(raw: bytes) -> dict:
    """The fields of a compressed record; raises if the payload isn't what its digest says."""
    whole = gzip.decompress(raw)
    head, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = body.partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).digest() != digest or len(payload) != int(told["Content-Length"])):
        raise ValueError("a payload differs from its digest")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    return {
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
        "payload_bytes": int(told["Content-Length"]),
        "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
    }


def _archive(folder: str):
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{folder}/pages-{uuid.uuid4()}.warc.gz"
        out, at = None, 0
        fs, path = _open(file)
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(path, compression=None)
            rows = []
            for page_id, url, payload, refers in zip(
                *(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True
            ):
                raw = record(page_id, url, payload, refers)
                out.write(raw)
                rows.append((reversed_host(url), page_id, file, at, len(raw)))
                at += len(raw)
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return archive


def _folder(spark: SparkSession, folder: str | None) -> str:
    """A folder that exists, by default a new one in the shared checkpoint folder."""
    folder = folder or f"{checkpoint_dir(spark)}/captures-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def write_archives(
    pages: DataFrame, folder: str | None = None, least: int = LEAST_PAYLOAD
) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as records; their places as (CAPTURE).

    A null html has an empty payload, a null url no target. Of payloads of at least
    ``least`` bytes that are equal the largest page_id is the response; rows that repeat
    that id are responses too, and of payloads whose ids are all null each is one.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    named = pages.withColumn("digest", F.concat(F.sha1("payload"), F.octet_length("payload").cast("string")))
    large = named.where(F.octet_length("payload") >= least)
    first = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    typed = named.join(first.where("n > 1").drop("n"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    places = typed.select("page_id", "url", "payload", refers.alias("refers_to"))
    return materialize(places.mapInArrow(_archive(_folder(spark, folder)), CAPTURE))


def _blocks(folder: str, lines: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = f"{folder}/index-{uuid.uuid4()}.cdx.z"
        out, at, waiting = None, 0, []
        fs, path = _open(file)

        def write(rows: list[dict]) -> pa.RecordBatch:
            nonlocal out, at
            if out is None:
                out = fs.open_output_stream(path, compression=None)
            raw = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode())
            out.write(raw)
            at += len(raw)
            told = {"first": rows[0]["key"], "last": rows[-1]["key"], "file": file, "offset": at - len(raw), "length": len(raw)}
            return pa.RecordBatch.from_pylist([told])

        for batch in batches:
            waiting += batch.to_pylist()
            while len(waiting) >= lines:
                yield write(waiting[:lines])
                waiting = waiting[lines:]
        if waiting:
            yield write(waiting)
        if out is not None:
            out.close()

    return blocks


def build_index(places: DataFrame, folder: str | None = None, lines: int = BLOCK_LINES) -> Index:
    """The index of captures, see the module; ``lines`` a block has at least."""
    spark = places.sparkSession
    n = places.count()
    # Keys in the order of their UTF-8 bytes, which is that of Spark and of code points.
    ordered = places.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    lines = max(lines, math.ceil(2 * n / DIRECTORY))
    return Index(materialize(ordered.mapInArrow(
        _blocks(_folder(spark, folder), lines), "first string, last string, file string, offset long, length long"
    )))


def _find_blocks(directory):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts, places = directory.value
        for batch in batches:
            hits = []
            for key in batch["key"].to_pylist():
                # Blocks from the first that ends at the key or after to the last that begins there.
                for b in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    hits.append((*places[b], key))
            columns = zip(*hits, strict=True) if hits else [[]] * 4
            kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "offset", "length", "key"]
            )

    return find


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, rows, keys = None, [], []
    for batch in batches:
        hits = []
        for wanted in batch.to_pylist():
            place = wanted["file"], wanted["offset"], wanted["length"]
            if place != block:
                block, raw = place, _read(*place)
                rows = [json.loads(x) for x in zlib.decompress(raw).decode().split("\n")]
                keys = [r["key"] for r in rows]
            key = wanted["key"]
            hits += rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
        schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        yield pa.RecordBatch.from_pylist(hits, schema)


def _read(file: str, offset: int, length: int) -> bytes:
    fs, path = _open(file)
    with fs.open_input_file(path) as source:
        return source.read_at(length, offset)


def look_up(index: Index, keys: DataFrame) -> DataFrame:
    """The captures (CAPTURE) of the keys: ``keys`` has distinct non-null (key)."""
    # At most DIRECTORY entries, and one for each partition.
    entries = sorted((r.first, r.last, r.file, r.offset, r.length) for r in index.directory.collect())
    told = [e[0] for e in entries], [e[1] for e in entries], [e[2:] for e in entries]
    broadcast = keys.sparkSession.sparkContext.broadcast(told)
    return (
        keys.select("key")
        .mapInArrow(_find_blocks(broadcast), "file string, offset long, length long, key string")
        .repartition("file", "offset")
        .sortWithinPartitions("file", "offset", "key")
        .mapInArrow(_search_blocks, CAPTURE)
    )


def keys_of(pages: DataFrame, url: str = "url") -> DataFrame:
    """The distinct keys of a column of URLs."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reversed_host(u) for u in batch[url].to_pylist()], pa.string())], ["key"])

    return pages.select(url).mapInArrow(keys, "key string").distinct()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])
    for batch in batches:
        group: list[tuple[str, int, int]] = []
        for place in zip(*(batch[c].to_pylist() for c in ("file", "offset", "length")), strict=True):
            if group and not (
                place[0] == group[0][0]
                and place[1] - (group[-1][1] + group[-1][2]) <= MERGE_GAP
                and place[1] + place[2] - group[0][1] <= MERGE_BYTES
            ):
                yield pa.RecordBatch.from_pylist(_range(group), schema)
                group = []
            group.append(place)
        if group:
            yield pa.RecordBatch.from_pylist(_range(group), schema)


def _range(group: list[tuple[str, int, int]]) -> list[dict]:
    """The records of one range of a file, read at once."""
    begin = group[0][1]
    raw = _read(group[0][0], begin, group[-1][1] + group[-1][2] - begin)
    return [parse(raw[at - begin : at - begin + n]) for _, at, n in group]


def read_records(captures: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Neighbouring records are read in one range. A revisit has no payload of its own. Places
    are few bytes and records many, so the number of tasks goes by the bytes to read.
    """
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = captures.sparkSession.sparkContext.defaultParallelism
    return (
        captures.select("file", "offset", "length")
        .repartitionByRange(max(cores, -(-size // TASK_BYTES)), "file", "offset")
        .sortWithinPartitions("file", "offset")
        .mapInArrow(
            _records,
            "page_id long, url string, payload binary, payload_bytes long, "
            "payload_digest string, record_type string, refers_to long",
        )
    )
