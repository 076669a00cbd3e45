"""Byte-level BPE encoding and decoding, each distinct word encoded once.

A pre-token is a match of the pattern. Blocks of documents are cut into pre-tokens; a block
lists its distinct ones and, per position, which of them stands there. Only the lists are
shuffled by the hash of the word, so that every distinct word of the corpus meets in one
place and is encoded there once; its ids go back to the blocks, where the documents are put
together by position. However common a word is, a block sends it once, so no word is a hot
key. What a block sends to one bucket of words is one compressed row.

Decoding looks every id up in the token-byte table (one row per rank, broadcast).

Blocks are cut twice, once for the words and once for the positions, which costs less than
shuffling the positions with the words would. Both passes number the words alike, as they
read the same splits; a check sum of the words in both makes sure of it.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.shared import Cache
from ledgerline.llm.units import SPLIT, numbers, ragged, slices

# A block's positions are in pieces with buckets below 0, in order; others are words, and
# their ids after encoding. Pieces are small, so that no row takes much memory.
PIECE_BYTES = 200_000
PACKED = "block long, bucket int, packed binary"
_NAMES = ["block", "bucket", "packed"]


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """The token-byte table of a rank file: (id, bytes)."""
    with open(path, "rb") as file:
        rows = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, file)]
    return spark.createDataFrame(rows, "id int, bytes binary")


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _row(block: int, bucket: int, packed: bytes) -> pa.RecordBatch:
    columns = [pa.array([block]), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _cut(pattern: str, buckets: int):
    """Blocks of documents: doc ids, lengths, positions, words, their hashes.

    Words are numbered by how often they occur, so that most positions are small numbers.
    """
    matches = regex.compile(pattern).findall

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        count = 0
        for batch in batches:
            for at, n in slices(batch["text"]):
                part = batch.slice(at, n)
                place: dict[str, int] = {}

                def make(text: str) -> list[int]:
                    return [place.setdefault(m, len(place)) for m in matches(text)]  # noqa: B023

                flat, start, length = numbers(part["text"], make)
                words = [w.encode() for w in place]
                del place
                flat = ragged(flat, start, length)
                order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
                words = [words[i] for i in order.tolist()]
                rank = np.empty(len(words), np.uint32)
                rank[order] = np.arange(len(words), dtype=np.uint32)
                sums = np.array([zlib.crc32(w) for w in words], np.uint32)
                block = (part["split"][0].as_py() << 24) + count
                yield block, part["doc_id"], length, rank[flat], words, sums
                count += 1

    return blocks


def _list_words(pattern: str, buckets: int):
    cut = _cut(pattern, buckets)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, _, words, sums in cut(batches):
            bucket = sums % buckets
            order = np.argsort(bucket, kind="stable").tolist()
            start = 0
            for b, n in enumerate(np.bincount(bucket, minlength=buckets).tolist()):
                if n:
                    part = [words[i] for i in order[start : start + n]]
                    sizes = np.array([n, *map(len, part)], "<u4")
                    yield _row(block, b, _pack(sizes.tobytes(), *part))
                start += n

    return words


def _positions(pattern: str, buckets: int):
    cut = _cut(pattern, buckets)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, length, flat, _, sums in cut(batches):
            missing = ids.is_null().to_numpy(zero_copy_only=False).astype("u1")
            head = np.array([len(sums), check_sum(sums), len(length), len(flat)], "<i8")
            ids = pc.fill_null(ids, 0).to_numpy().astype("<i8")
            # Positions byte by byte: the high bytes are mostly 0.
            planes = [(flat >> shift).astype("u1") for shift in (0, 8, 16, 24)]
            bucket = (sums % buckets).astype("<u4")
            arrays = head, ids, length.astype("<i8"), missing, bucket, *planes
            packed = _pack(*(x.tobytes() for x in arrays))
            pieces = -(-len(packed) // PIECE_BYTES)
            for i in range(pieces):
                yield _row(block, i - pieces, packed[i * PIECE_BYTES : (i + 1) * PIECE_BYTES])

    return positions


def check_sum(sums: np.ndarray) -> int:
    """Of the words' hashes in their order."""
    number = np.arange(1, len(sums) + 1, dtype=np.uint64)
    return int((sums.astype(np.uint64) * number).sum() % np.uint64(2**62))


def _encode_words(table, pattern: str):
    """Rows of words as rows of their hashes, numbers of ids and ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=table.value, special_tokens={}
        )
        known = Cache(lambda w: array("I", encoding.encode_ordinary(w.decode())).tobytes())
        for batch in batches:
            for block, bucket, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = _unpack(packed)
                n = int(np.frombuffer(raw, "<u4", 1)[0])
                ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
                edges = [4 + 4 * n, *ends.tolist()]
                words = [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]
                ids = [known[w] for w in words]
                sums = np.array([n, *map(zlib.crc32, words)], "<u4")
                counts = np.array([len(x) // 4 for x in ids], "<u4")
                yield _row(block, bucket, _pack(sums.tobytes(), counts.tobytes(), *ids))

    return encode


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each block, from its positions and then its words' ids by bucket."""
    block, body, found = None, [], []
    for batch in batches:
        columns = batch["block"].to_pylist(), batch["bucket"].to_pylist(), batch["packed"]
        for of, bucket, packed in zip(*columns, strict=True):
            if of != block:
                if block is not None:
                    yield from _documents(b"".join(body), found)
                block, body, found = of, [], []
            (body if bucket < 0 else found).append(packed.as_py())
    if block is not None:
        yield from _documents(b"".join(body), found)


def _documents(packed: bytes, found: list[bytes]) -> Iterator[pa.RecordBatch]:
    body = _unpack(packed)
    n_words, check, n, total = np.frombuffer(body, "<i8", 4).tolist()
    doc_ids = np.frombuffer(body, "<i8", n, 32)
    length = np.frombuffer(body, "<i8", n, 32 + 8 * n)
    missing = np.frombuffer(body, "u1", n, 32 + 16 * n).astype(bool)
    bucket = np.frombuffer(body, "<u4", n_words, 32 + 17 * n)
    at = 32 + 17 * n + 4 * n_words
    flat = np.zeros(total, np.uint32)
    for i in range(4):
        flat |= np.frombuffer(body, "u1", total, at + i * total).astype(np.uint32) << np.uint32(8 * i)
    sums, sizes, ids = [np.empty(0, "<u4")], [np.empty(0, "<u4")], [np.empty(0, "<i4")]
    for raw in map(_unpack, found):
        k = int(np.frombuffer(raw, "<u4", 1)[0])
        sums.append(np.frombuffer(raw, "<u4", k, 4))
        sizes.append(np.frombuffer(raw, "<u4", k, 4 + 4 * k))
        ids.append(np.frombuffer(raw, "<i4", offset=4 + 8 * k))
    by_bucket = np.argsort(bucket, kind="stable")
    sums, sizes, ids = np.concatenate(sums), np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
    if len(sums) != n_words:
        raise ValueError("a block's words and positions differ")
    place = np.empty(n_words, np.int64)
    place[by_bucket] = np.arange(n_words)
    starts = (np.cumsum(sizes) - sizes)[place]
    sums, sizes = sums[place], sizes[place]
    if check_sum(sums) != check:
        raise ValueError("a block's words and positions differ")
    ends = np.concatenate([[0], np.cumsum(length)])
    step = 1000
    for at in range(0, n, step):
        last = min(n, at + step)
        part = flat[ends[at] : ends[last]]
        out = ragged(ids, starts[part], sizes[part])
        per = np.concatenate([[0], np.cumsum(sizes[part])])[ends[at : last + 1] - ends[at]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids[at:last], mask=missing[at:last]),
                pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(out)),
            ],
            ["doc_id", "ids"],
        )


Batches = Iterator[pa.RecordBatch]


def encode(
    docs: DataFrame,
    table: DataFrame,
    pattern: str = SPLIT,
    then: Callable[[Batches], Batches] | None = None,
    schema: str = "doc_id long, ids array<int>",
) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``; null text: no ids.

    ``then`` is done with the Arrow batches of these in the same Python process, which
    saves handing them over, and gives rows of ``schema``.

    ``table`` is (id, bytes), a row per rank, as from ``ranks``. Every match of ``pattern``
    is encoded by itself; there are no special tokens.
    """
    # The number of the split, which both passes share; a task's number differs in a union.
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("split")
    )
    by_bytes = {bytes(r.bytes): r.id for r in table.collect()}  # a row per rank
    broadcast = docs.sparkSession.sparkContext.broadcast(by_bytes)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = (
        docs.mapInArrow(_list_words(pattern, buckets), PACKED)
        .repartition("bucket")
        .mapInArrow(_encode_words(broadcast, pattern), PACKED)
    )
    return (
        docs.mapInArrow(_positions(pattern, buckets), PACKED)
        .union(ids)
        .repartition("block")
        .sortWithinPartitions("block", "bucket")
        .mapInArrow(lambda batches: then(_assemble(batches)) if then else _assemble(batches), schema)
    )


def _decode(table):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, sizes = table.value
        for batch in batches:
            lists = batch["ids"]
            ids = lists.flatten().to_numpy()
            text = ragged(flat, starts[ids], sizes[ids])
            per = np.concatenate([[0], np.cumsum(sizes[ids])])
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            offsets = per[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            decoded = pa.BinaryArray.from_buffers(
                pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(text)]
            )
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, decoded], ["doc_id", "ids", "decoded"])

    return decode


def decoding(table: DataFrame) -> Callable[[Batches], Batches]:
    """What adds to batches of (doc_id, ids) the bytes that the ids stand for, as ``decoded``."""
    rows = sorted((r.id, bytes(r.bytes)) for r in table.collect())
    size = np.zeros(rows[-1][0] + 1, np.int64)
    size[[i for i, _ in rows]] = [len(b) for _, b in rows]
    flat = np.frombuffer(b"".join(b for _, b in rows), np.uint8)
    return _decode(table.sparkSession.sparkContext.broadcast((flat, np.cumsum(size) - size, size)))


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, see ``decoding``."""
    schema = "doc_id long, ids array<int>, decoded binary"
    return encoded.select("doc_id", "ids").mapInArrow(decoding(table), schema)
