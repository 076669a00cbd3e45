"""Hierarchical residual packing of token sequences by best fit.

Every partition tokenizes its documents and packs the pieces by best fit, longest first.
Sequences with at most SLACK free tokens are finished; the others go on as items. Round by
round, FAN_IN nodes merge into one and pack the items again, until one node is left. After a
round that joins fewer than one in GAIN of its items only those go on that can still matter:
the items at most half full (every join needs one, and a node leaves one at most) and as many
of the emptiest others. That ends when no two unfinished sequences fit together. A node takes NODE_ITEMS items on average at
least, and no round has fewer nodes than that needs, so no task grows with the table.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm.units import SPLIT
from ledgerline.session import materialize

MAX_LENGTH = 2048
END = 0
SLACK = 16
FAN_IN = 8
NODE_ITEMS = 50_000
GAIN = 200

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
BINS = f"fill int, pieces array<{PIECE}>, node long, place long"
_PIECES = pa.list_(
    pa.struct(
        [
            ("doc_id", pa.int64()),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )
)


def _characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@cache
def _by_rank(path: str) -> Callable[[str], list[int]] | None:
    """An encoder by ranks that equals the tokenizers file; None unless that is certain.

    It is if merging always prefers the pair with the smaller id, and nothing changes the
    text before the usual byte-level split.
    """
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, split = told["model"], told["pre_tokenizer"] or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [model["vocab"].get("".join(m), -1) for m in merges] if model["type"] == "BPE" else []
    plain = (
        split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and not told["normalizer"]
        and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "unk_token",
                                           "continuing_subword_prefix", "end_of_word_suffix"))
    )
    if not plain or not made or made != sorted(set(made)) or made[0] < 0:
        return None
    byte, special = _characters(), {t["content"] for t in told["added_tokens"]}
    ranks = {
        bytes(byte[c] for c in token): id
        for token, id in model["vocab"].items()
        if token not in special
    }
    if len(ranks) != 256 + len(merges):
        return None
    return tiktoken.Encoding(
        "file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """Texts to ids by a tokenizers file, without special tokens."""
    encode = _by_rank(path)
    if encode is not None:
        return encode
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each to the fullest bin that takes it.

    ``free`` has a bit for each amount of free room that some bin has.
    """
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    free = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            bin_ = with_room[room].pop()
            if not with_room[room]:
                free &= ~(1 << room)
            bins[bin_].append(i)
            room -= n
        else:
            bin_, room = len(bins), capacity - n
            bins.append([i])
        if room:
            with_room[room].append(bin_)
            free |= 1 << room
    return bins


def _packed(items: list[tuple[int, list]], capacity: int, node: int) -> pa.RecordBatch:
    bins = best_fit([n for n, _ in items], capacity)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([sum(items[i][0] for i in b) for b in bins], pa.int32()),
            pa.array([[p for i in b for p in items[i][1]] for b in bins], _PIECES),
            pa.array([node] * len(bins), pa.int64()),
            pa.array(range(len(bins)), pa.int64()),
        ],
        ["fill", "pieces", "node", "place"],
    )


def _cut(doc_id, ids: bytes, capacity: int) -> Iterator[tuple]:
    """Pieces of a document; only the first may be shorter than the capacity."""
    n = len(ids) // 4
    start, stop = 0, n if n <= capacity else n % capacity or capacity
    piece = 0
    while start < n:
        yield doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])
        start, stop, piece = stop, stop + capacity, piece + 1


def _pack_texts(tokenizer: str, capacity: int, end: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, node = encoder(tokenizer), TaskContext.get().partitionId()
        items, full = [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end)
                for piece in _cut(doc_id, ids.tobytes(), capacity):
                    (full if piece[3] == capacity else items).append((piece[3], [piece]))
        yield _packed(full + items, capacity, node)

    return pack


def _pack_bins(capacity: int):
    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for batch in batches:
            pieces = [[tuple(p.values()) for p in x] for x in batch["pieces"].to_pylist()]
            items += zip(batch["fill"].to_pylist(), pieces, strict=True)
        items.sort(key=lambda x: (-x[0], str(x[1][0])))
        yield _packed(items, capacity, key[0].as_py())

    return pack


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece, with the sum of the lengths before it in its sequence."""
    for batch in batches:
        lists = batch["pieces"]
        sequence = pc.list_parent_indices(lists)
        pieces = lists.flatten()
        columns = [pieces.field(i) for i in range(5)]
        length = columns[3].to_numpy()
        before = np.cumsum(length) - length
        counts = np.diff(lists.offsets.to_numpy())
        first = np.repeat(np.cumsum(counts) - counts, counts)
        offset = pa.array(before - before[first] if len(before) else before)
        yield pa.RecordBatch.from_arrays(
            [*columns, batch["sequence_id"].take(sequence), offset],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def _going_on(fills: dict[int, int], capacity: int) -> tuple[int, int] | None:
    """(fill, one in): items up to this fill go on, of those of this fill one in so many.

    ``fills`` has how many items have each fill. None if no two fit together.
    """
    small = sum(n for fill, n in fills.items() if 2 * fill <= capacity)
    if not small:
        return None
    least = min(fills)
    # Any two small items fit together; a single one needs room in another item.
    fit, found = capacity // 2, 0
    for fill in sorted(f for f in fills if 2 * f > capacity and f + least <= capacity):
        fit, found = fill, found + fills[fill]
        if found >= small:
            break
    if small == 1 and not found:
        return None
    return fit, max(1, fills[fit] // (4 * small + 16)) if found else 1


def pack_bins(bins: DataFrame, capacity: int = MAX_LENGTH, slack: int = SLACK) -> DataFrame:
    """The rounds after the first: (fill, pieces, node, place) of finished sequences."""
    done: list[DataFrame] = []
    level, few = 0, False
    nodes = bins.agg(F.max("node")).first()[0]
    while True:
        finished = bins.where(F.col("fill") >= capacity - slack)
        done.append(finished.withColumn("level", F.lit(level)))
        left = bins.where(F.col("fill") < capacity - slack)
        # At most ``capacity`` rows.
        fills = {r["fill"]: r["count"] for r in left.groupBy("fill").count().collect()}
        if not fills or (nodes == 0 and not few):
            break
        if few:
            choice = _going_on(fills, capacity)
            if choice is None:
                break
            some = F.pmod(F.xxhash64("node", "place", F.lit(-level)), F.lit(choice[1])) == 0
            goes = (F.col("fill") < choice[0]) | ((F.col("fill") == choice[0]) & some)
            done.append(left.where(~goes).withColumn("level", F.lit(level)))
            # Each small item takes the room of one other at most, and as many go on that
            # have at least the room of those that stay.
            left = left.where(goes)
        count = left.count() if few else sum(fills.values())
        nodes = max(nodes // FAN_IN, count // NODE_ITEMS)
        # Other neighbours in each round: a node's items come from all over.
        node = F.pmod(F.xxhash64("node", "place", F.lit(level)), F.lit(nodes + 1))
        bins = materialize(
            left.withColumn("node", node).groupBy("node").applyInArrow(_pack_bins(capacity), BINS)
        )
        level += 1
        few = few or bins.count() * GAIN > count * (GAIN - 1)
    done.append(left.withColumn("level", F.lit(level)))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = MAX_LENGTH,
    end: int = END,
    slack: int = SLACK,
) -> DataFrame:
    """A row per piece of a document: where it is, and in which sequence.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset). ``tokenizer`` is the
    path of a tokenizers file on the executors. A document is its ids and then ``end``, so
    null and empty texts have one token. Repeated rows are packed as often as they occur.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = materialize(docs.mapInArrow(_pack_texts(tokenizer, capacity, end), BINS))
    sequences = pack_bins(first, capacity, slack)
    # Unique: a level has under 2^20 nodes of under 2^36 bins.
    name = F.col("level") * 2**56 + F.col("node") * 2**36 + F.col("place")
    return sequences.select(name.cast("long").alias("sequence_id"), "pieces").mapInArrow(
        _placed,
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long",
    )
