"""Near-duplicate texts by an LSH forest over word shingles.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Documents
with equal sets are one class; one document stands for it. Its MinHash signature is read
in TREES different orders of columns. Rows sorted by such an order stand beside those
that share the longest prefix, and a run of rows that share at least MIN_DEPTH columns is
a region. The depth of a region adapts to the crowd: a document first meets the most
central document of the deepest run in which it has company, then that of its whole region,
where central is who has most company in all its regions.

Those first meetings are confirmed on the full sets, and what they link is one group.
Regions whose members are not all in one group yet are then completed. A prefix filter on
the members' full sets says exactly which of them may still be linked with another group:
those that share most of their shingles with others, and among them those that have one of
their rarest shingles in common are a family. In a family every member outside the largest
group is compared with every other member. That is done block by block on the members' sets:
a pair of blocks is a task, and out of it come links that span what it found, not pairs. So
no pair of a region is left out, and no rows are made for the pairs of a group.

A pair with a similarity of 0.75 shares no region with probability
(1 - 0.75^4)^32 = 5e-6, a more similar one with less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.shared import Cache, arrow_rows, only_ids
from ledgerline.session import materialize

WORDS = 5
SIMILARITY = 75  # per cent
COLUMNS = 96
TREES = 32
MIN_DEPTH = 4
MAX_DEPTH = 10
BLOCK = 512
# Of a shingle's 64 bits those that tokens do without: fewer bytes in the shuffle.
TOKEN_SHIFT = np.uint64(28)
# Columns of the matrices that hold two blocks' sets: at most 16 MB each.
SHINGLES_AT_ONCE = 8192

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 2**63, COLUMNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.stack([_rng.permutation(COLUMNS)[:MAX_DEPTH] for _ in range(TREES)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Shingle sets of texts, with a cache of the words' hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, Cache(xxhash.xxh64_intdigest)

    def of(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct hashes; A-Z count as a-z, a short text is one shingle."""
        tokens = (text or b"").lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        h = np.array([self.hashes[w] for w in tokens], np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * _STEP + _mixed(h[i : len(h) - n + 1 + i])
        return np.unique(_mixed(out))


def _signature(shingles: np.ndarray) -> bytes:
    low = np.full(COLUMNS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _MULTIPLY
        low = np.minimum(low, part.min(axis=0))
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sign(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(words).of
        for batch in batches:
            sets = [of(t) for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_name(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "name", "signature"],
            )

    return sign


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per tree: its number, the signature in its order, the representative."""
    width = 2 * MAX_DEPTH
    for table in arrow_rows(batches, 1000):
        n = table.num_rows
        rows = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u4")
        rows = (rows.reshape(n, COLUMNS) >> 16).astype(">u2")
        keys = rows[:, _ORDERS].tobytes()
        for at in range(0, n, 1000):
            m = min(1000, n - at)
            part = pa.py_buffer(keys[at * TREES * width : (at + m) * TREES * width])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(TREES, dtype=np.int32), m)),
                    pa.FixedSizeBinaryArray.from_buffers(
                        pa.binary(width), m * TREES, [None, part]
                    ).cast(pa.binary()),
                    pa.array(np.repeat(table["rep"].to_numpy()[at : at + m], TREES)),
                ],
                ["tree", "key", "rep"],
            )


def _company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, those with company: the region and the deepest run of each.

    The first and last rows of a partition count as having company at any depth, as
    their neighbours may be in another partition.
    """
    width = 2 * (MAX_DEPTH + 2)
    tail = None  # the last row, whose right neighbour is still to come, and its left prefix
    pieces = (t for t in arrow_rows(batches, 20_000))
    piece = next(pieces, None)
    while piece is not None:
        following = next(pieces, None)
        n = piece.num_rows
        tree = piece["tree"].to_numpy().astype(">i4")
        key = np.frombuffer(b"".join(piece["key"].to_pylist()), np.uint8).reshape(n, 2 * MAX_DEPTH)
        key = np.hstack([tree.view(np.uint8).reshape(n, 4), key])
        rep = piece["rep"].to_numpy()
        if tail is not None:
            key, rep = np.vstack([tail[0][None], key]), np.concatenate([[tail[1]], rep])
        # Columns in common with the row before; the tree counts as two.
        same = (key[1:] == key[:-1]).reshape(len(key) - 1, width // 2, 2).all(axis=2)
        shared = np.where(same.all(axis=1), MAX_DEPTH, same.argmin(axis=1) - 2)
        first = MAX_DEPTH if tail is None else tail[2]
        left = np.concatenate([[first], shared])
        right = np.concatenate([shared, [MAX_DEPTH]])
        if following is not None:
            tail = (key[-1], rep[-1], left[-1])
            key, rep, left, right = key[:-1], rep[:-1], left[:-1], right[:-1]
        depth = np.maximum(left, right)
        at = np.flatnonzero(depth >= MIN_DEPTH)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([xxhash.xxh64_intdigest(key[i, : 4 + 2 * MIN_DEPTH].tobytes()) - 2**63 for i in at], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(key[i, : 4 + 2 * depth[i]].tobytes()) - 2**63 for i in at], pa.int64()),
                pa.array(rep[at].astype(np.int64)),
            ],
            ["region", "run", "rep"],
        )
        piece = following


def _confirm(words: int, similarity: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(words).of

        def named(text: bytes) -> tuple[np.ndarray, bytes]:
            shingles = of(text)
            return shingles, _name(shingles)

        for batch in batches:
            links: list[tuple[int, int]] = []
            last = None, None
            left, right = (batch[c].cast(pa.binary()).to_pylist() for c in ("text_a", "text_b"))
            ids = zip(*(batch[c].to_pylist() for c in ("a", "b", "name_a", "name_b")), strict=True)
            for (a, b, name_a, name_b), ta, tb in zip(ids, left, right, strict=True):
                if last[0] != tb:
                    last = tb, named(tb)
                x, y = named(ta), last[1]
                if (x[1], y[1]) != (name_a, name_b):
                    continue  # another text under the same id
                both = len(np.intersect1d(x[0], y[0], assume_unique=True))
                if 100 * both >= similarity * (len(x[0]) + len(y[0]) - both):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

    return confirm


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(words).of
        for batch in batches:
            found = [of(t) for t in batch["text"].cast(pa.binary()).to_pylist()]
            right = [i for i, (x, n) in enumerate(zip(found, batch["name"].to_pylist(), strict=True)) if _name(x) == n]
            part = batch.take(pa.array(right, pa.int64())).select(["rep", "part", "family", "lefts", "rights", "stray"])
            yield part.append_column("shingles", pa.array([found[i].tobytes() for i in right], pa.binary()))

    return sets


def _compare(similarity: int):
    """Spanning links between one block of a family's strays and one of its members."""

    def compare(table: pa.Table) -> pa.Table:
        side = table["left"].to_numpy(zero_copy_only=False).astype(bool)
        rep, part = table["rep"].to_numpy(), table["part"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        shingle, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Shingles of one set are in no intersection.
        number = np.cumsum(seen > 1) - 1
        keep = seen[place] > 1
        owner, place = owner[keep], number[place[keep]]
        both = np.zeros((len(left), len(right)), np.float32)
        row = np.empty(len(sets), np.int64)
        row[left], row[right] = np.arange(len(left)), np.arange(len(right))
        for at in range(0, int((seen > 1).sum()), SHINGLES_AT_ONCE):
            some = (place >= at) & (place < at + SHINGLES_AT_ONCE)
            sides = []
            for which, n in ((side, len(left)), (~side, len(right))):
                mine = some & which[owner]
                has = np.zeros((n, SHINGLES_AT_ONCE), np.float32)
                has[row[owner[mine]], place[mine] - at] = 1
                sides.append(has)
            both += sides[0] @ sides[1].T
        either = sizes[left][:, None] + sizes[right][None, :] - both
        near = (100 * both >= similarity * either) & (part[left][:, None] != part[right][None, :])
        x, y = np.nonzero(near)
        reach = rep.copy()
        while True:
            new = reach.copy()
            np.minimum.at(new, left[x], reach[right[y]])
            np.minimum.at(new, right[y], reach[left[x]])
            if (new == reach).all():
                break
            reach = new
        at = np.unique(np.concatenate([left[x], right[y]]))
        return pa.table({"a": rep[at], "b": reach[at]})

    return compare


def _tokens(words: int):
    """Of the rows whose text has the set of that name: the set's size and shingles, shortened.

    Shingles that look the same when shortened only count as one more common one.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingles(words).of
        for batch in batches:
            rep, part = batch["rep"].to_numpy(), batch["part"].to_numpy()
            for at, (text, name) in enumerate(zip(batch["text"].cast(pa.binary()), batch["name"].to_pylist(), strict=True)):
                shingles = of(text.as_py())
                if _name(shingles) != name:
                    continue  # another text under the same id
                n = len(shingles)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, x, np.int64)) for x in (rep[at], part[at], n)] + [pa.array((shingles >> TOKEN_SHIFT).astype(np.int64))],
                    ["rep", "part", "n", "token"],
                )

    return tokens


def _may_link(named: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """(rep, part, b): members of ``named`` that may be linked with another part's share a b.

    A link needs ``similarity`` per cent of either set. So a member that shares fewer of its
    shingles with other parts has none; and in any order of all shingles, the first one that
    two linked sets have in common is among the first 100 - ``similarity`` per cent of both.
    The order is from rare to frequent, shingles of one part only before all others.
    """
    tokens = named.join(texts, named.rep == texts.doc_id).select("rep", "part", "name", "text").mapInArrow(
        _tokens(words), "rep long, part long, n long, token long"
    )
    holders = W.partitionBy("token")
    seen = tokens.withColumns(
        {"low": F.min("part").over(holders), "high": F.max("part").over(holders), "df": F.count("*").over(holders)}
    )
    shared = materialize(seen.where("low < high").select("rep", "part", "n", "token", "df"))
    least = F.ceil(F.lit(similarity) * F.col("n") / 100)
    enough = shared.groupBy("rep", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    place = F.row_number().over(W.partitionBy("rep").orderBy("df", "token")) + F.col("n") - F.col("shared")
    enough = materialize(enough.select("rep", "shared"))
    first = only_ids(shared, "rep", enough.select("rep")).join(enough, "rep").withColumn("place", place)
    first = materialize(first.where(F.col("place") <= F.col("n") - least + 1).select("rep", "part", "token"))
    met = first.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("rep").alias("b"))
    return first.join(met.where("low < high").select("token", "b"), "token").select("rep", "part", "b").distinct()


def _completed(members: DataFrame, reps: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links (a, b) of families, between members (region, rep, part) of different parts."""
    parts = members.groupBy("region").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    several = parts.where("low < high").select("region")
    crowd = materialize(members.join(several, "region").select("rep", "part").distinct())
    named = crowd.join(reps.select("rep", "name"), "rep")
    open_ = materialize(_may_link(named, only_ids(docs, "doc_id", crowd.select("rep")), words, similarity))
    family = components(open_.select(F.col("rep").alias("a"), "b"))
    of = open_.select("rep", "part").distinct().join(family, open_.rep == family.node).select(
        "rep", "part", F.col("component").alias("family")
    )
    counts = materialize(of.groupBy("family", "part").count())
    sizes = counts.groupBy("family").agg(
        F.max(F.struct("count", "part")).alias("top"), F.sum("count").alias("members")
    )
    strays = F.col("members") - F.col("top.count")
    sizes = sizes.select(
        "family",
        F.col("top.part").alias("top"),
        F.ceil(strays / BLOCK).cast("int").alias("lefts"),
        F.ceil(F.col("members") / BLOCK).cast("int").alias("rights"),
    )
    of = materialize(of.join(sizes.where("lefts > 0"), "family").withColumn("stray", F.col("part") != F.col("top")).drop("top"))
    texts = only_ids(docs, "doc_id", of.select("rep"))
    named = of.join(reps.select("rep", "name"), "rep")
    shingled = named.join(texts, named.rep == texts.doc_id).select(
        "rep", "part", "family", "lefts", "rights", "stray", "name", "text"
    ).mapInArrow(_sets(words), "rep long, part long, family long, lefts int, rights int, stray boolean, shingles binary")
    # Every block of strays meets every block of members.
    own = F.xxhash64("rep")
    lefts = F.when(F.col("stray"), F.transform(
        F.sequence(F.lit(0), F.col("rights") - 1),
        lambda r: F.struct(F.lit(True).alias("left"), F.pmod(own, "lefts").cast("int").alias("l"), r.alias("r")),
    ))
    rights = F.transform(
        F.sequence(F.lit(0), F.col("lefts") - 1),
        lambda l: F.struct(F.lit(False).alias("left"), l.alias("l"), F.pmod(own, "rights").cast("int").alias("r")),
    )
    sides = F.concat(F.coalesce(lefts, F.array().cast("array<struct<left:boolean,l:int,r:int>>")), rights)
    blocks = shingled.select("family", "rep", "part", "shingles", F.explode(sides).alias("s")).select("family", "s.*", "rep", "part", "shingles")
    return blocks.groupBy("family", "l", "r").applyInArrow(_compare(similarity), "a long, b long")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select("a").union(pairs.select("b"))
    texts = only_ids(docs, "doc_id", ids)
    names = reps.select("rep", "name")

    def side(x: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))

    named = pairs
    for x in ("a", "b"):
        named = named.join(names.select(F.col("rep").alias(x), F.col("name").alias(f"name_{x}")), x)
    return (
        named.join(side("a"), "a")
        .join(side("b"), "b")
        .sortWithinPartitions("b")
        .mapInArrow(_confirm(words, similarity), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    ``docs`` has an integer doc_id and text. A null, empty or blank text has no
    shingles and links with nothing. Rows that share a doc_id are one document. A row
    without doc_id links others but is in no component: component_id null, kept true.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(
        docs.mapInArrow(
            _sign(words), "doc_id long, n_shingles long, name binary, signature binary"
        )
    )
    classes = signed.where("name is not null and doc_id is not null").groupBy("name")
    reps = materialize(
        classes.agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    )
    company = materialize(
        reps.mapInArrow(_orders, "tree int, key binary, rep long")
        .repartitionByRange("tree", "key", "rep")
        .sortWithinPartitions("tree", "key", "rep")
        .mapInArrow(_company, "region long, run long, rep long")
    )

    crowd = company.groupBy("region").agg(F.count("*").alias("n"))
    central = company.join(crowd, "region").groupBy("rep").agg(F.sum("n").alias("n"))
    company = materialize(company.join(central, "rep"))

    def leaders(by: str) -> DataFrame:
        most = company.groupBy(by).agg(F.max(F.struct(F.col("n"), -F.col("rep"))).alias("top"))
        met = company.join(most.select(by, (-F.col("top.col2")).alias("b")), by)
        return met.where("rep != b").select(F.col("rep").alias("a"), "b")

    # Of those a document meets, the one it meets in most trees, then the smallest.
    met = leaders("run").union(leaders("region")).groupBy("a", "b").count()
    chosen = met.groupBy("a").agg(F.max(F.struct("count", -F.col("b"))).alias("best"))
    first = materialize(chosen.select("a", (-F.col("best.col2")).alias("b")))
    linked = materialize(_confirmed(first, reps, docs, words, similarity))
    group = components(linked)

    members = company.select("region", "rep").distinct()
    members = materialize(
        members.join(group, members.rep == group.node, "left").select(
            "region", "rep", F.coalesce("component", "rep").alias("part")
        )
    )
    found = components(linked.union(_completed(members, reps, docs, words, similarity)))

    named = reps.join(found, reps.rep == found.node, "left").select(
        "name", F.coalesce("component", "rep").alias("component")
    )
    return (
        signed.join(named, "name", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates, all columns: of a group its smallest doc_id.

    Rows that share a doc_id count as one document, of which one row stays.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    nameless = left.where("doc_id is null")
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).union(nameless)
