"""Toxicity by class-conditional Kneser-Ney models of words in their contexts.

Each class, toxic and ordinary, has a model of the words of its documents, one after the
other. A word's own probability comes from how many documents of the class hold it; a
constant is taken off each count, and what that frees goes to the word's stem (its first
STEM characters) in the same class, and from there to how many different words of both
classes share the stem: backoff counts which both classes have in common, so a word whose
stem neither class has seen says nothing for either. The context is the word before, or the
mark that begins a text. Contexts and what follows them are counted by stems, which words
share: such pairs recur, so the table of them grows more slowly than the corpus, where that
of pairs of words grows with it. A pair's probability is an interpolated Kneser-Ney bigram
whose lower order counts before how many different stems a stem stands after.

A token's log ratio is that of its word's two probabilities plus how much more or less its
context makes of it in either class; of a pair that neither class has seen, the ratio of what
the two backoffs leave. All counted words, stems, contexts and pairs speak, for or against. A
document is judged by the log ratio of its two likelihoods for its length, what its words and
what their contexts bring to it weighed apart; by its strongest word and its strongest pair,
which a long text does not dilute; and by its length. A logistic curve on these makes the
score; it is fitted on documents that the counts have not seen.

A token's ratio is a sum over units (word, stem, context, pair), and so is a document's. The
units are a table. The most frequent ones, up to HOT of them, are broadcast and added up on
the spot; documents meet all others in a join.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import logistic
from ledgerline.llm.shared import Cache, held_out, only_ids
from ledgerline.llm.units import slices
from ledgerline.session import materialize

STEM = 4
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 4
CLASSES = ("ordinary", "toxic")
# What is added up or compared of a text.
TOLD = ("single", "context", "word", "pair")
# The log ratio from which ``evidence`` tells a unit.
LEAST_EVIDENCE = 2.0
# Units that are broadcast, at most, with three numbers each: 20 MB.
HOT = 2**20
# Bits of the map that says which other units there may be: 8 MB are broadcast.
MAP_BITS = 26
# Up to so many labelled ids are broadcast; with more, texts are shuffled.
BROADCAST_IDS = 4_000_000
# Up to so many stems with their counts are broadcast, some 20 MB; with more, the rows that
# meet them are shuffled.
BROADCAST_STEMS = 2**18
# Text that a task counts, or whose words it numbers, at the same time.
COUNT_BYTES = 2_000_000
LOOK_BYTES = 4_000_000
# Words that a task looks up at the same time; one takes some 300 bytes then.
RUN_WORDS = 2**17
# From so many pairs on, those of several slices are put together in a task; that takes 100
# bytes each.
WAITING_PAIRS = 500_000
# Labelled documents that the curve is fitted on, at most.
CALIBRATION_ROWS = 20_000

_edges = string.punctuation + "¡¿«»„“”‘’…–—"


def _unit(word: str) -> str:
    return word.strip(_edges)


def _hashed(unit: str) -> int:
    """As Spark's xxhash64 of a string, without a sign."""
    return xxhash.xxh64_intdigest(unit, 42)


# The context of a text's first word: no stem ends in two line feeds.
MARK = np.uint64(_hashed("\n\n"))


def sequences(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, number of each word in turn, where each text's words begin and end).

    Words are lower case, without punctuation around them.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    number: dict[str, int] = {}
    units = map(_unit, coded.dictionary.to_pylist())
    to = np.array([number.setdefault(u, len(number)) if u else -1 for u in units], np.int64)
    codes = to[coded.indices.to_numpy()]
    some = codes >= 0
    ends = np.concatenate([[0], np.cumsum(some)])[offsets - offsets[0]]
    return list(number), codes[some], ends


def _stems(words: list[str]) -> np.ndarray:
    """The hashes of the words' stems, and MARK after them."""
    stem = Cache(lambda s: _hashed(s + "\n"))
    return np.append(np.array([stem[w[:STEM]] for w in words], np.uint64), MARK)


def _before(codes: np.ndarray, ends: np.ndarray, mark: int) -> np.ndarray:
    """The number of the word before each word, ``mark`` for a text's first."""
    before = np.concatenate([[mark], codes[:-1]])[: len(codes)]
    before[ends[:-1][np.diff(ends) > 0]] = mark
    return before


def _pair(context: np.ndarray, stem: np.ndarray) -> np.ndarray:
    return context ^ ((stem << np.uint64(17)) | (stem >> np.uint64(47)))


def _pair_column(context: str, stem: str) -> F.Column:
    turned = F.shiftleft(stem, 17).bitwiseOR(F.shiftrightunsigned(stem, 47))
    return F.col(context).bitwiseXOR(turned)


def _pair_counts(context: np.ndarray, after: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different pairs, and the sums of their ``counts``, a row per class."""
    _, at, which = np.unique(_pair(context, after), return_index=True, return_inverse=True)
    sums = [np.bincount(which, n, len(at)).astype(np.int32) for n in counts]
    return context[at], after[at], np.stack(sums)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled documents, as far as seen here, per class: in how many a word is, and how
    often a stem (``after``) follows another (``context``).

    The pairs of several slices are put together before they are sent.
    """
    names = ["word", "context", "after", "ordinary", "toxic"]
    types = [pa.string(), *[pa.int64()] * 4]
    waiting: list[tuple[np.ndarray, ...]] = []

    def sent() -> pa.RecordBatch:
        together = [np.concatenate(x, axis=-1) for x in zip(*waiting)]
        waiting.clear()
        context, after, n = _pair_counts(*together)
        columns = [pa.nulls(len(context), pa.string()), *(pa.array(x.view(np.int64)) for x in (context, after))]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, n.astype(np.int64))], schema=pa.schema(zip(names, types)))

    for batch in batches:
        for first, size in slices(batch["text"], COUNT_BYTES):
            part = batch.slice(first, size)
            words, codes, ends = sequences(part["text"])
            toxic = part["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(len(toxic)), np.diff(ends))
            held = np.unique(of * max(1, len(words)) + codes)
            word, is_toxic = held % max(1, len(words)), toxic[held // max(1, len(words))]
            n = [np.bincount(word[is_toxic == c], minlength=len(words)) for c in (0, 1)]
            none = pa.nulls(len(words), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), none, none, *map(pa.array, n)], names)
            stems = _stems(words)
            of_class = np.stack([toxic[of] == c for c in (0, 1)])
            waiting.append(_pair_counts(stems[_before(codes, ends, len(words))], stems[codes], of_class))
            if sum(len(x[0]) for x in waiting) >= WAITING_PAIRS:
                yield sent()
    if waiting:
        yield sent()


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast in joins if it has BROADCAST_STEMS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_STEMS + 1).count() <= BROADCAST_STEMS else df


def _sums(df: DataFrame):
    """One row: per class the sum, the discount, the rows with a count, and all rows.

    Absolute discounts come from how many rows were seen once and twice.
    """
    sums = []
    for c in CLASSES:
        once, twice = F.count_if(F.col(c) == 1), F.count_if(F.col(c) == 2)
        discount = F.when(once > 0, once / (once + 2 * twice)).otherwise(F.lit(0.5))
        discount = F.least(F.greatest(discount, F.lit(0.1)), F.lit(0.9))
        sums += [
            F.greatest(F.sum(c), F.lit(1)).alias(f"n_{c}"),
            discount.alias(f"d_{c}"),
            F.count_if(F.col(c) > 0).alias(f"t_{c}"),
        ]
    return df.agg(*sums, F.greatest(F.count("*"), F.lit(1)).alias("types")).first()


def _discounted(c: str, m) -> F.Column:
    return F.greatest(F.col(c) - m[f"d_{c}"], F.lit(0.0)) / F.lit(m[f"n_{c}"])


def _freed(c: str, m) -> float:
    return max(m[f"d_{c}"] * m[f"t_{c}"], 0.5) / m[f"n_{c}"]


def single_units(counts: DataFrame) -> DataFrame:
    """(unit, weight, backed, toxic, n) from (word, ordinary, toxic): log ratios.

    Units are words, and stems followed by a line feed, which no word holds. A stem's log
    ratio is that of an unseen word with it. ``backed`` is what a word's stem says, null for
    stems; ``n`` counts both classes.
    """
    counts = counts.withColumn("stem", F.substring("word", 1, STEM))
    stems = materialize(
        counts.groupBy("stem").agg(
            F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.count("*").alias("kinds")
        )
    )
    of_words, of_stems = _sums(counts), _sums(stems)
    shared = F.col("kinds") / F.lit(of_words["types"])
    for c in CLASSES:
        stems = stems.withColumn(f"p_{c}", _discounted(c, of_stems) + F.lit(_freed(c, of_stems)) * shared)
    backed = counts.join(_small(stems.select("stem", "p_ordinary", "p_toxic", "kinds")), "stem")
    for c in CLASSES:
        backed = backed.withColumn(
            f"q_{c}",
            _discounted(c, of_words) + F.lit(_freed(c, of_words)) * F.col(f"p_{c}") / (F.col("kinds") + 1),
        )
    of_stem, n = F.log(F.col("p_toxic") / F.col("p_ordinary")), F.col("ordinary") + F.col("toxic")
    words = backed.select(
        F.col("word").alias("unit"), F.log(F.col("q_toxic") / F.col("q_ordinary")).alias("weight"),
        of_stem.alias("backed"), "toxic", n.alias("n"),
    )
    # An unseen word with this stem.
    unseen = F.concat("stem", F.lit("\n")).alias("unit")
    stems = stems.select(unseen, of_stem.alias("weight"), F.lit(None).cast("double").alias("backed"), "toxic", n.alias("n"))
    return words.union(stems)


def evidence(counts: DataFrame, least: float = LEAST_EVIDENCE) -> DataFrame:
    """(unit, weight) of the ``single_units`` that two toxic documents hold and whose log
    ratio is ``least`` or more: what tells most, to look at. Scores go by all units."""
    told = (F.col("weight") >= least) & (F.col("toxic") > 1)
    return single_units(counts).where(told).select("unit", "weight")


def pair_units(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, weight, n) and (context, after, weight, more, n) from (context, after, ordinary, toxic).

    A class's pair has the probability max(n - d, 0) / n(context) + left(context) * p(after),
    where left is the share that discounts free and p(after) goes by how many contexts the
    stem follows. The log of that over p(after) says what the context adds. Its ratio between
    the classes is ``weight`` of a context for what neither class has seen after it, ``more``
    of a pair, whose ``weight`` is the rest beyond its context's.
    """
    contexts = counts.groupBy("context").agg(
        F.sum(F.col("ordinary") + F.col("toxic")).alias("n"),
        *[F.sum(c).alias(f"n_{c}") for c in CLASSES],
        *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in CLASSES],
    )
    after = materialize(counts.groupBy("after").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in CLASSES]))
    of_pairs, of_after = _sums(counts), _sums(after)
    for c in CLASSES:
        left = F.lit(of_pairs[f"d_{c}"]) * F.col(f"t_{c}") / F.col(f"n_{c}")
        contexts = contexts.withColumn(f"left_{c}", F.when(F.col(f"n_{c}") > 0, left).otherwise(F.lit(1.0)))
        even = F.lit(_freed(c, of_after) / of_after["types"])
        after = after.withColumn(f"p_{c}", _discounted(c, of_after) + even)
    contexts = materialize(contexts.withColumn("weight", F.log(F.col("left_toxic") / F.col("left_ordinary"))))
    both = counts.join(_small(contexts.drop("n")), "context")
    both = both.join(_small(after.select("after", "p_ordinary", "p_toxic")), "after")
    for c in CLASSES:
        seen = F.greatest(F.col(c) - F.lit(of_pairs[f"d_{c}"]), F.lit(0.0)) / F.greatest(f"n_{c}", F.lit(1))
        both = both.withColumn(f"adds_{c}", seen / F.col(f"p_{c}") + F.col(f"left_{c}"))
    more = F.log(F.col("adds_toxic") / F.col("adds_ordinary"))
    pairs = both.select(
        "context", "after", (more - F.col("weight")).alias("weight"), more.alias("more"),
        (F.col("ordinary") + F.col("toxic")).alias("n"),
    )
    return contexts.select("context", "weight", "n"), pairs


def units(counts: DataFrame) -> DataFrame:
    """(unit, single, context, word, pair, n): hashes of all units, what a token with it adds
    to its text's log ratio by words and by contexts, and the whole log ratio of a word or a
    pair; from the rows of ``_count``.

    A stem's weight is there for each of its words, a word's is the rest beyond its stem's.
    """
    no, zero = F.lit(None).cast("double"), F.lit(0.0)
    single = single_units(counts.where("word is not null").select("word", *CLASSES))
    contexts, pairs = pair_units(counts.where("word is null").select("context", "after", *CLASSES))
    word = F.when(F.col("backed").isNotNull(), F.col("weight"))
    single = single.select(
        F.xxhash64("unit").alias("unit"), F.col("weight") - F.coalesce("backed", zero), zero, word, no, "n"
    )
    contexts = contexts.select(F.bitwise_not("context"), zero, "weight", no, no, "n")
    pairs = pairs.select(_pair_column("context", "after"), zero, "weight", no, "more", "n")
    rows = single.union(contexts).union(pairs).toDF("unit", *TOLD, "n")
    return rows.select("unit", *[F.col(c).cast("float").alias(c) for c in TOLD], "n")


def _heat(n: str) -> F.Column:
    """Classes of counts, 16 for each doubling."""
    return F.floor(16 * F.log2(n)).cast("int")


class Known(NamedTuple):
    """The most frequent units, by hash, and a map of where the others may be."""

    at: np.ndarray
    values: np.ndarray
    bits: np.ndarray

    def look(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``values`` for the units, zeros if there is none, and which units may
        be in the table otherwise."""
        if len(self.at):
            place = np.minimum(np.searchsorted(self.at, wanted), len(self.at) - 1)
            hit = self.at[place] == wanted
            values = np.where(hit[:, None], self.values[place], np.float32(0))
        else:
            hit, values = np.zeros(len(wanted), bool), np.zeros((len(wanted), 3), np.float32)
        bit = wanted >> np.uint64(64 - MAP_BITS)
        mapped = (self.bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
        return values, (mapped == 1) & ~hit


def _known(table: DataFrame, hot: int) -> tuple[Known, DataFrame]:
    """What to broadcast, of bounded size, and the other units."""
    warmest, more = None, 0
    # At most a thousand rows.
    for heat, n in sorted(map(tuple, table.groupBy(_heat("n").alias("heat")).count().collect()), reverse=True):
        if more + n > hot:
            break
        warmest, more = heat, more + n
    frequent = F.lit(False) if warmest is None else _heat("n") >= warmest
    rows = table.where(frequent).select(
        "unit", F.col("single") + F.col("context"), F.coalesce("word", F.lit(0.0)), F.coalesce("pair", F.lit(0.0))
    ).toArrow()
    at = rows.column(0).to_numpy().view(np.uint64)
    values = np.stack([rows.column(i).to_numpy().astype(np.float32) for i in (1, 2, 3)], axis=1)
    order = np.argsort(at)
    others = table.where(~frequent).drop("n")
    # At most 2^(MAP_BITS - 6) rows.
    place = F.shiftrightunsigned("unit", 64 - MAP_BITS)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = others.select(place.alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("at")).agg(F.bit_or(bit).alias("bits"))
    words = words.toArrow()
    bits = np.zeros(2 ** (MAP_BITS - 6), np.uint64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Known(at[order], values[order], bits), others


def _look(broadcast):
    """Per document its number of words, what the frequent units say, and the others."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Known = broadcast.value
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, size in slices(batch["text"], LOOK_BYTES):
                part = batch.slice(first, size)
                words, codes, ends = sequences(part["text"])
                stems, hashes = _stems(words), np.array([_hashed(w) for w in words], np.uint64)
                mark = len(words)
                del words
                looked = [(unit, *known.look(unit)) for unit in (hashes, stems, ~stems)]
                for i, j in _runs(ends, RUN_WORDS):
                    told = _told(known, looked, codes[ends[i] : ends[j]], ends[i : j + 1] - ends[i], mark)
                    row = pa.array(np.arange(at, at + j - i))
                    at += j - i
                    yield pa.RecordBatch.from_arrays(
                        [row, part["doc_id"].slice(i, j - i), *told], ["row", "doc_id", "n_words", *TOLD, "others"]
                    )

    return look


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Where runs of texts of ``most`` words at most begin and end. A longer text is a run of its own."""
    at = 0
    while at < len(ends) - 1:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, end
        at = end


def _told(known: Known, looked: list[tuple], codes: np.ndarray, ends: np.ndarray, mark: int) -> list[pa.Array]:
    """Per text its number of words, TOLD and the units that are to be joined.

    ``looked`` has what is known of words, stems and contexts by number of the word.
    """
    (_, stems, _), size = (x[0] for x in looked), len(ends) - 1
    before = _before(codes, ends, mark)
    pairs = _pair(stems[before], stems[codes])
    numbered = zip(looked, (codes, codes, before), (0, 0, 1))
    parts = [(*x, tokens, by) for x, tokens, by in numbered]
    parts.append((pairs, *known.look(pairs), np.arange(len(pairs)), 1))
    of = np.repeat(np.arange(size), np.diff(ends))
    sums, rest = np.zeros((len(codes), 4), np.float32), []
    for unit, values, others, tokens, by in parts:
        values = values[tokens]
        sums[:, by] += values[:, 0]
        np.maximum(sums[:, 2:], values[:, 1:], out=sums[:, 2:])
        others = np.flatnonzero(others[tokens])
        rest.append((of[others], unit[tokens[others]]))
    totals = [np.bincount(of, sums[:, i], size).astype(np.float64) for i in (0, 1)]
    strongest = np.zeros((size, 2))
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        strongest[full] = np.maximum.reduceat(sums[:, 2:], ends[full], axis=0)
    of, unit = map(np.concatenate, zip(*rest))
    order = np.argsort(of, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=size))])
    others = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(unit[order].view(np.int64)))
    return [pa.array(np.diff(ends)), *map(pa.array, [*totals, *strongest.T.copy()]), others]


def _features(df: DataFrame) -> list:
    length = F.col("n_words") + 20
    return [F.col("word"), F.col("pair"), F.col("single") / length, F.col("context") / length, F.log1p("n_words")]


def _learnt(docs: DataFrame, learnt: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """(text, toxic) of the documents whose ids are in ``learnt``."""
    if learnt.count() <= most:
        return docs.join(F.broadcast(learnt), "doc_id").select("text", "toxic")
    return only_ids(docs, "doc_id", learnt.select("doc_id")).join(learnt, "doc_id").select("text", "toxic")


def judge(docs: DataFrame, learnt: DataFrame, hot: int = HOT) -> DataFrame:
    """(row, doc_id, n_words, single, context, word, pair) of every row of ``docs``.

    ``single`` and ``context`` add up to the log ratio of the likelihoods that the classes of
    ``learnt`` (text, toxic 0 or 1) give the text. ``word`` and ``pair`` are the largest log
    ratios of its known words and pairs, 0 at least.
    """
    counted = learnt.mapInArrow(
        _count, "word string, context long, after long, ordinary long, toxic long"
    )
    counts = materialize(
        counted.groupBy("word", "context", "after").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    )
    told, others = _known(materialize(units(counts)), hot)
    broadcast = docs.sparkSession.sparkContext.broadcast(told)
    looked = materialize(
        docs.mapInArrow(
            _look(broadcast),
            f"row long, doc_id long, n_words long, {' double, '.join(TOLD)} double, others array<long>",
        )
    )
    per_row = (
        looked.select("row", F.explode("others").alias("unit"))
        .join(others, "unit")
        .groupBy("row")
        .agg(*[(F.max if c in ("word", "pair") else F.sum)(c).alias(f"rest_{c}") for c in TOLD])
    )
    judged = looked.drop("others").join(per_row, "row", "left").select(
        "row", "doc_id", "n_words",
        *[(F.col(c) + F.coalesce(f"rest_{c}", F.lit(0.0))).alias(c) for c in ("single", "context")],
        *[F.greatest(c, f"rest_{c}").alias(c) for c in ("word", "pair")],
    )
    return materialize(judged)


def score(
    docs: DataFrame,
    labels: DataFrame,
    calibration_rows: int = CALIBRATION_ROWS,
    hot: int = HOT,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learns from ``labels`` (doc_id, toxic 0 or 1) of documents that are not held out: those
    whose crc32 of the doc_id leaves 0 by 5; a null doc_id is held out. A null label is no
    label; a document that is labelled twice is toxic if one label says so. A null or empty
    text has no evidence. Without labels of both classes every score is 0. The ``hot`` units
    that are broadcast change no score.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out("doc_id", FOLDS, HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("calibrates", held_out("doc_id", FOLDS, CALIBRATION))
    )
    learnt = materialize(known.where("not calibrates").select("doc_id", "toxic"))
    judged = judge(docs, _learnt(docs, learnt), hot)
    sample = (
        judged.join(known.where("calibrates"), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "row")
        .limit(calibration_rows)
        .select(*[f.alias(f"f{i}") for i, f in enumerate(_features(judged))], "toxic")
    )
    rows = np.array([tuple(r) for r in sample.collect()], np.float64).reshape(-1, 6)
    both = len(set(rows[:, 5])) == 2 and learnt.select("toxic").distinct().count() == 2
    weights = logistic.fit(rows[:, :5], rows[:, 5], l2=0.1, steps=500) if both else None
    if weights is None:
        odds = F.lit(-50.0)
    else:
        odds = F.lit(float(weights[-1]))
        for w, f in zip(weights, _features(judged), strict=False):
            odds = odds + F.lit(float(w)) * f
    return judged.withColumn("score", 1 / (1 + F.exp(-odds))).select(
        "doc_id",
        held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without documents predicted toxic; null ids stay."""
    toxic = score(docs, labels).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(docs.columns)
