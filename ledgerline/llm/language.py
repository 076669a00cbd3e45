"""Language identification by interpolated Kneser-Ney models of characters.

A model per language gives the probability of each letter of a word after up to ORDER - 1
letters, where a word begins and ends with a mark. Counts of the longest grams are exact
over all documents to learn from; shorter ones count in how many different longer ones
they stand, as Kneser and Ney have it, and each order is interpolated with the next.

Models are sorted arrays of 64-bit hashes of the grams with their counts: an entry per
different gram, so that they grow with what the corpus holds (about 12 bytes an entry; some
10,000 four-letter grams for a language with a small alphabet). They pass through the driver
and are broadcast whole; a language of millions of grams costs tens of megabytes on each
executor, and there is no other way for it here. A document's language is the one with the
lowest cross-entropy per letter. The posterior of the languages, at a temperature fitted on
labelled documents, is the score; below ``reject_below`` the prediction counts as rejected.

Texts are split and their words numbered a batch at a time; each different word is looked at
once, and documents are sums over numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import Cache, held_out
from ledgerline.llm.units import slices
from ledgerline.session import materialize

ORDER = 4
FOLDS = 4
HELD_OUT = 2
DISCOUNT = 0.75
UNSEEN = 2.0**-16  # of a letter that no document holds
REJECT_BELOW = 0.5
# Different labelled documents that the temperature is fitted on, at most.
TEMPERATURE_ROWS = 500
# Different words of all languages that a task counts before it tells them.
FLUSH = 400_000
WORDS_AT_ONCE = 300_000


def letters(word: str) -> str:
    """The word's letters, lower case."""
    return (word if word.isalpha() else "".join(filter(str.isalpha, word))).lower()


def grams(word: str) -> list[str]:
    marked = "\x02" * (ORDER - 1) + word + "\x03"
    return [marked[i : i + ORDER] for i in range(len(word) + 1)]


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each word, where each text's words begin and end, the different words)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), offsets - offsets[0], coded.dictionary.to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest grams per language, as far as seen here."""
    clean = Cache(letters)
    words: dict[str, dict[str, int]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counted in words.items():
            per_gram: Counter = Counter()
            for word, n in counted.items():
                if word := clean[word]:
                    for g in grams(word):
                        per_gram[g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(per_gram), pa.string()), pa.array(per_gram.keys(), pa.string()), pa.array(per_gram.values(), pa.int64())],
                ["lang", "gram", "n"],
            )
        words.clear()

    for batch in batches:
        for first, size in slices(batch["text"]):
            part = batch.slice(first, size)
            codes, ends, known = _numbered(part["text"])
            langs = part["lang"].dictionary_encode()
            of = np.repeat(langs.indices.to_numpy(), np.diff(ends))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                times = np.bincount(codes[of == i], minlength=len(known))
                counted = words.setdefault(lang, {})
                some = np.flatnonzero(times)
                for word, n in zip([known[j] for j in some.tolist()], times[some].tolist()):
                    counted[word] = counted.get(word, 0) + n
            if sum(map(len, words.values())) > FLUSH:
                yield from told()
    yield from told()


def _hashed(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram, 42)


class Model:
    """The languages' sorted hash arrays."""

    def __init__(self, langs: list[str], tables: list[list[tuple]]):
        # Per order, from 1: per language (hashes, counts) and (contexts, totals, kinds).
        self.langs, self.tables = langs, tables

    def score(self, grams: list[str]) -> np.ndarray:
        """Log probabilities of the grams' last letters, a row per gram."""
        p = np.full((len(grams), len(self.langs)), UNSEEN)
        for order, per_lang in enumerate(self.tables, 1):
            keys = np.array([_hashed(g[ORDER - order :]) for g in grams], np.uint64)
            contexts = np.array([_hashed(g[ORDER - order : -1]) for g in grams], np.uint64)
            for i, (at, n, context, total, kinds) in enumerate(per_lang):
                seen = _look_up(at, n, keys)
                whole, many = _look_up(context, total, contexts), _look_up(context, kinds, contexts)
                known = whole > 0
                whole = np.where(known, whole, 1)
                longer = np.maximum(seen - DISCOUNT, 0) / whole + DISCOUNT * many / whole * p[:, i]
                p[:, i] = np.where(known, longer, p[:, i])
        return np.log(np.maximum(p, 1e-30)).astype(np.float32)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def learn(docs: DataFrame) -> Model:
    """The models of all values of lang in ``docs`` (text, lang)."""
    counted = docs.select("text", "lang").where("lang is not null and text is not null").mapInArrow(
        _count, "lang string, gram string, n long"
    )
    longest = materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in longest.select("lang").distinct().collect())
    tables, level = [], longest
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # in how many different longer grams it stands
            shorter = F.expr("substring(gram, 2)")
            level = level.groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n"))
        context = F.expr(f"substring(gram, 1, {order - 1})").alias("gram")
        contexts = level.groupBy("lang", context).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
        parts = [_arrays(df, langs) for df in (level, contexts)]
        tables.append([(*seen, *of) for seen, of in zip(*parts)])
    return Model(langs, tables[::-1])


def _arrays(df: DataFrame, langs: list[str]) -> list[list[np.ndarray]]:
    """Per language the sorted hashes of the grams of ``df`` and its other columns."""
    numbers = [c for c in df.columns if c not in ("lang", "gram")]
    rows = df.select("lang", F.xxhash64("gram").alias("at"), *numbers).toArrow()
    out = []
    for lang in langs:
        part = rows.filter(pc.equal(rows["lang"], lang))
        at = part["at"].to_numpy().view(np.uint64)
        order = np.argsort(at)
        out.append([at[order], *(part[c].to_numpy()[order].astype(np.float32) for c in numbers)])
    return out


class _Words:
    """Sums over words of the grams' log probabilities, kept for words met again."""

    def __init__(self, model: Model):
        self.model, self.clean = model, Cache(letters)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.gram: dict[str, int] = {}
        self.grams = np.zeros((0, len(self.model.langs)), np.float32)
        self.sums = np.zeros((0, len(self.model.langs)), np.float32)
        self.sizes = np.zeros(0, np.float32)

    def learn(self, words: list[str]) -> None:
        lists = [grams(c) if (c := letters(w)) else [] for w in words]
        new = list({g for x in lists for g in x if g not in self.gram})
        if new:
            self.gram.update(zip(new, range(len(self.gram), len(self.gram) + len(new)), strict=True))
            self.grams = np.vstack([self.grams, self.model.score(new)])
        sizes = np.array([len(x) for x in lists])
        at = np.array([self.gram[g] for x in lists for g in x], np.int64)
        sums = np.vstack([np.zeros((1, len(self.model.langs))), np.cumsum(self.grams[at], axis=0, dtype=np.float64)])
        ends = np.cumsum(sizes)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.sums = np.vstack([self.sums, (sums[ends] - sums[ends - sizes]).astype(np.float32)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.float32)])

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log probability per letter and language, and the number of letters."""
        codes, ends, known = _numbered(texts)
        new = [w for w in known if w not in self.place]
        if len(self.place) + len(new) > WORDS_AT_ONCE:
            self.clear()
            new = known
        if new:
            self.learn(new)
        at = np.array([self.place[w] for w in known], np.int64)[codes] if known else codes
        sums = np.zeros((len(texts), len(self.model.langs)))
        sizes = np.zeros(len(texts))
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            sizes[full] = np.add.reduceat(self.sizes[at], ends[full], dtype=np.float64)
            for i in range(len(self.model.langs)):
                sums[full, i] = np.add.reduceat(self.sums[:, i][at], ends[full], dtype=np.float64)
        return sums / np.maximum(sizes, 1)[:, None], sizes


def _posterior(means: np.ndarray, temperature: float) -> np.ndarray:
    z = np.exp((means - means.max(axis=1, keepdims=True)) / temperature)
    return z / z.sum(axis=1, keepdims=True)


def temperature(model: Model, rows: list[tuple[str, str]]) -> float:
    """Of those on a grid, the one that makes the labels of the rows likeliest."""
    means, sizes = _Words(model).documents(pa.array([t for t, _ in rows], pa.string()))
    truth = np.array([model.langs.index(lang) for _, lang in rows], np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return 1.0
    grid = 2.0 ** -np.arange(0, 10)
    loss = [-np.log(np.maximum(_posterior(means[some], t)[np.arange(len(some)), truth[some]], 1e-9)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _predict(broadcast, heat: float):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        words, names = _Words(model), np.array([*model.langs, "und"], object)
        for batch in batches:
            for first, size in slices(batch["text"]):
                part = batch.slice(first, size)
                means, sizes = words.documents(part["text"])
                best, score = np.full(len(sizes), len(model.langs)), np.zeros(len(sizes))
                if model.langs:
                    posterior = _posterior(means, heat)
                    best = np.where(sizes > 0, posterior.argmax(axis=1), best)
                    score = np.where(sizes > 0, posterior.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    return predict


def _labelled(train: DataFrame, most: int) -> list[tuple[str, str]]:
    """(text, lang) of the ``most`` different rows with the smallest hashes, by hash."""
    rows = train.select(F.xxhash64("doc_id", "text", "lang").alias("row"), "text", "lang")
    last = rows.select("row").distinct().orderBy("row").limit(most).agg(F.max("row")).first()[0]
    chosen = rows.where(F.col("row") <= last).dropDuplicates(["row"]).collect() if last is not None else []
    return [(r.text, r.lang) for r in sorted(chosen, key=lambda r: r.row)]


def identify(
    docs: DataFrame, reject_below: float = REJECT_BELOW, temperature_rows: int = TEMPERATURE_ROWS
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``.

    Learns from text and non-null lang of documents that are not held out: those whose
    crc32 of the doc_id leaves 2 by 4; a null doc_id is held out. The temperature is fitted
    on ``temperature_rows`` of them at most. A text that is null or has no letter is ``und``
    with score 0, as is every text if there is nothing to learn; of equally likely languages
    the first by name is told. Repeated rows come out repeatedly.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    out = held_out("doc_id", FOLDS, HELD_OUT)
    train = docs.where(~out).where("lang is not null and text is not null")
    model = learn(train)
    heat = temperature(model, _labelled(train, temperature_rows)) if model.langs else 1.0
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    predicted = docs.mapInArrow(_predict(broadcast, heat), "doc_id long, lang_pred string, score double")
    return predicted.select(
        "doc_id", out.alias("held_out"), "lang_pred", "score", (F.col("score") < reject_below).alias("rejected")
    )
