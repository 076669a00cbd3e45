"""Quality by co-training: what a page says and how it is made teach each other.

One view of a document is its words: hashed shares of words and of their shapes. The other
is what is known about it: size, lines, the shares of kinds of characters, repetition,
language. Each view has a logistic classifier. In every round each of them labels the
unlabelled documents it is surest of, and the other learns from those too. At the end each
is calibrated on labelled documents that neither has learned from, and the mean of the two
calibrated log-odds, calibrated again, is the score.

Classifiers learn from samples: at most SAMPLE labelled and SAMPLE unlabelled documents,
those with the smallest hashes of their ids. Every document is scored.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import logistic
from ledgerline.llm.shared import Cache, held_out

SAMPLE = 4000
ROUNDS = 3
# Of the unlabelled sample, the share that a view labels per round; at least this sure.
SURE_SHARE = 0.1
SURE = 0.95
FOLDS = 5
HELD_OUT = 0
CALIBRATION = 4
SHAPES = 256
TERMS = 512
LANGUAGES = 8
METADATA = 18 + LANGUAGES
_symbols = b"#*$%&|<>{}[]\\^~_="


def _shape(word: str) -> str:
    """Kinds of characters, each run once: Aa for a word, A! for SHOUTING!!."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def _columns(word: str) -> tuple[int, int]:
    term = word.strip(string.punctuation).lower()
    return zlib.crc32(_shape(word).encode()) % SHAPES, SHAPES + zlib.crc32(term.encode()) % TERMS


class Views:
    """Rows of the two views for texts."""

    def __init__(self):
        self.columns = Cache(_columns)

    def content(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), SHAPES + TERMS), np.float32)
        for row, text in zip(x, texts, strict=True):
            words = Counter((text or "").split())
            if words:
                at = np.array([self.columns[w] for w in words])
                n = np.array(list(words.values()), np.float32) / sum(words.values())
                np.add.at(row, at[:, 0], n)
                np.add.at(row, at[:, 1], n)
        return np.sqrt(x)

    def metadata(self, texts: list[str | None], langs: list[str | None]) -> np.ndarray:
        rows = [self._made(t or "", lang) for t, lang in zip(texts, langs, strict=True)]
        return np.array(rows, np.float32).reshape(-1, METADATA)

    def _made(self, text: str, lang: str | None) -> list[float]:
        raw = text.encode()
        of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        n, words, lines = max(1, len(raw)), raw.split(), raw.split(b"\n")
        m = max(1, len(words))
        share = [
            of[65:91].sum(), of[97:123].sum(), of[48:58].sum(), of[128:].sum(), of[33:48].sum(),
            of[32], of[10], of[33], of[list(_symbols)].sum(), of[124],
        ]
        speech = [0.0] * LANGUAGES
        if lang is not None:
            speech[zlib.crc32(lang.encode()) % LANGUAGES] = 1.0
        return [
            np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), n / m / 10,
            np.log1p(n / len(lines)),
            len(set(words)) / m,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
            len(set(lines)) / len(lines),
            *np.sqrt(np.array(share) / n).tolist(),
            *speech,
        ]


class Model(NamedTuple):
    content: np.ndarray
    metadata: np.ndarray
    # (scale, constant) of each view, and of their mean
    calibration: tuple[np.ndarray, np.ndarray, np.ndarray]

    def odds(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        a, b, both = self.calibration
        views = logistic.score(content, self.content), logistic.score(metadata, self.metadata)
        mean = sum(logistic.score(v[:, None], c) for v, c in zip(views, (a, b), strict=True)) / 2
        return logistic.score(mean[:, None], both)


def co_train(
    x: tuple[np.ndarray, np.ndarray],
    y: np.ndarray,
    unlabelled: tuple[np.ndarray, np.ndarray],
    calibration: tuple[tuple[np.ndarray, np.ndarray], np.ndarray],
    rounds: int = ROUNDS,
) -> Model:
    """Two views of labelled rows with their labels, of unlabelled rows, of calibration rows."""
    taught: list[dict[int, float]] = [{}, {}]  # what each view has learned from the other
    l2 = 3.0, 1.0

    def fitted(view: int) -> np.ndarray:
        at = np.array(list(taught[view]), np.int64)
        rows = np.vstack([x[view], unlabelled[view][at]])
        return logistic.fit(rows, np.concatenate([y, list(taught[view].values())]).astype(rows.dtype), l2[view])

    for _ in range(rounds):
        for view in (0, 1):
            if not len(unlabelled[view]) or len(set(y)) < 2:
                continue
            p = logistic.sigmoid(logistic.score(unlabelled[view], fitted(view)))
            other = taught[1 - view]
            for label, sure, share in ((1.0, p, y.mean()), (0.0, 1 - p, 1 - y.mean())):
                most = int(np.ceil(SURE_SHARE * share * len(p)))
                order = [i for i in np.argsort(-sure, kind="stable") if i not in other][:most]
                other.update({int(i): label for i in order if sure[i] >= SURE})
    weights = fitted(0), fitted(1)
    rows, truth = calibration
    curves = []
    for view in (0, 1):
        z = logistic.score(rows[view], weights[view])[:, None]
        curves.append(_curve(z, truth))
    means = sum(logistic.score(logistic.score(rows[v], weights[v])[:, None], curves[v]) for v in (0, 1)) / 2
    return Model(*weights, (*curves, _curve(means[:, None], truth)))


def _curve(z: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Scale and constant; leaves the odds alone without examples of both classes."""
    if len(set(truth)) < 2:
        return np.array([1.0, 0.0])
    return logistic.fit(z.astype(np.float64), truth.astype(np.float64), 0.1, 300)


def _packed(row: np.ndarray) -> bytes:
    """Which numbers of the row are not 0, a bit each, and these: a text has few of all words."""
    return np.packbits(row != 0).tobytes() + row[row != 0].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    row = np.zeros(SHAPES + TERMS, np.float32)
    bits = np.frombuffer(packed, np.uint8, len(row) // 8)
    row[np.unpackbits(bits).astype(bool)] = np.frombuffer(packed, np.float32, offset=len(bits))
    return row


def _view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    views = Views()
    for batch in batches:
        texts = batch["text"].to_pylist()
        content = views.content(texts)
        made = views.metadata(texts, batch["lang"].to_pylist())
        yield pa.RecordBatch.from_arrays(
            [
                *(batch[c] for c in ("doc_id", "quality", "calibrates")),
                pa.array([_packed(row) for row in content], pa.binary()),
                pa.array([row.tobytes() for row in made], pa.binary()),
            ],
            ["doc_id", "quality", "calibrates", "content", "metadata"],
        )


def _score(broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, views = broadcast.value, Views()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part["text"].to_pylist()
                odds = model.odds(views.content(texts), views.metadata(texts, part["lang"].to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(logistic.sigmoid(odds.astype(np.float64)))], ["doc_id", "score"]
                )

    return score


def _taught(viewed: pa.Table, rounds: int) -> Model:
    """The model that the rows of ``_view`` teach, whatever their order.

    A row's content is unpacked where it is used, so that the driver holds the sample once.
    """
    ids, content, metadata = viewed["doc_id"].to_numpy(), viewed["content"], viewed["metadata"]
    quality, calibrates = viewed["quality"].to_pylist(), viewed["calibrates"].to_pylist()
    sets: dict[str, list[int]] = {"learn": [], "open": [], "calibrate": []}
    for _, same in groupby(np.argsort(ids, kind="stable").tolist(), ids.__getitem__):
        for i in sorted(same, key=lambda i: _unpacked(content[i].as_py()).tobytes()):
            kind = "open" if quality[i] is None else "calibrate" if calibrates[i] else "learn"
            sets[kind].append(i)

    def of(kind: str) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        rows = sets[kind]
        x, made = np.empty((len(rows), SHAPES + TERMS), np.float32), np.empty((len(rows), METADATA), np.float32)
        for at, i in enumerate(rows):
            x[at] = _unpacked(content[i].as_py())
            made[at] = np.frombuffer(metadata[i].as_py(), np.float32)
        return (x, made), np.array([quality[i] or 0 for i in rows], np.float32)

    (x, y), (unlabelled, _) = of("learn"), of("open")
    return co_train(x, y, unlabelled, of("calibrate"), rounds)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, lang).

    Learns from ``labels`` (doc_id, quality 0 or 1) of documents that are not held out, those
    whose crc32 of the doc_id leaves 0 by 5; a null doc_id is held out. A document with two
    labels counts as bad if one says so. Null texts count as empty and are scored as any
    text. Without labels of both classes all documents get the class that there is, or 0.5
    and so predicted 1.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    order = F.xxhash64("doc_id")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .where(~held_out("doc_id", FOLDS, HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    calibrates = held_out("doc_id", FOLDS, CALIBRATION)
    chosen = known.withColumn("calibrates", calibrates)
    picked = None
    for fold in (True, False):  # bounded rows
        part = chosen.where(F.col("calibrates") == fold).orderBy(order).limit(sample)
        picked = part if picked is None else picked.union(part)
    other = docs.select("doc_id").where("doc_id is not null").where(~held_out("doc_id", FOLDS, HELD_OUT))
    other = other.distinct().join(known, "doc_id", "left_anti").orderBy(order).limit(sample)
    wanted = picked.unionByName(other, allowMissingColumns=True)
    viewed = docs.join(F.broadcast(wanted), "doc_id").mapInArrow(
        _view, "doc_id long, quality int, calibrates boolean, content binary, metadata binary"
    )
    model = _taught(viewed.toArrow(), rounds)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.mapInArrow(_score(broadcast), "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without documents predicted bad; null ids stay."""
    bad = score(docs, labels).where("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
