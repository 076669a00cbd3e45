"""Quality rules: the likelihood ratio of word pairs in trusted and in raw text.

Pairs of neighbouring words are hashed into BUCKETS. Two multinomials over the buckets, one
of trusted documents and one of all documents, each with a fixed share of the other mixed
in, give each bucket a log ratio. The mean of a document's log ratios is its score. Texts
fall into two halves by hash, and each is scored by the trusted texts of the other half, so
that a trusted document does not speak for itself. A document is refused if its score is
below that of nearly all trusted texts, scored in the same way. Simple counts refuse others
before that.

Only shares of counts matter, not the counts: a corpus copied many times gives the same
ratios, the same cut and the same verdicts.

All of it is DataFrame operations; the one thing broadcast is the table of BUCKETS ratios.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import only_ids
from ledgerline.session import materialize

BUCKETS = 2**18
# The share of the other multinomial in each: ratios are within its odds.
MIXED = 0.1
# A document is refused below the score that this share of the trusted texts falls below.
TRUSTED_REFUSED = 0.05
# Input partitions that one task counts, where there are more than enough.
PARTITIONS_MERGED = 8
# Ids of trusted documents that are broadcast, at most: some 64 MB.
BROADCAST_IDS = 4_000_000
# Scores are compared to this many places, so that the order of a sum does not matter.
PLACES = 3
LEAST_WORDS = 10
WINDOW = 5
REPEATED_PER_CENT = 20
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), "")


def _side_by_side(words: str) -> Column:
    """Hashes of neighbouring words, by the place of the first."""
    every = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    return F.slice(every, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def _windows(words: str, pairs: str) -> Column:
    """Hashes of WINDOW words in a row: of two pairs and a word."""
    every = F.transform(pairs, lambda p, i: F.xxhash64(p, F.get(pairs, i + 2), F.get(words, i + 4)))
    return F.slice(every, 1, F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _covered(windows: Column) -> Column:
    """How many words the windows cover whose hash occurs twice or more."""

    def repeated(s: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(s, i - 1)["h"])
            return (x["h"] == F.coalesce(before, x["h"] + 1)) | (
                x["h"] == F.coalesce(F.get(s, i + 1)["h"], x["h"] + 1)
            )

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def count(at: Column) -> Column:
        # Positions in order: each covers what the one before it does not.
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            at,
            start,
            lambda t, i: F.struct(
                (t["n"] + i + WINDOW - F.greatest(i, t["end"])).alias("n"), (i + WINDOW).alias("end")
            ),
            lambda t: t["n"],
        )

    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(F.sort_array(numbered), lambda s: count(repeated(s)))


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, same, the counts, base_failed, half, pairs).

    same is a hash of the text, pairs are those of neighbouring words. A null text has no words.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    df = docs.select("doc_id", "text", _words("text").alias("words"))
    df = df.select(
        "doc_id",
        F.xxhash64("text").alias("same"),
        _half("text").alias("half"),
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        "words",
        _side_by_side("words").alias("pairs"),
    )
    df = df.withColumn("windows", _windows("words", "pairs")).drop("words")
    alone = F.size(F.array_distinct("windows")) == F.size("windows")
    repeated = F.when(alone, F.lit(0)).otherwise(_covered(F.col("windows"))).cast("long")
    df = df.withColumn("n_repeat_words", repeated).drop("windows")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PER_CENT * F.col("n_words")
    )
    return df.withColumn("base_failed", failed)


def _bucket(pair: Column, buckets: int) -> Column:
    return F.pmod(pair, F.lit(buckets)).cast("int")


def _half(text: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("int")


def _merged(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, though no fewer than there are cores.

    Each task counts nearly all buckets, so what is shuffled goes by the number of tasks.
    """
    tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-tasks // PARTITIONS_MERGED)))


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio_0, ratio_1) for buckets that hold a pair of ``docs`` or ``trusted`` (text).

    ratio_0 is for texts of half 0: trusted pairs are counted in texts of half 1, raw ones
    in all. Without trusted pairs in the other half the ratios are 0.
    """
    texts = [
        _merged(df.select("text")).select("text", F.lit(sort).alias("sort"))
        for sort, df in ((-1, docs), (0, trusted))
    ]
    # -1 for raw texts; trusted ones have their half.
    half = F.when(F.col("sort") == 0, _half("text")).otherwise(F.col("sort"))
    words = texts[0].unionByName(texts[1]).select(half.alias("half"), _words("text").alias("words"))
    pairs = words.select("half", _side_by_side("words").alias("pairs"))
    # Outer: else a filter on the array's size is derived, which splits each text many times.
    rows = pairs.select("half", F.explode_outer("pairs").alias("pair")).where("pair is not null")
    counted = {"raw": -1, "target_0": 1, "target_1": 0}
    counts = materialize(
        rows.groupBy(_bucket(F.col("pair"), buckets).alias("bucket")).agg(
            *[F.count_if(F.col("half") == h).alias(name) for name, h in counted.items()]
        )
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted]
    total = counts.agg(*sums).first()

    def ratio(h: int) -> Column:
        if not (total["raw"] and total[f"target_{h}"]):
            return F.lit(0.0)
        raw = F.col("raw") / F.lit(float(total["raw"]))
        target = F.col(f"target_{h}") / F.lit(float(total[f"target_{h}"]))
        mixed = ((1 - MIXED) * target + MIXED * raw) / ((1 - MIXED) * raw + MIXED * target)
        return F.when(raw + target > 0, F.log(mixed)).otherwise(F.lit(0.0))

    return counts.select("bucket", ratio(0).alias("ratio_0"), ratio(1).alias("ratio_1"))


def _scored(df: DataFrame, table: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """``keep`` and the score, from df with row, ``keep``, half and pairs; row names a row."""
    pairs = df.select("row", *keep, "half", F.explode_outer("pairs").alias("pair"))
    pairs = pairs.withColumn("bucket", _bucket(F.col("pair"), buckets))
    # At most ``buckets`` rows. A document's rows are in one task, so that its sum is
    # complete before the shuffle.
    ratio = F.when(F.col("half") == 0, F.col("ratio_0")).otherwise(F.col("ratio_1"))
    scored = pairs.join(F.broadcast(table), "bucket", "left").groupBy("row")
    score = F.avg(F.coalesce(ratio, F.lit(0.0))).alias("score")
    return scored.agg(*[F.first(c).alias(c) for c in keep], score).drop("row")


def cut(trusted: DataFrame, table: DataFrame, scored: DataFrame, buckets: int = BUCKETS) -> float | None:
    """The score that TRUSTED_REFUSED of all different trusted texts (text) fall below.

    Texts are told apart by hash. Those in ``scored`` (same, n_words, score) have their score
    there, only others are scored. None if there are none that pass the count of words.
    """
    texts = trusted.select("text", F.xxhash64("text").alias("same"))
    wanted = materialize(texts.select("same").distinct())
    known = scored.where(F.col("n_words") >= LEAST_WORDS).select("same", "score")
    known = known.join(wanted, "same", "left_semi").groupBy("same").agg(F.first("score").alias("score"))
    other = materialize(wanted.join(scored.select("same"), "same", "left_anti"))
    scores = known.select("score")
    if not other.isEmpty():
        rest = only_ids(texts, "same", other).join(other, "same")
        rest = rest.select(F.col("same").alias("row"), _half("text").alias("half"), _words("text").alias("words"))
        rest = rest.where(F.size("words") >= LEAST_WORDS).withColumn("pairs", _side_by_side("words"))
        scores = scores.union(_scored(rest, table, [], buckets).select("score"))
    scores = scores.select(F.round("score", PLACES).alias("score"))
    return scores.agg(F.expr(f"percentile_disc({TRUSTED_REFUSED}) WITHIN GROUP (ORDER BY score)")).first()[0]


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of documents that ``labels`` (doc_id, quality) calls good, each row once.

    Up to BROADCAST_IDS labelled ids go to the texts, more of them are joined by shuffle.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    good = materialize(good.distinct())
    if good.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(good), "doc_id", "left_semi").select("text")
    return only_ids(docs, "doc_id", good).join(good, "doc_id", "left_semi").select("text")


def rules(
    docs: DataFrame, trusted: DataFrame, threshold: float | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """A row per row of ``docs``: (doc_id, the counts, base_failed, score, kept).

    ``trusted`` has a column text. Without ``threshold`` it is the ``cut`` of the trusted
    texts; without trusted texts the ratio refuses nothing. A document with fewer than two
    words scores 0; it fails the base rules anyway, as do null and empty texts. Windows are
    compared by 64-bit hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = materialize(trusted.select("text"))
    table = materialize(ratios(docs, trusted, buckets))
    base = base_rules(docs).withColumn("row", F.monotonically_increasing_id())
    keep = [c for c in base.columns if c not in ("row", "pairs", "half")]
    scored = _scored(base, table, keep, buckets)
    if threshold is None:
        scored = materialize(scored)
        threshold = cut(trusted, table, scored, buckets)
    passes = F.lit(True) if threshold is None else F.round("score", PLACES) >= threshold
    return scored.drop("same").withColumn("kept", ~F.col("base_failed") & passes)
