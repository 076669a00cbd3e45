"""License texts and phrases in documents, by votes for diagonals.

Every GRAM words in a row of every text are hashed and joined to the hashes of the same
length in the templates. A hit at word i of a text and word t of a template votes for the
diagonal i - t, where the template would begin. Votes are counted per diagonal; diagonals of a
template that are neighbours (words put in or left out shift what follows) are merged, and a
merged stretch that reaches far enough into the template is verified word by word against the
text, which it is joined with once more.

Templates are of two sorts: phrases, that must stand word for word, and notices, of which a
share of the words is enough. All of it is DataFrame operations. Up to the verification rows
hold hashes and numbers only; texts with a stretch to verify are the only ones shuffled, each
different one once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerline.llm.shared import only_ids
from ledgerline.session import materialize

# Words are made of digits, lower-case letters and whatever is not ASCII.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 3
# The share of a notice's words that must stand on merged diagonals.
COVERED = 0.8
# Diagonals of a notice this far from the next smaller one at most are merged.
NEIGHBOURS = 4
# Grams of templates that are broadcast, at most; with more of them the join is shuffled.
BROADCAST_GRAMS = 200_000

# Phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Public license notices and their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "either version 3 of the GNU General Public License, or (at your option) any later version"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-2", "either version 2 of the GNU General Public License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, BREAK), "")


def _grams(words: str) -> Column:
    """Hashes of GRAM words in a row, by the place of the first."""
    hashes, n = F.col(words), F.size(words)
    for k in range(1, GRAM):
        size = F.greatest(n - k, F.lit(0))
        hashes = F.zip_with(
            F.slice(hashes, 1, size), F.slice(F.col(words), F.lit(k + 1), size), lambda h, w: F.xxhash64(h, w)
        )
    return hashes


def templates(
    spark: SparkSession,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """(template, label, base, words); ``base`` marks the phrases.

    Each needs GRAM words at least.
    """
    rows = [
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text"))
        for i, (label, text, base) in enumerate([*((*p, True) for p in phrases), *((*n, False) for n in notices)])
    ]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    table = table.withColumn("words", words_of("text")).drop("text")
    if short := table.where(F.size("words") < GRAM).select("label").take(1):
        raise ValueError(f"a template of {short[0].label} has fewer than {GRAM} words")
    return table


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc_id, text, a, b) with two hashes of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = [F.xxhash64(F.lit(n), text).alias(name) for n, name in ((1, "a"), (2, "b"))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *hashes)


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(row, doc_id, a, b, n_words, template, diagonal, votes, low, high).

    A line per diagonal that has votes, from template word ``low`` to the gram at ``high``,
    and one per row of ``docs`` without a template. ``row`` names the row, a and b its text.
    """
    keys = ["row", "doc_id", "a", "b", "n_words"]
    rows = _keyed(docs).withColumn("words", words_of("text"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "a", "b",
        F.size("words").cast("long").alias("n_words"), _grams("words").alias("grams"),
    )
    # The first element stands for the row itself. It hits nothing: see ``hit``.
    grams = rows.select(*keys, F.posexplode(F.concat(F.array(F.col("row")), "grams")).alias("place", "gram"))
    known = table.select("template", F.posexplode(_grams("words")).alias("at", "gram"))
    if known.count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    itself = F.col("place") == 0
    hits = grams.join(known, "gram", "left").where(itself | F.col("template").isNotNull())

    def hit(value: Column) -> Column:
        return F.when(~itself, value)

    return hits.groupBy(
        *keys, hit(F.col("template")).alias("template"),
        hit(F.col("place") - 1 - F.col("at")).alias("diagonal"),
    ).agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))


def _stretches(found: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b, stretches): per text, merged diagonals that reach far enough into their template."""
    known = F.broadcast(table.withColumnRenamed("words", "expected"))
    found = found.where("template is not null").join(known, "template")
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS
    opens = F.when(F.col("base") | F.coalesce(apart, F.lit(True)), 1).otherwise(0)
    merged = found.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(along))
    merged = merged.groupBy("row", "template", "stretch").agg(
        *[F.first(c).alias(c) for c in ("a", "b", "label", "base", "expected")],
        F.collect_list(F.struct("diagonal", "low", "high")).alias("diagonals"),
        F.sum(F.col("high") - F.col("low") + GRAM).alias("reach"),
        F.sum("votes").alias("votes"),
    )
    size = F.size("expected")
    whole = F.col("base") & (F.col("votes") == size - GRAM + 1)
    merged = merged.where(whole | (~F.col("base") & (F.col("reach") >= COVERED * size)))
    stretch = F.struct("label", "base", "expected", "diagonals")
    texts = merged.groupBy("row").agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.collect_list(stretch).alias("stretches")
    )
    # Equal texts have equal stretches.
    return texts.drop("row").dropDuplicates(["a", "b"])


def _verified(words: Column, stretch: Column) -> Column:
    """The stretch as (label, base, first, last, matched, covered), by comparing words."""

    def equal(d: Column) -> Column:
        places = F.sequence(d["low"], d["high"] + GRAM - 1)
        return F.filter(places, lambda t: F.get(words, t + d["diagonal"]) == F.get(stretch["expected"], t))

    matched = F.size(F.array_distinct(F.flatten(F.transform(stretch["diagonals"], equal))))
    return F.struct(
        stretch["label"].alias("label"),
        stretch["base"].alias("base"),
        F.array_min(F.transform(stretch["diagonals"], lambda d: d["diagonal"] + d["low"])).cast("long").alias("first"),
        F.array_max(F.transform(stretch["diagonals"], lambda d: d["diagonal"] + d["high"] + GRAM - 1)).cast("long").alias("last"),
        matched.alias("matched"),
        (matched / F.size(stretch["expected"])).alias("covered"),
    )


def _outermost(spans: DataFrame) -> DataFrame:
    """Without notices that lie within the stretch of one with more words: its near relatives."""
    along = W.partitionBy("a", "b", "base").orderBy("first", F.desc("last"), F.desc("matched"), "label")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    widest = F.max(F.struct("last", "matched")).over(before)
    within = ~F.col("base") & (widest["last"] >= F.col("last")) & (widest["matched"] > F.col("matched"))
    return spans.withColumn("within", F.coalesce(within, F.lit(False))).where("not within").drop("within")


def scan(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, spans) for every row of ``docs`` (doc_id, text).

    ``spans`` are the verified stretches as (first, last, label, base, matched, covered), in
    that order: phrases word for word, notices of which COVERED of the words stand there, but
    none within the stretch of another that matches more words. first and last are places of
    words, from 0. A null or empty text
    has no words and no spans; repeated rows come out repeatedly, a null doc_id stays null,
    an empty table gives no rows, and other columns of ``docs`` are ignored. ``table`` is
    that of ``templates``.
    """
    table = templates(docs.sparkSession) if table is None else table
    counted = materialize(votes(docs, table))
    stretches = materialize(_stretches(counted, table))
    texts = only_ids(_keyed(docs), "a", stretches.select("a"))
    texts = texts.groupBy("a", "b").agg(F.first("text").alias("text"))
    joined = texts.join(stretches, ["a", "b"]).withColumn("words", words_of("text"))
    words = F.col("words")
    checked = joined.select("a", "b", F.transform("stretches", lambda s: _verified(words, s)).alias("spans"))
    enough = F.filter("spans", lambda s: (s["covered"] == 1) | (~s["base"] & (s["covered"] >= COVERED)))
    spans = checked.select("a", "b", F.explode(enough).alias("span")).select("a", "b", "span.*")
    listed = F.array_sort(F.collect_list(F.struct("first", "last", "label", "base", "matched", "covered")))
    checked = materialize(_outermost(spans).groupBy("a", "b").agg(listed.alias("spans")))
    rows = counted.where("template is null").select("doc_id", "n_words", "a", "b")
    return rows.join(checked, ["a", "b"], "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast(checked.schema["spans"].dataType)).alias("spans")
    )
