"""Tables whose rows are replaced key by key, for the state of streams and for lookups.

Keys are hashed into buckets. A write puts the new rows of the keys it changes into a folder
of its own, a part per bucket, and then a small file that says which folders hold each
bucket's rows: a version. Readers merge on reading: of each key the rows written last count.
So a write costs what it changes, a reader opens the buckets it needs only, and both see a
version whole or not at all. Every so often a write puts a bucket's rows together anew, the
buckets taking turns; folders that neither of the last two versions needs are deleted.

Writes are numbered, and a number is written once: a micro-batch that runs again after a
failure finds its version and leaves it alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import delete, exists, listed, read_text, write_once, write_text_once

BUCKETS = 64
# A bucket has at most this many folders to merge.
COMPACT_EVERY = 20
BUCKET, BATCH = "bucket", "batch"


class Version(NamedTuple):
    """What a write left behind; ``batches`` are the folders of each bucket, oldest first."""

    number: int
    buckets: int
    schema: T.StructType
    batches: dict[int, list[int]]
    # The newest event time so far.
    frontier: datetime | None

    def text(self) -> str:
        said = self._asdict() | {"schema": self.schema.jsonValue()}
        said["frontier"] = self.frontier and self.frontier.isoformat()
        return json.dumps(said)

    @classmethod
    def of(cls, text: str) -> Version:
        said = json.loads(text)
        said["schema"] = T.StructType.fromJson(said["schema"])
        said["batches"] = {int(b): n for b, n in said["batches"].items()}
        said["frontier"] = said["frontier"] and datetime.fromisoformat(said["frontier"])
        return cls(**said)


class KeyedTable:
    """A table in the folder ``path``, by ``keys``, whose values are not null.

    A table keeps the number of buckets that it began with. With ``bloom`` its files have
    Bloom filters of the keys, for lookups.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        buckets: int = BUCKETS,
        compact_every: int = COMPACT_EVERY,
        bloom: bool = False,
    ):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.buckets, self.every, self.bloom = buckets, compact_every, bloom

    def _version(self, number: int) -> str:
        return f"{self.path}/versions/{number}.json"

    def _data(self, number: int | None = None) -> str:
        return f"{self.path}/data" + ("" if number is None else f"/{BATCH}={number}")

    def has(self, number: int) -> bool:
        return exists(self.spark, self._version(number))

    def numbers(self) -> list[int]:
        """The numbers of the versions that can be read."""
        names = (n.removesuffix(".json") for n in listed(self.spark, f"{self.path}/versions"))
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The last version, or that of a number; None if nothing has been written yet."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return None
            number = numbers[-1]
        elif not self.has(number):
            raise FileNotFoundError(f"no version {number} in {self.path}")
        version = Version.of(read_text(self.spark, self._version(number)))
        self.buckets = version.buckets
        return version

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def rows(
        self,
        version: Version | None = None,
        buckets: Sequence[int] | None = None,
        where: Column | None = None,
    ) -> DataFrame:
        """The rows of a version (the last one), of all or some buckets.

        ``where`` is about the keys only: it is applied where the files are read.
        """
        version = version or self.version()
        if version is None:
            raise FileNotFoundError(f"nothing was written to {self.path}")
        wanted = {b: n for b, n in version.batches.items() if buckets is None or b in buckets}
        folders = sorted({n for numbers in wanted.values() for n in numbers})
        if not folders:
            return self.spark.createDataFrame([], version.schema)
        extra = [T.StructField(BATCH, T.IntegerType()), T.StructField(BUCKET, T.IntegerType())]
        reader = self.spark.read.schema(T.StructType([*version.schema.fields, *extra]))
        found = reader.option("basePath", self._data()).parquet(*[self._data(n) for n in folders])
        # A bucket's rows from before it was put together are no longer its rows.
        since: dict[int, list[int]] = {}
        for bucket, numbers in wanted.items():
            since.setdefault(numbers[0], []).append(bucket)
        parts = [(F.col(BATCH) >= n) & F.col(BUCKET).isin(b) for n, b in sorted(since.items())]
        found = found.where(reduce(lambda a, b: a | b, parts))
        if where is not None:
            found = found.where(where)
        if any(len(numbers) > 1 for numbers in wanted.values()):
            last = W.partitionBy(*self.keys).orderBy(F.col(BATCH).desc())
            found = found.withColumn("rank", F.rank().over(last)).where("rank = 1").drop("rank")
        return found.drop(BATCH, BUCKET)

    def write(
        self,
        number: int,
        rows: DataFrame,
        touched: Sequence[int] | None = None,
        frontier: datetime | None = None,
        keep: Column | None = None,
        before: Version | None = None,
    ) -> Version:
        """Replace all rows of the keys of ``rows`` as write ``number``; the others stay.

        ``touched`` are the buckets of ``rows`` if they are known. ``before`` is the version
        to build on. Where a bucket is put together, only its rows with ``keep`` stay.
        """
        if self.has(number):
            return self.version(number)
        if before is not None:
            self.buckets = before.buckets
        batches = {} if before is None else {b: list(n) for b, n in before.batches.items()}
        schema = rows.schema if before is None else before.schema
        due = [
            bucket
            for bucket, numbers in batches.items()
            if len(numbers) >= self.every
            or (2 * len(numbers) >= self.every and number % self.every == bucket % self.every)
        ]
        touched = list(range(self.buckets)) if touched is None else touched
        if due:
            rest = self.rows(before, due).join(rows.select(*self.keys), self.keys, "left_anti")
            rows = rows.unionByName(rest if keep is None else rest.where(keep))
        if touched or due:
            placed = rows.select(*schema.names).withColumn(BUCKET, self.bucket()).repartition(BUCKET)
            options = {f"parquet.bloom.filter.enabled#{k}": "true" for k in self.keys if self.bloom}
            options["parquet.bloom.filter.adaptive.enabled"] = "true"
            ordered = placed.sortWithinPartitions(BUCKET, *self.keys)
            write_once(ordered, self._data(number), [BUCKET], options)
        for bucket in touched:
            batches[bucket] = [*batches.get(bucket, ()), number]
        for bucket in due:
            batches[bucket] = [number]
        version = Version(number, self.buckets, schema, batches, frontier)
        write_text_once(self.spark, self._version(number), version.text())
        self._clean(version, before)
        return version

    def upsert(self, rows: DataFrame) -> Version:
        """Replace the keys of ``rows`` as the next write, outside a stream."""
        before = self.version()
        return self.write(0 if before is None else before.number + 1, rows, before=before)

    def lookup(self, ids: DataFrame | int | str, predicate: Column | None = None) -> DataFrame:
        """The rows of a key, or of a frame of keys, that meet ``predicate``.

        Opens the buckets of these keys only; in them a single key is looked for by the
        files' Bloom filters.
        """
        version = self.version()
        if version is None:
            raise FileNotFoundError(f"nothing was written to {self.path}")
        if not isinstance(ids, DataFrame):
            (key,) = self.keys
            ids = self.spark.range(1).select(F.lit(ids).cast(version.schema[key].dataType).alias(key))
            (one,) = ids.select(self.bucket(), key).collect()
            found = self.rows(version, [one[BUCKET]], F.col(key) == F.lit(one[key]))
        else:
            ids = ids.select(*[F.col(k).cast(version.schema[k].dataType).alias(k) for k in self.keys])
            # At most as many rows as there are buckets.
            buckets = [r[BUCKET] for r in ids.select(self.bucket()).distinct().collect()]
            found = self.rows(version, buckets).join(ids, self.keys, "left_semi")
        return found if predicate is None else found.where(predicate)

    def _clean(self, version: Version, before: Version | None) -> None:
        """Delete what only versions older than ``before`` need."""
        if before is None:
            return
        needed = {n for v in (version, before) for numbers in v.batches.values() for n in numbers}
        for name in listed(self.spark, self._data()):
            number = name.removeprefix(f"{BATCH}=")
            if number.isdigit() and int(number) < version.number and int(number) not in needed:
                delete(self.spark, f"{self._data()}/{name}")
        for number in self.numbers():
            if number < before.number:
                delete(self.spark, self._version(number))
