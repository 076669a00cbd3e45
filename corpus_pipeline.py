"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
Labels to learn from are in ``sf_dir``.

Rows with a null or empty text, and rows without doc_id, go through the toxicity and quality
stages by their scores like others, are no near-duplicates of anything (rows with the same
doc_id and text count as one document) and have no personal data; packed, they have a piece
with the one id that ends a document. An empty table gives empty tables. Columns that
documents do not have are carried through the stages, whatever their names; n_chars is set
anew where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import cotraining, forest, packing, surrogates, toxicity
from ledgerline.llm.queries import KEY, TOKENIZER
from ledgerline.llm.shared import read
from ledgerline.session import materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.keep_good(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    replaced = surrogates.pseudonymize(docs, KEY)
    if "n_chars" not in docs.columns:
        return replaced
    return replaced.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_only),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

# Stages with trained models, keyed hashes and a tokenizer: no SQL. The tests hold the
# stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
