"""A training corpus from ``documents`` in five stages, each written and read again.

``STAGES`` lists name and function; a function takes ``(spark, docs, sf_dir)``, works on
every row it is given, and all but the last return the columns of documents.

1. language: drops documents in which no language is found (no letter at all).
2. near_dedup: of documents tied by similarity 0.8 of their runs of five words, the one
   with the smallest id stays; documents without words stay.  Where ids are missing or
   repeated, each row is a document of its own; of equal rows the first in order of id, text
   and the other columns stays.
3. pii: masks personal data in the text and sets n_chars to the new length.
4. mixing: repeats documents so that temperature-flattened source weights are met, none
   more than twice against the least repeated source, and none left out.
5. packing: pieces of sequences of 1,024 ids.

Null texts count as empty; an empty table stays empty.  Names of further columns are free.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import language as language_id
from sparkloom.llm import minhash, mixing as mixture, packing as packer
from sparkloom.llm import pii as personal
from sparkloom.llm.common import fold, fresh, parts, read, small_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    train = docs.where(fold(F.col("doc_id"), 3) != 1)
    names, protos = language_id.prototypes(train)
    if not names:  # nothing to learn from: only texts without a letter go
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, names, protos, keep=docs.columns)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    key, gone = "doc_id", fresh(docs.columns, "__gone")
    rows = docs
    if not docs.groupBy(key).count().where("count > 1 or doc_id is null").isEmpty():
        key = fresh(docs.columns, "__row")
        rows = _numbered(docs, key)
    groups = minhash.near_duplicates(rows, doc_id=key, width=5)
    dropped = stored(groups.where(~F.col("kept")).select(F.col("doc_id").alias(gone)), "gone")
    return rows.join(dropped, F.col(key) == F.col(gone), "left_anti").select(*docs.columns)


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """Rows with a number of their own, in order of ids (those without one last)."""
    place = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(parts(docs.sparkSession), *place).sortWithinPartitions(*place, *docs.columns)
    return stored(dealt.withColumn(name, F.monotonically_increasing_id()), "numbered")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return personal.redact(docs, personal.fit(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixture.repeated(docs, limit=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packer.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: The stages learn, sketch and solve; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
