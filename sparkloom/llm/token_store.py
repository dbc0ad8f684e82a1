"""Content-addressed store of token ids, in ascending document order.

Documents are ranged over buckets by id, encoded in order, and cut by ``chunks``.  A
bucket's file holds its documents' recipes (chunk digests, ends, Merkle root) and the
chunks they own; a manifest holds each bucket's counts and the root of a hash tree over its documents.
Reading rebuilds every stream, checks chunk digests, document roots and bucket roots.

Defined results: null text counts as empty; an empty text has its end id alone.  Rows
that repeat an id stand one after the other, ordered by text; rows without an id come
first.  An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import chunks
from .common import bucket_of, bucketed, discarded, id_buckets, parts, read, shared_dir, small
from .tokens import encoder

UNIT = 2  # bytes of an id


def _encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """``key`` (bucket and place), recipe and ids of every document, sorted by id."""

    def encode(batches):
        enc, last, now, place, at = encoder(tokenizer), np.array([end], np.uint16), None, 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                b = batch.slice(i, 1000)
                streams = [np.concatenate([ids, last]) for ids in enc.many([t or "" for t in b.column(2).to_pylist()])]
                ends = chunks.cuts(streams)
                data = [s.tobytes() for s in streams]
                names = [chunks.digests(d, e, UNIT) for d, e in zip(data, ends)]
                keys, starts = [], []
                for bucket, s in zip(b.column(0).to_pylist(), streams):
                    if bucket != now:
                        now, place, at = bucket, 0, 0
                    keys.append((bucket << 40) + place)
                    starts.append(at)
                    place, at = place + 1, at + len(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), b.column(1), b.column(0), pa.array(starts, pa.int64()), pa.array(map(len, streams), pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(ends, pa.list_(pa.int32())), pa.array(map(chunks.root, names), pa.binary()), pa.array(data, pa.binary())],
                    ["key", "doc_id", "bucket", "at", "n_tokens", "digests", "ends", "root", "body"],
                )

    n = parts(docs.sparkSession)
    docs = docs.withColumn("bucket", bucket_of(F.col("doc_id"), id_buckets(docs, "doc_id", 2 * n)))
    docs = docs.repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "text").select("bucket", "doc_id", "text")
    return docs.mapInArrow(encode, "key long, doc_id long, bucket int, at long, n_tokens long, digests array<binary>, ends array<int>, root binary, body binary")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Documents, or groups of them, that are hashed together (two to this power), and levels.
FAN, LEVELS = 10, 4


def _manifest(rows: DataFrame) -> DataFrame:
    """``bucket, docs, tokens, top``: the last is the root of a tree of hashes over its
    documents' roots in order, at most 1,024 to a node."""
    level = rows.select("bucket", "key", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"), F.hex("root").alias("top"))
    for _ in range(LEVELS):  # 40 bits of a key are the place in its bucket
        own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "top"))), lambda x: x["top"]), ",")
        level = level.groupBy("bucket", F.shiftright("key", FAN).alias("__key")).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.sha2(own, 256).alias("top"))
        level = level.withColumnRenamed("__key", "key")
    return level.select("bucket", "docs", "tokens", "top")


def write(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes recipes, chunks and manifest to the shared folder; gives the store's path."""

    def strip(batches):
        for b in batches:
            at = {name: b.column(b.schema.get_field_index(name)) for name in b.schema.names}
            bodies = [chunks.kept(d, e, UNIT, x) for d, e, x in zip(at["body"].to_pylist(), at["ends"].to_pylist(), at["borrowed"].to_pylist())]
            names = ["doc_id", "bucket", "at", "n_tokens", "digests", "ends", "root", "borrowed", "lent"]
            yield pa.RecordBatch.from_arrays([at["key"], *(at[x] for x in names), pa.array(bodies, pa.binary())], ["row", *names, "body"])

    spark = docs.sparkSession
    path = shared_dir(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encoded = bucketed(_encoded(docs, tokenizer, end), "bucket", parts(spark), f"{path}/encoded")
    schema = "row long, doc_id long, bucket int, at long, n_tokens long, digests array<binary>, ends array<int>, root binary, borrowed array<int>, lent array<struct<place:int,uses:long>>, body binary"
    chunks.with_shares(encoded, "bucket", strip, schema, f"{path}/chunks")
    _written(_manifest(encoded.select("key", "root", "bucket", "n_tokens")), f"{path}/manifest")
    discarded(spark, f"{path}/encoded")
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def check(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for row, doc, bucket, at, n, names, ends, top, borrowed, body, extra in zip(*(c.to_pylist() for c in b.columns)):
                data = chunks.joined(body, ends, UNIT, names, borrowed, {x["place"]: x["chunk"] for x in extra or ()})
                if len(data) != n * UNIT or chunks.root(names) != top:
                    raise chunks.BrokenChunk("a document does not have its stored length or root")
                ids = np.frombuffer(data, np.uint16).astype("<u4")
                for column, v in zip(out, (doc, bucket, at, n, zlib.crc32(ids.tobytes()), row, top)):
                    column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "bucket", "at", "n_tokens", "ids_crc32", "key", "root"])

    manifest = spark.read.parquet(f"{path}/manifest")
    store = spark.read.parquet(f"{path}/chunks")
    columns = ["row", "doc_id", "bucket", "at", "n_tokens", "digests", "ends", "root", "borrowed", "body", "extra"]
    schema = "doc_id long, bucket int, at long, n_tokens long, ids_crc32 long, key long, root binary"
    whole, borrowing = (part.select(*columns).mapInArrow(check, schema) for part in chunks.read_back(store, UNIT))
    stored_rows = store.select(F.col("row").alias("key"), "bucket", "n_tokens", "root")
    broken = _manifest(stored_rows).join(manifest, ["bucket", "docs", "tokens", "top"], "left_anti").count()
    if broken:
        raise chunks.BrokenChunk(f"{broken} buckets differ from their manifest")
    before = F.sum("tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = manifest.select(F.col("bucket").alias("b"), F.coalesce(before, F.lit(0)).alias("base"))
    rows = whole.union(borrowing).join(small(base, manifest.count(), 32), F.col("bucket") == F.col("b"))
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_store(spark, write(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2))
